"""File sources: URL lists, run reports, CSV reports, rejects, the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL_FIELDS = "id string, platform string, genre string, final_url string, original_url string, normalized_url string, url string"
RUN_ITEM = "item_id string, url string, platform string, genre string, success boolean, tier string, extraction_ms double, enrichment_ms double, embedding_ms double, total_ms double, title string, author string, media_kind string, tag_count bigint, detail_count bigint, token_count bigint, error string"
URL_ITEM_FIELDS = RUN_ITEM.split(", ")
RUN = f"tag string, timestamp string, total_items bigint, successful_items bigint, success_rate_pct double, avg_extraction_ms double, avg_total_ms double, p95_total_ms double, items array<struct<{', '.join(f.replace(' ', ':', 1) for f in RUN_ITEM.split(', '))}>>"
REJECT = "url string, page_type string, status string, http_code bigint, error string, validated_at string"


def first_existing(spark: SparkSession, paths: list[str | None]) -> str:
    """The first of the paths that is there."""
    for path in filter(None, paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(f"none of {paths} exists")


def read_urls(spark: SparkSession, path: str | list[str | None]) -> DataFrame:
    """A JSON array of URL objects, with the address to use: final, original, normalized, then url.  Of several paths the first that exists."""
    path = path if isinstance(path, str) else first_existing(spark, path)
    rows = spark.read.schema(URL_FIELDS).json(path, multiLine=True)
    some = [F.nullif(F.trim(c), F.lit("")) for c in ("final_url", "original_url", "normalized_url", "url")]
    return rows.withColumn("url", F.coalesce(*some)).filter("url IS NOT NULL").select("id", "platform", "genre", "url")


def read_runs(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark runs of many JSON files and their items; a file that cannot be read is left out."""
    runs = spark.read.schema(RUN).option("multiLine", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).json(pattern).filter("tag IS NOT NULL")
    return runs.drop("items"), runs.select("tag", F.inline("items"))


def read_run_files(spark: SparkSession, pattern: str, corrupt: str = "skip") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, their items, and the files that hold no run (path, bytes), of many files of one run each, read by whichever task.

    corrupt: ``skip`` leaves such files out, ``fail`` stops the reading of runs with the first one's name.
    """
    if corrupt not in ("skip", "fail"):
        raise ValueError("corrupt is 'skip' or 'fail'")
    files = spark.read.format("binaryFile").load(pattern).select("path", "length", "content")
    parsed = files.select("path", "length", F.from_json(F.decode("content", "UTF-8"), RUN).alias("run"))
    whole = F.col("run.tag").isNotNull()
    bad = parsed.filter(~whole | F.col("run").isNull()).select("path", F.col("length").alias("bytes"))
    if corrupt == "fail":
        parsed = parsed.withColumn("run", F.when(whole, F.col("run")).otherwise(F.raise_error(F.concat(F.lit("not a run: "), "path")).cast(parsed.schema["run"].dataType)))
    runs = parsed.filter("run.tag IS NOT NULL").select("run.*")
    return runs.drop("items"), runs.select("tag", F.inline("items")), bad


def write_runs(runs: DataFrame, items: DataFrame, path: str) -> None:
    """Writes each run (tag and its numbers) with its items (tag and theirs) as a file of JSON, in a folder of its own.

    Written again, a run replaces its own folder and no other.
    """
    fields = [f.split(" ")[0] for f in URL_ITEM_FIELDS]
    mine = items.groupBy("tag").agg(F.sort_array(F.collect_list(F.struct(*[c for c in fields if c in items.columns]))).alias("items"))
    rows = runs.join(mine, "tag", "left").select("tag", F.to_json(F.struct(*runs.columns, "items")).alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag").text(path)


def write_ledger(lines: DataFrame, order: str, columns: list[str], path: str) -> None:
    """Writes a ledger of runs (one row a run) as one Markdown table, replacing what is there."""
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    spark = lines.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit("").alias("at"), row([F.lit(c) for c in columns]).alias("value"))
    rule = spark.range(1).select(F.lit(1).alias("part"), F.lit("").alias("at"), row([F.lit("---") for _ in columns]).alias("value"))
    body = lines.select(F.lit(2).alias("part"), F.col(order).cast("string").alias("at"), row([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
    head.unionByName(rule).unionByName(body).coalesce(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REJECT).json(path)


def read_report_csv(spark: SparkSession, path: str, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """A report with a header; spaces and signs in names become underscores, embedded JSON a variant (null where
    it is none, the raw text stays in <name>_raw)."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = [c for c in df.columns]
    import re

    df = df.toDF(*[re.sub(r"\W+", "_", c).strip("_").lower() for c in names])
    for c in json_columns:
        df = df.withColumns({f"{c}_raw": F.col(c), c: F.try_parse_json(c)})
    return df


def taxonomy(spark: SparkSession, tree: dict) -> tuple[DataFrame, DataFrame]:
    """Two small dimension tables of a parsed taxonomy: (platform, domain_pattern), (platform, page_type, url_pattern)."""
    domains, pages = [], []
    for platform, p in (tree.get("platforms") or {}).items():
        domains += [(platform, d) for d in p.get("domain_patterns") or []]
        for kind, t in (p.get("page_types") or {}).items():
            pages += [(platform, kind, u) for u in t.get("url_patterns") or []]
    return spark.createDataFrame(domains, "platform string, domain_pattern string"), spark.createDataFrame(pages, "platform string, page_type string, url_pattern string")
