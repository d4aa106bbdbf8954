"""The corpus pipeline: five stages over documents, each stage's rows written and read again.

Toxic documents go; lines found in many documents go from all of them; one document
of each near-duplicate class stays; documents that hold a passage of the benchmark go; what is left is
packed.  Every stage works on all rows of the one before.  The stages but the last return the columns that they got, of
whatever names and in their order; where there is an ``n_chars`` it is kept true to the text.

For all stages: an empty table gives an empty table; rows with a null id or a null in any other column pass like others; the
order of rows says nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import checkpoint_root
from larder.llm.queries import tokenizer_path


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns but doc_id and text renamed, so that none has the name of an operator's; and their own names."""
    names = {f"__column{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed({c: k for k, c in names.items()}), names


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts toxic.

    Null and empty texts have no words and stay; of repeated rows one teaches and all are judged alike; a score of exactly
    one half is toxic; very long texts are judged whole.
    """
    from larder.llm.toxicity import score, train

    mine, names = _apart(docs)
    model = train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(mine, model).filter("predicted = 0").select(*mine.columns).withColumnsRenamed(names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines whose key is in ten documents or more; documents stay, if empty.

    A null text stays null and counts as one empty line, which no key matches; repeated rows (one id and text) are one
    document; very long texts lose lines like others.
    """
    from larder.llm.lines import dedup_lines

    mine, names = _apart(docs)
    out = dedup_lines(mine, min_docs=10, min_chars=1, keep="none")
    for mark, name in names.items():
        if name == "n_chars":
            out = out.withColumn(mark, F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(F.col(mark)))
    return out.select(*mine.columns).withColumnsRenamed(names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: word shingles of five, similarity 0.8 or more.

    The row with the least id stays, of equal ids the one whose text's hash is least; repeated rows are copies; null and
    empty texts are copies of each other; very long texts are compared whole.
    """
    from larder.llm.jaccard import keep_one

    return keep_one(docs, n=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a test item.

    Null and empty texts hold none and stay; of repeated rows all go or all stay; very long texts are searched whole; a score of
    exactly the threshold is a passage.
    """
    from larder.llm.decontaminate import drop_leaking

    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into power-of-two sequences.

    A null or empty text gives its end token alone; repeated rows are packed each; very long texts give many full sequences.
    """
    from larder.llm.packing import pack

    out = pack(docs.select("doc_id", "text"), tokenizer_path(), limit=4096, end_id=2, keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: A trained classifier and a tokenizer stand in the way of SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the shared folder as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_root(spark)}/larder/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}-{name}")
    return docs
