"""Keyed tables: upsert, replace, cascade delete, change detection, backfill, and their sinks.

Tables are immutable; each change is a plan over the old table and the change.  Keys meet by
hash joins or one aggregate, so the cost is a shuffle of the two sides.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, key: str | list[str], version: list[str]) -> DataFrame:
    """The row with the highest version of each key: a partial aggregate, no sort of a key's rows."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*version))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, version: str = "updated_at", created: str = "created_at") -> DataFrame:
    """old with new's rows put over it; a key keeps its first creation time."""
    rows = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rest = [c for c in old.columns if c not in (key, created)]
    out = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_side", version)).alias("_r"), F.min(created).alias(created))
    return out.select(*[F.col(c) if c in (key, created) else F.col(f"_r.{c}") for c in old.columns])


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All child rows of new's keys replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def tag_rows(enriched: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    """(key, tag, position), a tag once, at its first position."""
    return enriched.select(key, F.posexplode(tags).alias("position", "tag")).groupBy(key, "tag").agg(F.min("position").alias("position"))


def forget(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the keys to forget, so that none comes back from another."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def existed(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """(key, existed) of each key to forget."""
    return gone.select(key).distinct().join(store.select(key, F.lit(True).alias("existed")).dropDuplicates([key]), key, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def changed(current: DataFrame, stored: DataFrame, key: str, fingerprint: str = "source_hash", force: bool = False) -> DataFrame:
    """Rows whose fingerprint is new or differs from the stored one."""
    return current if force else current.join(stored.select(key, fingerprint), [key, fingerprint], "left_anti")


def is_current(enriched: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wanted rows whose (key, source_hash, prompt_version) is stored: they need no new call."""
    return wanted.join(enriched.select(key, "source_hash", "prompt_version"), [key, "source_hash", "prompt_version"], "left_semi")


def backfill(envelopes: DataFrame, enriched: DataFrame, key: str, limit: int, order: Column, degraded_most: int = 500) -> DataFrame:
    """The first ``limit`` rows in scan order that are stale or degraded, among limit * 4 rows scanned."""
    scanned = envelopes.withColumn("_o", order).orderBy("_o", key).limit(limit * 4)
    fresh = scanned.join(enriched.select(key, "source_hash", "prompt_version"), [key, "source_hash", "prompt_version"], "left_semi").select(key, F.lit(True).alias("_fresh"))
    poor = enriched.filter("degraded").select(key, F.lit(True).alias("_poor")).orderBy(key).limit(degraded_most)
    marked = scanned.join(fresh, key, "left").join(poor, key, "left")
    return marked.filter("_fresh IS NULL OR _poor").orderBy("_o", key).limit(limit).drop("_o", "_fresh", "_poor")


def may_rewrite(changes: DataFrame, vectors: DataFrame, key: str, can_embed: bool) -> DataFrame:
    """Changed rows whose chunks may be replaced: without an embedder, only those that have no vectors to lose."""
    return changes if can_embed else changes.join(vectors.select(key).distinct(), key, "left_anti")


def with_defaults(df: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """df with missing columns added; schema maps a column to its type and default."""
    for name, (kind, default) in schema.items():
        value = F.lit(default).cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def partial_update(old: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """old with the non-null columns of updates put in: a null leaves a value, it never clears one."""
    mine = updates.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in updates.columns if c != key])
    joined = old.join(mine, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c != key and c in updates.columns else F.col(c) for c in old.columns])


def open_jobs(jobs: DataFrame, done: tuple[str, ...] = ("ready", "failed")) -> DataFrame:
    """Jobs that are still under way; the finished ones are cleared."""
    return jobs.filter(~F.col("status").isin(*done))


def interrupted(jobs: DataFrame, reason: str = "interrupted") -> DataFrame:
    """Jobs as a restart finds them: what was queued or running has failed."""
    cut = F.col("status").isin("queued", "running")
    return jobs.withColumns({"error": F.when(cut, F.lit(reason)).otherwise(F.col("error")), "status": F.when(cut, "failed").otherwise(F.col("status"))})


def first_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group (the window is pruned by WindowGroupLimit before the shuffle)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of a listing."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, order: list[tuple[str, bool]], limit: int, after: tuple | None = None) -> DataFrame:
    """The page of a listing that follows a row: (column, descending) pairs that tell rows apart, and that row's values in them.

    Rows before it are filtered out in the scan and none are sorted to be skipped, so each page of a long listing costs the
    same.  Nulls come first in ascending columns and last in descending ones.
    """
    rows = df
    if after is not None:
        follows, same = F.lit(False), F.lit(True)
        for (name, down), value in zip(order, after):
            c = F.col(name)
            if value is None:
                further = F.lit(False) if down else c.isNotNull()
            else:
                further = (c < F.lit(value)) | c.isNull() if down else c > F.lit(value)
            follows = follows | (same & F.coalesce(further, F.lit(False)))
            same = same & c.eqNullSafe(F.lit(value))
        rows = df.filter(follows)
    return rows.orderBy(*[F.desc(n) if down else F.asc(n) for n, down in order]).limit(limit)


class Table:
    """A table in hash buckets of its key, in versioned folders.

    A change reads and writes the buckets that it touches, nothing else; an append adds a folder to the buckets it
    has rows for, and many appends are folded into one folder when their bucket is next changed.  A version is a
    small file that names the folders of every bucket.  It is created and never overwritten: of two writers that
    begin from one version the second fails.  Folders that no version names any more go with ``vacuum``.
    The number of buckets is the table's own from its first version on.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "url_hash", buckets: int = 16, order: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, list(order)
        self._asked, self._last = buckets, ("", {})

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._at(*parts)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _versions(self) -> list[str]:
        return [n for n in self._names("_versions") if n.endswith(".json")]

    def _state(self, name: str | None = None) -> dict[int, list[str]]:
        """Bucket -> folders of a version, the newest by default."""
        return {int(b): folders for b, folders in self._content(name).get("folders", {}).items()}

    def _content(self, name: str | None = None) -> dict:
        names = [name] if name else self._versions()[-1:]
        if not names:
            return {}
        if self._last[0] != names[0]:  # a version never changes
            fs, path = self._at("_versions", names[0])
            stream = fs.open(path)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            self._last = (names[0], json.loads(text))
        return self._last[1]

    @property
    def buckets(self) -> int:
        return self._content().get("buckets", self._asked)

    def _commit(self, state: dict[int, list[str]], after: int) -> None:
        fs, path = self._at("_versions", f"{after + 1:08d}.json")
        content = {"buckets": self.buckets, "folders": {str(b): f for b, f in sorted(state.items()) if f}}
        out = fs.create(path, False)  # fails if another writer was faster
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> tuple[str, list[int]]:
        """A new folder with df's rows, and the buckets it has."""
        folder = f"v-{uuid.uuid4().hex}"
        rows = df.withColumn("_b", self._bucket()).hint("rebalance", "_b")
        rows.sortWithinPartitions("_b", *self.order).write.partitionBy("_b").parquet(f"{self.path}/{folder}")
        return folder, [int(n[3:]) for n in self._names(folder) if n.startswith("_b=")]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest version, or some buckets of it; an empty table before the first."""
        paths = [f"{self.path}/{f}/_b={b}" for b, folders in self._state().items() if buckets is None or b in buckets for f in folders]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, keys: DataFrame, make) -> DataFrame:
        """make(old rows of the buckets that keys touch) in their place."""
        touched = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # as many as there are buckets
        if not touched:
            return self.read()
        after, state = len(self._versions()), self._state()
        folder, present = self._write(make(self.read(touched)).select(*self.read().columns))
        state |= {b: [folder] if b in present else [] for b in touched}
        self._commit(state, after)
        return self.read()

    def append(self, df: DataFrame) -> DataFrame:
        """More rows; nothing is rewritten."""
        after, state = len(self._versions()), self._state()
        folder, present = self._write(df.select(*self.read().columns))
        for b in present:
            state[b] = [*state.get(b, []), folder]
        self._commit(state, after)
        return self.read()

    def upsert(self, new: DataFrame, **kw) -> DataFrame:
        return self.change(new, lambda old: upsert(old, new, self.key, **kw))

    def replace(self, new: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """All rows of keys (by default new's) replaced by new's."""
        keys = new if keys is None else keys
        return self.change(keys, lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti").unionByName(new.select(*old.columns)))

    def forget(self, gone: DataFrame) -> DataFrame:
        return self.change(gone, lambda old: old.join(gone.select(self.key), self.key, "left_anti"))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that the last versions do not name; how many."""
        names = self._versions()
        named = {f for n in names[-keep:] for folders in self._state(n).values() for f in folders}
        gone = [n for n in self._names() if n.startswith("v-") and n not in named]
        for name in gone:
            fs, path = self._at(name)
            fs.delete(path, True)
        return len(gone)


def write_report_csv(df: DataFrame, path: str, passed: str = "success") -> None:
    """A CSV report with PASS or FAIL and without line ends inside cells."""
    flat = [F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if k == "string" else F.col(c) for c, k in df.dtypes if c != passed]
    df.select(F.when(F.col(passed), "PASS").otherwise("FAIL").alias("outcome"), *flat).write.mode("overwrite").csv(path, header=True)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_text(spark, text: str, folder: str) -> None:
    """Writes one text as the only file of a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(folder)
