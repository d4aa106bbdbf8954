"""Stored vectors: blocks of numbers, partitioned by model and dimension.

A search compares a query with the vectors of one model and dimension.  They are a folder of their own, so other vectors are not
read; a row is a block of some thousand vectors as one piece of bytes with their inverse lengths, which a
task multiplies with the query at once.  A signature's vectors are range-partitioned by key, so a large one is many files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.retrieval import Nearest, _unit, best_chunk

BLOCK = 1024


def _schema(key: str) -> str:
    return f"block string, keys array<{key}>, chunks array<bigint>, numbers binary, inverse array<double>, model string, dim int"


def write_blocks(vectors: DataFrame, path: str, key: str, chunk: str, model: str = "model", column: str = "embedding", block: int = BLOCK, mode: str = "overwrite") -> None:
    """Writes vectors (key, chunk, model and an array of numbers) as blocks; those without numbers, or with nulls, are left out.

    ``append`` adds blocks of new vectors; the numbers are kept as 32-bit floats.
    """
    import numpy as np
    import pyarrow as pa

    kind = dict(vectors.dtypes)[key]
    numbers = F.col(column).cast("array<float>")
    rows = vectors.select(F.col(key).alias("key"), F.col(chunk).cast("long").alias("chunk"), F.col(model).cast("string").alias("model"), F.size(numbers).alias("dim"), numbers.alias("v"))
    rows = rows.filter((F.col("dim") > 0) & F.col("model").isNotNull() & ~F.exists("v", F.isnull))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "model", "dim", "key", "chunk").sortWithinPartitions("model", "dim", "key", "chunk")

    def packed(part: pa.Table) -> pa.RecordBatch:
        dim = part["dim"][0].as_py()
        m = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dim)
        length = np.linalg.norm(m.astype(np.float64), axis=1)
        lists = lambda a: pa.ListArray.from_arrays([0, len(a)], a)
        columns = [pa.array([uuid.uuid4().hex]), lists(part["key"].combine_chunks()), lists(part["chunk"].combine_chunks()), pa.array([m.tobytes()], pa.binary()), lists(pa.array(1 / np.where(length == 0, 1, length)))]
        return pa.RecordBatch.from_arrays([*columns, part["model"].combine_chunks().slice(0, 1), pa.array([dim], pa.int32())], names=["block", "keys", "chunks", "numbers", "inverse", "model", "dim"])

    def run(batches):
        held, signature = [], None

        def out(all_of: bool):
            table = pa.Table.from_batches(held)
            whole = len(table) if all_of else len(table) - len(table) % block
            for k in range(0, whole, block):
                yield packed(table.slice(k, min(block, whole - k)))
            held[:] = table.slice(whole).to_batches()

        for batch in batches:
            of = np.array(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())), dtype=object).reshape(-1, 2)
            cuts = [0, *(k for k in range(1, len(of)) if tuple(of[k]) != tuple(of[k - 1])), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if tuple(of[a]) != signature and held:
                        yield from out(True)
                    signature = tuple(of[a])
                    held.append(batch.slice(a, b - a))
                    if sum(len(x) for x in held) >= block:
                        yield from out(False)
        if held:
            yield from out(True)

    rows.mapInArrow(run, _schema(kind)).write.partitionBy("model", "dim").mode(mode).parquet(path)


def read_blocks(spark: SparkSession, path: str, model: str, dim: int, key: str = "string") -> DataFrame:
    """The blocks of one model and dimension; no other folder is read.  key: the type of the keys."""
    return spark.read.schema(_schema(key)).parquet(path).filter((F.col("model") == model) & (F.col("dim") == dim))


def signatures(spark: SparkSession, path: str, key: str = "string") -> DataFrame:
    """model, dim, vectors: what is stored, from the blocks' sizes."""
    stored = spark.read.schema(_schema(key)).parquet(path)
    return stored.groupBy("model", "dim").agg(F.sum(F.size("inverse")).alias("vectors"))


def search_blocks(blocks: DataFrame, query: list[float], limit: int, key: str = "key", chunk: str = "chunk", allowed: DataFrame | None = None) -> DataFrame:
    """(key, sim, chunk) of the nearest documents by cosine similarity; a task sends ``limit`` rows at most.

    With allowed (a column named like key) others are passed over before they are ranked.
    """
    import numpy as np
    import pyarrow as pa

    q, kind = _unit(query), dict(blocks.dtypes)["keys"][6:-1]
    if allowed is not None:
        # only keys are joined, never the numbers: a block learns which of its vectors may be found
        spots = blocks.select("block", F.posexplode("keys").alias("at", "k"))
        spots = spots.join(allowed.select(F.col(key).alias("k")).distinct(), "k", "left_semi").groupBy("block").agg(F.collect_set("at").alias("open"))
        blocks = blocks.join(spots, "block")
        columns = ["keys", "chunks", "numbers", "inverse", "open"]
    else:
        columns = ["keys", "chunks", "numbers", "inverse"]

    def run(batches):
        best = Nearest(limit)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, chunks, inverse = (batch.column(k)[i].values for k in (0, 1, 3))
                m = np.frombuffer(batch.column(2)[i].as_py(), "<f4").reshape(len(keys), -1)
                sim = (m.astype(np.float64) @ q) * inverse.to_numpy() if m.shape[1] == len(q) else np.full(len(keys), np.nan)
                if len(columns) > 4:
                    shut = np.ones(len(keys), bool)
                    shut[batch.column(4)[i].values.to_numpy()] = False
                    sim[shut] = np.nan
                best.add(keys, chunks, sim)
        yield from best.batches()

    found = blocks.select(*columns).mapInArrow(run, f"key {kind}, sim double, chunk long")
    found = best_chunk(found, "key", "chunk").orderBy(F.desc("sim"), F.asc("key")).limit(limit)
    return found.withColumnsRenamed({"key": key, "chunk": chunk})
