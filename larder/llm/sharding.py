"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are range-partitioned by id and sorted; each partition numbers its rows and sums up their bytes;
prefix sums over the partitions' totals place every row on one line, which is cut at equal targets.
A row goes where its middle lies, so a shard misses its target by a row's size at most.

Texts are measured once and never moved: what is shuffled and stored has three numbers a row.  One pass
through Python adds up sizes within a partition; all else is plain expressions.  What is broadcast has a row
for each partition (their number is a setting) and a row for each shard.

Defined results: null texts count as no bytes, null ids come first, ties and repeated
rows are ordered by checksum and size; very long texts are rows like others (a shard holds at least one row's
middle or none); more shards than rows leave shards empty; an empty table gives an empty result; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import table

_ROW = "doc_id long, size long, text_crc32 long"


def _numbered(batches):
    """Rows of a sorted partition with its number, their position in it and the bytes up to their end."""
    pid, rows, end = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        ends = end + np.cumsum(batch.column("size").to_numpy())
        columns = [pa.array(np.full(n, pid, dtype=np.int32)), pa.array(rows + np.arange(n)), pa.array(ends)]
        rows, end = rows + n, int(ends[-1]) if n else end
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "pid", "row", "ends"])


def shard_by_bytes(docs: DataFrame, shards: int, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in a shard) for every row of docs."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    sized = table(sized, "sizes")  # range partitioning reads its input twice: that shall not be the texts
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "size"]
    ranged = sized.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = table(ranged.mapInArrow(_numbered, f"{_ROW}, pid int, row long, ends long"), "ranges")

    totals = sorted(tuple(r) for r in rows.groupBy("pid").agg(F.max("ends"), F.max("row") + 1).collect())
    total = sum(bytes_ for _, bytes_, _ in totals)
    begins = accumulate((b for _, b, _ in totals), initial=0)
    first_rows = accumulate((r for _, _, r in totals), initial=0)
    bases = spark.createDataFrame([(p, b, r) for (p, *_), b, r in zip(totals, begins, first_rows)], "pid int, begin long, first_row long")

    middle = F.col("begin") + F.col("ends") - F.expr("(size + 1) div 2")
    wide = "long" if total * shards < 1 << 62 else "decimal(38,0)"
    share = F.expr(f"cast(middle as {wide}) * {shards} div {max(total, 1)}")
    placed = rows.join(F.broadcast(bases), "pid").withColumns({"middle": middle, "number": F.col("first_row") + F.col("row")})
    placed = placed.withColumn("shard", F.least(share, F.lit(shards - 1)).cast("int"))
    heads = placed.groupBy("shard").agg(F.min("number").alias("head"))
    return placed.join(F.broadcast(heads), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("number") - F.col("head")).alias("slot"))
