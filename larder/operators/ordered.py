"""Running totals and runs along an order, for keys of any size.

A window over a key's whole history is one task.  Here the rows are range-partitioned by (key, order) into slabs, written once,
and every total has two levels: inside a slab by a window, and between a key's slabs by a carry, which has one row a key and
slab.  A key with most of the rows lies in most of the slabs, and no task holds more than a slab.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.session import settled

SLAB = "_slab"


def slabs(df: DataFrame, by: str, order: list[str], n: int | None = None) -> DataFrame:
    """df with _slab, its rows' range of (by, order); written once, since ranges come from a sample."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(n, by, *order).withColumn(SLAB, F.spark_partition_id()), "slabs")


def _inside(by: str, order: list[str]):
    return Window.partitionBy(by, SLAB).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _before(by: str):
    return Window.partitionBy(by).orderBy(SLAB).rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, carry: DataFrame, by: str) -> DataFrame:
    carry = carry.withColumnsRenamed({by: "_carry_by", SLAB: "_carry_slab"})
    return rows.join(carry, (F.col(SLAB) == F.col("_carry_slab")) & F.col(by).eqNullSafe(F.col("_carry_by"))).drop("_carry_by", "_carry_slab")


def running_sums(df: DataFrame, by: str, order: list[str], sums: dict[str, Column], n: int | None = None) -> DataFrame:
    """df with the running sum of each named expression, from a key's first row to this one.

    order names columns that tell a key's rows apart; a null key is a key like others; nulls add nothing.
    """
    values = {f"_value_{k}": F.coalesce(c, F.lit(0)) for k, c in sums.items()}
    rows = slabs(df.withColumns(values), by, order, n)
    total = rows.groupBy(by, SLAB).agg(*[F.sum(f"_value_{k}").alias(f"_total_{k}") for k in sums])
    carry = total.select(by, SLAB, *[F.coalesce(F.sum(f"_total_{k}").over(_before(by)), F.lit(0)).alias(f"_carry_{k}") for k in sums])
    rows = rows.withColumns({f"_sum_{k}": F.sum(f"_value_{k}").over(_inside(by, order)) for k in sums})
    out = _carried(rows, carry, by).withColumns({k: F.col(f"_sum_{k}") + F.col(f"_carry_{k}") for k in sums})
    return out.select(*[c for c in df.columns if c not in sums], *sums)


def runs(df: DataFrame, by: str, order: list[str], inside: Column, name: str, n: int | None = None) -> DataFrame:
    """df with ``name``: how many rows of a key up to this one stand in a run in which ``inside`` holds (0 where it does not).

    A run's length is the count of such rows less that count at the last row outside; the latter is a running maximum, so
    both have a carry between slabs.
    """
    rows = slabs(df.withColumn("_in", F.coalesce(inside, F.lit(False)).cast("long")), by, order, n)
    rows = rows.withColumn("_count", F.sum("_in").over(_inside(by, order)))
    rows = rows.withColumn("_left", F.max(F.when(F.col("_in") == 0, F.col("_count"))).over(_inside(by, order)))
    ends = rows.groupBy(by, SLAB).agg(F.sum("_in").alias("_all"), F.max("_left").alias("_last"))
    ends = ends.withColumn("_carry_count", F.coalesce(F.sum("_all").over(_before(by)), F.lit(0)))
    carry = ends.select(by, SLAB, "_carry_count", F.coalesce(F.max(F.col("_carry_count") + F.col("_last")).over(_before(by)), F.lit(0)).alias("_carry_left"))
    out = _carried(rows, carry, by)
    here = F.col("_carry_count") + F.col("_count") - F.coalesce(F.col("_carry_count") + F.col("_left"), F.col("_carry_left"))
    return out.withColumn(name, here).select(*[c for c in df.columns if c != name], name)
