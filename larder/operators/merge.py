"""Merging partial records: the fallback cascade, placeholders, priority unions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def set_value(column: str, dtype: str) -> Column:
    """The column, null where it counts as empty: null, an empty text or an empty array (zero and false are set)."""
    c = F.col(column)
    if dtype == "string":
        return F.nullif(c, F.lit(""))
    if dtype.startswith(("array", "map")):
        return F.when(F.size(c) > 0, c)
    return c


def merged(new: DataFrame, old: DataFrame, key: str, newest_only: tuple[str, ...] = ()) -> DataFrame:
    """new with its empty columns filled from old; columns in newest_only are never filled."""
    kinds = dict(new.dtypes)
    prior = old.select(F.col(key), *[set_value(c, kinds[c]).alias(f"_old_{c}") for c in new.columns if c != key and c not in newest_only])
    joined = new.join(prior, key, "left")
    return joined.select(key, *[F.col(c) if c in newest_only else F.coalesce(set_value(c, kinds[c]), F.col(f"_old_{c}"), F.col(c)).alias(c) for c in new.columns if c != key])


def cascade(candidates: DataFrame, key: str, rank: str, partial: Column, fill: list[str], newest: list[str]) -> DataFrame:
    """One row a key from its tiers' candidates.

    Tiers run in the order of rank and stop at the first candidate that is not partial.  Of those
    that ran, the later tier wins, an earlier one fills what it leaves empty; ``newest`` columns come from the
    last tier that ran.  ``stopped`` says whether a full candidate ended the run.  One window and one
    partial aggregate over the same key: a single shuffle.
    """
    kinds = dict(candidates.dtypes)
    w = Window.partitionBy(key)
    full = F.min(F.when(~partial, F.col(rank))).over(w)
    ran = candidates.withColumn("_stop", full).filter(F.col("_stop").isNull() | (F.col(rank) <= F.col("_stop")))
    last = [F.max_by(set_value(c, kinds[c]), F.when(set_value(c, kinds[c]).isNotNull(), F.col(rank))).alias(c) for c in fill]
    return ran.groupBy(key).agg(*last, *[F.max_by(c, rank).alias(c) for c in newest], F.count("*").alias("tiers_run"), F.max(F.col("_stop").isNotNull()).alias("stopped"))


def attempts(inputs: DataFrame, candidates: DataFrame, key: str, rank: str, tiers: list[int], partial: Column) -> DataFrame:
    """A row for each key and tier up to the stop: ok, or skipped where the tier did not apply."""
    stop = candidates.groupBy(key).agg(F.min(F.when(~partial, F.col(rank))).alias("_stop"))
    grid = inputs.select(key).distinct().withColumn(rank, F.explode(F.lit(tiers)))
    met = grid.join(candidates.select(key, rank, F.lit(True).alias("ok")), [key, rank], "left").join(stop, key, "left")
    ran = met.filter(F.col("_stop").isNull() | (F.col(rank) <= F.col("_stop")))
    return ran.select(key, rank, F.coalesce("ok", F.lit(False)).alias("ok"), F.col("ok").isNull().alias("skipped"))


@dataclass(frozen=True)
class Tier:
    """A way to get a record: from rows with a key and what the tier reads to rows with the key and record columns.

    ``applies`` says which rows it is for.  A tier that is not available is skipped, with the reason.
    """

    name: str
    extract: Callable[[DataFrame], DataFrame]
    applies: Column | None = None
    available: bool = True
    reason: str | None = None


def run_cascade(inputs: DataFrame, tiers: list[Tier], key: str, prepare, partial: Column, why: Column, keep) -> tuple[DataFrame | None, DataFrame]:
    """The candidates of the tiers that ran (with rank and partial) and an attempt for each key and tier reached.

    Tiers run in order; a key leaves after its first candidate that is not partial.  ``prepare`` brings a tier's rows into
    the candidates' shape (rows that say nothing are left out), ``why`` is the reason noted with a partial one, and
    ``keep`` stores a table, so that an extraction runs once.  A tier that fails costs only itself: its rows go on.
    """
    waiting, candidates, tries = inputs, [], []

    def tried(rows: DataFrame, tier: str, ok: bool, skipped: bool, reason) -> None:
        told = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
        tries.append(rows.select(key, F.lit(tier).alias("tier"), F.lit(ok).alias("ok"), F.lit(skipped).alias("skipped"), told.alias("error")))

    for rank, tier in enumerate(tiers):
        if not tier.available:
            tried(waiting, tier.name, False, True, tier.reason)
            continue
        mine = waiting
        if tier.applies is not None:
            fits = F.coalesce(tier.applies, F.lit(False))
            tried(waiting.filter(~fits), tier.name, False, True, "not applicable to this target")
            mine = waiting.filter(fits)
            if mine.isEmpty():
                continue
        try:
            made = keep(prepare(tier.extract(mine), mine).withColumns({"rank": F.lit(rank), "tier": F.lit(tier.name), "partial": partial, "why": why}))
        except Exception as failure:  # whatever an injected extractor does, the next tier goes on
            tried(mine, tier.name, False, False, f"{type(failure).__name__}: {str(failure)[:200]}")
            continue
        tried(made, tier.name, True, False, F.when(F.col("partial"), F.col("why")))
        tried(mine.join(made.select(key), key, "left_anti"), tier.name, False, False, "no usable content")
        candidates.append(made)
        waiting = waiting.join(made.filter("NOT partial").select(key), key, "left_anti")
    every = reduce(DataFrame.unionByName, candidates) if candidates else None
    return every, reduce(DataFrame.unionByName, tries)


def first_filled(frames: list[tuple[str, DataFrame]], key: str, columns: list[str], unset: dict[str, str] | None = None) -> DataFrame:
    """key, columns and notes: of each column the first filled value, in the order of the frames; one shuffle.

    notes has the names of the frames that have the key, joined; ``unset`` names values that count as empty.
    """
    rows = []
    for rank, (note, df) in enumerate(frames):
        kinds = dict(df.dtypes)
        some = [set_value(c, kinds[c]).alias(c) if c in kinds else F.lit(None).alias(c) for c in columns]
        rows.append(df.select(key, F.lit(rank).alias("_rank"), F.lit(note).alias("_note"), *some))
    every = reduce(lambda a, b: a.unionByName(b), rows)
    for c, value in (unset or {}).items():
        every = every.withColumn(c, F.nullif(F.col(c), F.lit(value)))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in columns]
    notes = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_rank", "_note"))), lambda x: x["_note"]), " + ")
    return every.groupBy(key).agg(*first, notes.alias("notes"))


def with_placeholders(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """A row for each input: its result, or a degraded placeholder so that nothing is lost."""
    joined = inputs.select(key).distinct().join(results.withColumn("_found", F.lit(True)), key, "left")
    degraded = F.col("_found").isNull() if "degraded" not in results.columns else F.col("_found").isNull() | F.coalesce("degraded", F.lit(False))
    return joined.withColumn("degraded", degraded).drop("_found")


def not_cached(inputs: DataFrame, store: DataFrame, key: str, retry_degraded: bool = False) -> DataFrame:
    """Inputs that the store does not answer already."""
    known = store.filter(~F.col("degraded")) if retry_degraded else store
    return inputs.join(known.select(key), key, "left_anti")


def by_priority(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, one a key, from the first source that has it."""
    rows = reduce(DataFrame.unionByName, [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)])
    w = Window.partitionBy(key).orderBy("_p")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_p", "_r")


def first_provider(providers: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Result and name of the first provider that has a result."""
    name = reduce(lambda acc, p: acc.when(p[1].isNotNull(), F.lit(p[0])), providers[1:], F.when(providers[0][1].isNotNull(), F.lit(providers[0][0])))
    return F.coalesce(*[c for _, c in providers]), name


def fold_repeats(lines: Column) -> Column:
    """Lines without those that the last kept line contains."""
    keep = lambda acc, x: F.when((F.size(acc) > 0) & F.element_at(acc, -1).contains(x), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(lines, F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(keep(acc, x)))
