"""Operational aggregates: tiers, library, cost, tags, benchmark runs, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.session import settled


def tier_stats(attempts: DataFrame, order: list[str]) -> DataFrame:
    """By tier: attempts, wins, skips, ran, success_rate (null if none ran), avg_ms (whole; null for none or zero), tier_rank."""
    ran = ~F.col("skipped")
    out = attempts.groupBy("tier").agg(
        F.count("*").alias("attempts"), F.sum(F.col("ok").cast("long")).alias("wins"), F.sum(F.col("skipped").cast("long")).alias("skips"), F.avg(F.when(ran, F.col("duration_ms"))).alias("mean")
    )
    place = F.array_position(F.lit(order), F.col("tier"))
    return out.select(
        "tier", "attempts", "wins", "skips", (F.col("attempts") - F.col("skips")).alias("ran"),
        F.try_divide(F.col("wins"), F.col("attempts") - F.col("skips")).alias("success_rate"),
        F.nullif(F.floor("mean").cast("long"), F.lit(0)).alias("avg_ms"),
        F.when(place > 0, place - 1).otherwise(F.lit(99)).cast("int").alias("tier_rank"),
    )


def library_summary(docs: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """Counts over all, and by each column, in one pass: facet, value, items, flagged."""
    view = docs.select(*by, flag.cast("long").alias("_f"))
    grouped = view.groupingSets([[], *[[c] for c in by]], *by).agg(F.count("*").alias("items"), F.sum("_f").alias("flagged"), F.grouping_id().alias("_g"))
    facet, value = F.lit("total"), F.lit(None).cast("string")
    full = (1 << len(by)) - 1
    for i, c in enumerate(by):
        here = F.col("_g") == full - (1 << (len(by) - 1 - i))
        facet, value = F.when(here, F.lit(c)).otherwise(facet), F.when(here, F.col(c)).otherwise(value)
    return grouped.select(facet.alias("facet"), value.alias("value"), "items", "flagged")


def cost_summary(enriched: DataFrame, by: str | None = None) -> DataFrame:
    """Items, cost, tokens and mean cost, in all or by a column (null: none)."""
    aggs = [F.count("*").alias("items"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.round(F.coalesce(F.try_divide(F.sum("cost_usd"), F.count("*")), F.lit(0.0)), 6).alias("avg_cost_usd")]
    if by is None:
        return enriched.agg(*aggs)
    return enriched.groupBy(F.coalesce(F.col(by), F.lit("none")).alias(by)).agg(*aggs, F.floor(F.avg("duration_ms")).cast("long").alias("avg_ms"))


def top_values(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """The most frequent values: count down, value up."""
    return rows.groupBy(column).agg(F.count("*").alias("items")).orderBy(F.desc("items"), F.asc(column)).limit(limit)


def nearest_rank(values: Column, share: float) -> Column:
    """The value at index int(n * share), the last at most, of the sorted values of a group: an exact pick."""
    sorted_ = F.array_sort(F.collect_list(values))
    n = F.size(sorted_)
    return F.try_element_at(sorted_, F.least(F.floor(n * F.lit(share)).cast("int"), n - 1) + 1)


def nearest_rank_by_window(df: DataFrame, groups: list[str], value: str, share: float) -> DataFrame:
    """The same pick for large groups: ranks from a window, so that no group is gathered into one array."""
    w = Window.partitionBy(*groups)
    ranked = df.filter(F.col(value).isNotNull()).select(*groups, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    at = F.least(F.floor(F.col("_n") * F.lit(share)), F.col("_n") - 1) + 1
    return ranked.filter(F.col("_r") == at).select(*groups, F.col(value).alias("picked"))


def nearest_rank_by_refinement(df: DataFrame, groups: list[str], value: str, share: float, bins: int = 1024, held: int = 100_000) -> DataFrame:
    """The same pick for groups of any size, without sorting them: (groups, picked).

    A group's range of values is cut into bins, the rows are counted by bin inside the tasks, and the bin with the wanted
    rank is the next range, from its least to its greatest value.  A range that holds ``held`` rows or fewer, or one value,
    is picked from directly.  Nulls and NaN are left out.
    """
    v = F.col("_v")
    rows = df.select(*groups, F.col(value).alias("_v")).filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    n = F.count("*")
    state = settled(rows.groupBy(*groups).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), n.alias("n"), (F.least(F.floor(n * F.lit(share)), n - 1) + 1).alias("rank")), "ranks")
    width = F.col("hi").cast("double") - F.col("lo").cast("double")
    wide = (F.col("n") > held) & (width > 0) & (width < float("inf"))
    same = lambda a, b: F.lit(True) if not groups else _all([a[g].eqNullSafe(b[g]) for g in groups])
    while state.filter(wide).limit(1).count():  # each round makes a range some ``bins`` times as narrow
        ranges = state.filter(wide)
        within = rows.join(ranges, same(rows, ranges)).filter(v.between(F.col("lo"), F.col("hi"))).select(*[ranges[g] for g in groups], "_v", "lo", "hi", "rank")
        at = F.least(F.floor((v.cast("double") - F.col("lo").cast("double")) / width * bins), F.lit(bins - 1))
        counts = within.groupBy(*groups, at.alias("bin")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), n.alias("n"), F.first("rank").alias("rank"))
        upto = F.sum("n").over(Window.partitionBy(*groups).orderBy("bin"))
        found = counts.withColumn("_upto", upto).filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("n")))
        found = found.select(*groups, "lo", "hi", "n", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank"))
        state = settled(state.filter(~wide).unionByName(found), "ranks")
    one = state.filter("lo = hi").select(*groups, F.col("lo").alias("picked"))
    few = state.filter("lo <> hi")
    left = rows.join(few, same(rows, few)).filter(v.between(F.col("lo"), F.col("hi"))).select(*[few[g] for g in groups], "_v", "rank")
    left = left.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy("_v"))).filter("_r = rank")
    return one.unionByName(left.select(*groups, F.col("_v").alias("picked")))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def run_summary(items: DataFrame, groups: list[str], success: str, measures: list[str]) -> DataFrame:
    """Items, successes, rate in percent and means over all items (also those without a measure)."""
    n = F.count("*")
    return items.groupBy(*groups).agg(
        n.alias("items"), F.sum(F.col(success).cast("long")).alias("successes"), F.round(F.sum(F.col(success).cast("long")) * 100.0 / n, 4).alias("success_pct"),
        *[F.round(F.coalesce(F.sum(m), F.lit(0.0)) / n, 4).alias(f"avg_{m}") for m in measures],
    )


def most_common(df: DataFrame, groups: list[str], column: str, first: Column) -> DataFrame:
    """The mode of a column by group; of equally frequent values, the one that came first."""
    counts = df.groupBy(*groups, column).agg(F.count("*").alias("_n"), F.min(first).alias("_f"))
    return counts.groupBy(*groups).agg(F.max_by(column, F.struct(F.col("_n"), -F.col("_f"))).alias(column))


def run_delta(runs: DataFrame, order: str, measures: list[str]) -> DataFrame:
    """Each run's difference and change in percent against the first run (runs: one row a run, a handful)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = runs
    for m in measures:
        base = F.first(m).over(w)
        out = out.withColumns({f"{m}_diff": F.round(F.col(m) - base, 4), f"{m}_pct": F.round(F.try_divide((F.col(m) - base) * 100.0, base), 4), f"{m}_sign": F.when(F.col(m) > base, "+").when(F.col(m) < base, "-").otherwise("=")})
    return out


def compare_runs(a: DataFrame, b: DataFrame, key: str, measure: str) -> DataFrame:
    """Two runs side by side, also keys that only one has."""
    left, right = a.select(key, F.col(measure).alias("before")), b.select(key, F.col(measure).alias("after"))
    return left.join(right, key, "full").withColumn("diff", F.round(F.col("after") - F.col("before"), 4))


def corpus_quality(pages: DataFrame, kind: str, domain: str, score: Column) -> DataFrame:
    """By page type: pages, domains, share in percent, mean score."""
    out = pages.groupBy(kind).agg(F.count("*").alias("pages"), F.count_distinct(domain).alias("domains"), F.round(F.avg(score), 4).alias("avg_score"))
    return out.withColumn("share_pct", F.round(F.col("pages") * 100.0 / F.sum("pages").over(Window.partitionBy()), 4))


def extracted(title: Column, caption: Column, article: Column) -> Column:
    """Success of a run's item: any text was found."""
    return F.coalesce(title != "", F.lit(False)) | F.coalesce(caption != "", F.lit(False)) | F.coalesce(article != "", F.lit(False))


def served(status: Column, words: Column, details: Column) -> Column:
    """Success of a live request: answered, with words or details."""
    return F.coalesce((status == 200) & ((F.coalesce(words, F.lit(0)) > 0) | (F.coalesce(details, F.lit(0)) > 0)), F.lit(False))


def processed(words: Column, title: Column) -> Column:
    """Success of a local pipeline's item: words or a title."""
    return (F.coalesce(words, F.lit(0)) > 0) | F.coalesce(title != "", F.lit(False))
