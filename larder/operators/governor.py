"""Rate governing over event tables: trailing windows, pacing states, backoff, hourly caps.

Most traffic may come from one caller, so nothing here needs a caller's history in one task: trailing windows are cut at
minutes with a halo, counters and runs carry totals between ranges, caps are cut at pauses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators.ordered import running_sums, runs

MINUTE, DAY = 60_000_000, 86_400_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _minute(at: str = "_at") -> Column:
    return F.expr(f"({at} - pmod({at}, {MINUTE})) div {MINUTE}")


def _in_minutes(rows: DataFrame, halos: list[Column]) -> DataFrame:
    """Each row in its minute (_kind 0), and without its columns in later ones that look back on it (_kind 1, 2, ...).

    rows: _row, _s (service), _at, _t.  halos: structs of _m, _a.
    """
    own = F.struct(_minute().alias("_m"), F.col("_at").alias("_a"))
    places = F.posexplode(F.array(own, *halos)).alias("_kind", "_place")
    rows = rows.select("_row", "_s", "_t", places)
    return rows.select(F.when(F.col("_kind") == 0, F.col("_row")).alias("_row"), "_s", "_t", "_kind", "_place._m", "_place._a")


def _timed(events: DataFrame, service: str, ts: str, tokens: Column) -> DataFrame:
    return events.select(F.struct("*").alias("_row"), F.col(service).alias("_s"), micros(ts).alias("_at"), F.greatest(tokens, F.lit(0)).cast("double").alias("_t"))


def _next_minute() -> Column:
    return F.struct((_minute() + 1).alias("_m"), F.col("_at").alias("_a"))


def window_metrics(events: DataFrame, service: str, ts: str, tokens: Column) -> DataFrame:
    """events with rpm, tpm, rpd and tpd: requests and tokens of the last 60 seconds and 24 hours, both ends included.

    A task holds a service's minute and its halo, however busy the service: the events of the minute before, for the last
    60 seconds, and those of the same minute a day ago, shifted by a day, for the far end of the 24 hours.  The
    1,439 minutes between come from sums by minute, which are added up by day with the day before.  Events
    without a time have no window (nulls).
    """
    rows = _timed(events, service, ts, tokens)
    timed = rows.filter("_at IS NOT NULL")
    day_later = F.struct((_minute() + DAY // MINUTE).alias("_m"), (F.col("_at") + DAY).alias("_a"))
    of_minute = Window.partitionBy("_s", "_m").orderBy("_a")
    near, head, tail = of_minute.rangeBetween(-MINUTE, 0), of_minute.rangeBetween(Window.unboundedPreceding, 0), of_minute.rangeBetween(0, Window.unboundedFollowing)
    kind = F.col("_kind")
    part = lambda test, x, w: F.coalesce(F.sum(F.when(test, x)).over(w), F.lit(0))
    found = _in_minutes(timed, [_next_minute(), day_later]).select(
        "_row", "_s", "_m", "_kind", part(kind < 2, F.lit(1), near).alias("rpm"), part(kind < 2, F.col("_t"), near).alias("tpm"),
        (part(kind == 0, F.lit(1), head) + part(kind == 2, F.lit(1), tail)).alias("_ends_n"), (part(kind == 0, F.col("_t"), head) + part(kind == 2, F.col("_t"), tail)).alias("_ends_t"),
    ).filter(kind == 0)
    minutes = timed.groupBy("_s", _minute().alias("_m")).agg(F.count("*").alias("_n"), F.sum("_t").alias("_t"))
    day = F.expr(f"(_m - pmod(_m, {DAY // MINUTE})) div {DAY // MINUTE}")
    minutes = minutes.select("_s", "_m", "_n", "_t", F.posexplode(F.array(day, day + 1)).alias("_old", "_day"))
    between = Window.partitionBy("_s", "_day").orderBy("_m").rangeBetween(1 - DAY // MINUTE, -1)
    sums = minutes.select(F.col("_s").alias("_s2"), F.col("_m").alias("_m2"), "_old", F.sum("_n").over(between).alias("_full_n"), F.sum("_t").over(between).alias("_full_t")).filter("_old = 0")
    found = found.join(sums, (F.col("_m") == F.col("_m2")) & F.col("_s").eqNullSafe(F.col("_s2")))
    total = lambda ends, full: F.col(ends) + F.coalesce(full, F.lit(0))
    found = found.select("_row", "rpm", "tpm", total("_ends_n", "_full_n").alias("rpd"), total("_ends_t", "_full_t").alias("tpd"))
    lost = rows.filter("_at IS NULL").select("_row", *[F.lit(None).cast(k).alias(n) for n, k in found.dtypes[1:]])
    return found.unionByName(lost).select("_row.*", "rpm", "tpm", "rpd", "tpd")


def pacing_state(rpm: Column, tpm: Column, rpd: Column, max_rpm: float, max_tpm: float, max_rpd: float, tokens: Column | None = None, critical: float = 0.90, warning: float = 0.75) -> Column:
    """healthy, warning or throttled for the next request of so many tokens."""
    a, b, d = (rpm + 1) / F.lit(max_rpm), (tpm + (F.lit(0) if tokens is None else tokens)) / F.lit(max_tpm), (rpd + 1) / F.lit(max_rpd)
    most = F.greatest(a, b)
    return F.when((most >= 1) | (d >= 1), F.lit("throttled")).when(most >= critical, F.lit("throttled")).when(most >= warning, F.lit("warning")).otherwise(F.lit("healthy"))


def pacing_interval(rpm: Column, tpm: Column, max_rpm: float, max_tpm: float, critical: float = 0.90, warning: float = 0.75) -> Column:
    """Seconds between requests that the state asks for; null at a hard limit, where the window has to drain."""
    most = F.greatest((rpm + 1) / F.lit(max_rpm), tpm / F.lit(max_tpm))
    return F.when(most >= 1, F.lit(None).cast("double")).when(most >= critical, F.lit(60.0 / (max_rpm * 0.85))).when(most >= warning, F.lit(60.0 / max_rpm)).otherwise(F.lit(0.0))


def seconds_to_free(events: DataFrame, service: str, ts: str, needed: int = 1) -> DataFrame:
    """events with free_s: seconds until ``needed`` requests of the last minute have left the window.

    A task holds a service's minute and the one before.  Events without a time have a null.
    """
    rows = _timed(events, service, ts, F.lit(0))
    w = Window.partitionBy("_s", "_m").orderBy("_a").rangeBetween(-MINUTE, 0)
    found = _in_minutes(rows.filter("_at IS NOT NULL"), [_next_minute()])
    free = F.coalesce((F.nth_value("_a", needed).over(w) + MINUTE - F.col("_a")) / 1e6, F.lit(0.0))
    found = found.select("_row", "_kind", free.alias("free_s")).filter("_kind = 0").drop("_kind")
    lost = rows.filter("_at IS NULL").select("_row", F.lit(None).cast("double").alias("free_s"))
    return found.unionByName(lost).select("_row.*", "free_s")


def backoff_seconds(failures: Column, retry_after: Column | None = None, jitter: Column | None = None) -> Column:
    """Cooldown after so many refusals in a row: the server's wish up to 120 s, else doubling from 15 to 90 s."""
    base = F.least(F.lit(15.0) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(4))), F.lit(90.0)) + (F.lit(0.0) if jitter is None else jitter)
    return base if retry_after is None else F.when(retry_after > 0, F.least(retry_after, F.lit(120.0))).otherwise(base)


def failure_runs(events: DataFrame, service: str, order: list[str], failed: Column) -> DataFrame:
    """events with in_a_row: the length so far of the run of failures that a row stands in (0 on success)."""
    return runs(events, service, order, failed, "in_a_row")


def lifetime_counters(events: DataFrame, service: str, order: list[str], tokens: Column) -> DataFrame:
    """events with requests and tokens: how many a service had up to this one, and their tokens."""
    return running_sums(events, service, order, {"requests": F.lit(1), "tokens": tokens})


def independent_segments(events: DataFrame, caller: str, at: str, window: int) -> DataFrame:
    """events with _segment: a caller's events between gaps longer than ``window`` (in the unit of ``at``).

    A gap longer than a window has a border between two windows' worth of time inside, so it shows in the first and last times by
    such bucket: a row a caller and bucket, which is all that a window over a caller sees.
    """
    bucket = F.expr(f"({at} - pmod({at}, {window})) div {window}")
    w = Window.partitionBy("_who").orderBy("_bucket")
    spans = events.groupBy(F.col(caller).alias("_who"), bucket.alias("_bucket")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    cut = F.coalesce(F.col("_first") - F.lag("_last").over(w) > window, F.lit(True))
    spans = spans.withColumn("_cut", cut.cast("int")).select("_who", "_bucket", F.sum("_cut").over(w).alias("_segment"))
    return events.join(spans, (bucket == F.col("_bucket")) & F.col(caller).eqNullSafe(F.col("_who"))).drop("_who", "_bucket")


def hourly_cap(events: DataFrame, caller: str, ts: str, order: str, limit: int, window_s: int = 3600) -> DataFrame:
    """(caller, order, allowed): a call passes if fewer than ``limit`` passed within the window before it.

    Refused calls do not count, so the answer depends on the answers before it, but not on those before a pause
    longer than the window.  So a caller's calls are dealt by segments between such pauses, and rows stream through a task by
    segment in time order; what is held is at most ``limit`` times.  Only a caller that never pauses is one segment.
    A call without a time has a null.
    """
    import collections

    import pyarrow as pa

    window = window_s * 1_000_000
    rows = events.select(F.col(caller).alias("c"), micros(ts).alias("at"), F.col(order).alias("o"))
    timed = independent_segments(rows.filter("at IS NOT NULL"), "c", "at", window)
    timed = timed.select("c", "_segment", "at", "o").repartition("c", "_segment").sortWithinPartitions("c", "_segment", "at", "o")

    def run(batches):
        who, passed = None, collections.deque()
        for batch in batches:
            out = []
            for c, segment, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (c, segment) != who:
                    who, passed = (c, segment), collections.deque()
                while passed and passed[0] < at - window:
                    passed.popleft()
                out.append(len(passed) < limit)
                if out[-1]:
                    passed.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.bool_())], names=["c", "o", "allowed"])

    kinds = dict(rows.dtypes)
    done = timed.mapInArrow(run, f"c {kinds['c']}, o {kinds['o']}, allowed boolean")
    done = done.unionByName(rows.filter("at IS NULL").select("c", "o", F.lit(None).cast("boolean").alias("allowed")))
    return done.select(F.col("c").alias(caller), F.col("o").alias(order), "allowed")
