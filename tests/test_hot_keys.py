"""Operators that must not gather a key's rows in one task: right rows, and bounds on what a task or an exchange gets."""

import collections
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import governor as G
from larder.operators import ordered as O
from larder.operators import retrieval as R
from larder.operators import telemetry as T
from larder.operators import vectors as V

START = dt.datetime(2024, 2, 28, 23, 50)


def _events(spark, n=1500, days=3, seed=1):
    """One service has most events; ties in time, null services and times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + dt.timedelta(seconds=rng.choice([rng.randrange(days * 86_400), rng.randrange(600), 86_400 + rng.randrange(120), 60 * rng.randrange(5)]))
        rows.append((i, rng.choice(["hot"] * 8 + ["cold", None]), None if i % 97 == 0 else at, rng.choice([1, 5, -3, None, 100])))
    return rows, spark.createDataFrame(rows, "e long, s string, ts timestamp, n long")


def test_windows_against_brute_force(spark):
    rows, df = _events(spark)
    got = {r["e"]: r for r in G.window_metrics(df, "s", "ts", F.col("n")).collect()}
    free = {r["e"]: r["free_s"] for r in G.seconds_to_free(df, "s", "ts", 2).collect()}
    assert len(got) == len(free) == len(rows)
    by = collections.defaultdict(list)
    for e, s, ts, n in rows:
        if ts is not None:
            by[s].append((ts, max(n or 0, 0)))
    for s in by:
        by[s].sort()
    for e, s, ts, n in rows:
        r = got[e]
        if ts is None:
            assert r["rpm"] is None and r["tpd"] is None and free[e] is None
            continue
        minute = [(t, k) for t, k in by[s] if ts - dt.timedelta(seconds=60) <= t <= ts]
        day = [(t, k) for t, k in by[s] if ts - dt.timedelta(days=1) <= t <= ts]
        assert (r["rpm"], r["tpm"], r["rpd"], r["tpd"]) == (len(minute), sum(k for _, k in minute), len(day), sum(k for _, k in day))
        assert free[e] == (60 - (ts - minute[1][0]).total_seconds() if len(minute) > 1 else 0.0)


def test_no_task_holds_more_than_a_minute_and_its_halo(spark):
    df = spark.range(20_000).select(F.when(F.col("id") >= 0, "one").alias("s"), F.timestamp_seconds(F.col("id") * 13 + 1_700_000_000).alias("ts"))
    rows = G._timed(df, "s", "ts", F.lit(1)).filter("_at IS NOT NULL")
    spread = G._in_minutes(rows, [G._next_minute(), F.struct((G._minute() + 1440).alias("_m"), (F.col("_at") + G.DAY).alias("_a"))])
    assert spread.groupBy("_s", "_m").count().agg(F.max("count")).first()[0] <= 3 * 5
    plan = G.window_metrics(df, "s", "ts", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "hashpartitioning(" in x]
    assert exchanges and all(any(f in x for f in ("_m#", "_m2#", "_day#", "_groupingexpression#")) for x in exchanges)  # never by the service alone


@pytest.mark.parametrize("n", [1, 7])
def test_running_totals_and_runs(spark, n):
    rows, df = _events(spark, seed=n)
    df = df.withColumn("bad", F.col("n") == 1)
    sums = {r["e"]: (r["count"], r["total"]) for r in O.running_sums(df, "s", ["ts", "e"], {"count": F.lit(1), "total": F.col("n")}, n).collect()}
    runs = {r["e"]: r["run"] for r in O.runs(df, "s", ["ts", "e"], F.col("bad"), "run", n).collect()}
    at = collections.defaultdict(lambda: [0, 0, 0])
    for e, s, ts, k in sorted(rows, key=lambda r: (r[2] is not None, r[2] or START, r[0])):
        a = at[s]
        a[0], a[1], a[2] = a[0] + 1, a[1] + (k or 0), a[2] + 1 if k == 1 else 0
        assert sums.pop(e) == (a[0], a[1]) and runs.pop(e) == a[2]
    assert not sums and not runs


def test_a_hot_key_lies_in_many_slabs(spark):
    df = spark.range(8000).select(F.lit("one").alias("s"), "id")
    sizes = [r["count"] for r in O.slabs(df, "s", ["id"], 8).groupBy("s", O.SLAB).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 3000


def test_cap_of_a_hot_caller_in_segments(spark):
    rng, at, rows = random.Random(5), 0, []
    for i in range(3000):
        at += rng.choice([0, 1, 30, 300, 600, 601, 700]) if rng.random() < 0.9 else rng.randrange(5000)
        rows.append((i, "hot" if i % 10 else None, START + dt.timedelta(seconds=at) if i % 211 else None))
    df = spark.createDataFrame(rows, "e long, u string, ts timestamp")
    got = {r["e"]: r["allowed"] for r in G.hourly_cap(df, "u", "ts", "e", 3, 600).collect()}
    passed = collections.defaultdict(list)
    for e, u, ts in rows:
        if ts is None:
            assert got.pop(e) is None
            continue
        near = [p for p in passed[u] if p >= ts - dt.timedelta(seconds=600)]
        assert got.pop(e) == (len(near) < 3)
        if len(near) < 3:
            passed[u].append(ts)
    assert not got
    timed = df.filter("ts IS NOT NULL").select("u", G.micros("ts").alias("at"))
    sizes = [r["count"] for r in G.independent_segments(timed, "u", "at", 600_000_000).filter("u = 'hot'").groupBy("_segment").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 300


def _plain_nearest(rows, q, limit):
    best = {}
    for k, c, v in rows:
        if v is not None and len(v) == len(q):
            a, b = np.asarray(v, np.float64), np.asarray(q, np.float64)
            sim = float(a @ b / ((np.linalg.norm(a) or 1) * np.linalg.norm(b)))
            if k not in best or (-round(sim, 9), c) < best[k]:
                best[k] = (-round(sim, 9), c)
    return [(k, s, c) for s, k, c in sorted((s, k, c) for k, (s, c) in best.items())][:limit]


def _vectors(rng, n=900):
    rows = [(f"k{rng.randrange(n // 3)}", i, None if i % 50 == 0 else [1.0, 2.0] if i % 30 == 0 else [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    return [(k, c, [np.float32(x).item() for x in v] if v else v) for k, c, v in rows]


def test_top_k_leaves_a_task_as_limit_rows(spark):
    rows, q = _vectors(random.Random(2)), [1.0, 0.5, -1.0, 2.0]
    df = spark.createDataFrame(rows, "k string, c long, embedding array<float>").repartition(6)
    for limit in (1, 7, 1000):
        assert R.nearest_in_tasks(df, "k", "c", q, limit).count() <= 6 * limit
        got = [(r["k"], -round(r["sim"], 9) + 0.0, r["c"]) for r in R.vector_search(df, "k", "c", q, limit).collect()]
        assert got == [(k, s + 0.0, c) for k, s, c in _plain_nearest(rows, q, limit)]
    plan = R.vector_search(df, "k", "c", q, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > plan.index("TakeOrderedAndProject")  # below the exchange of the merge


def test_blocks_of_a_signature(spark, tmp_path):
    rng, q = random.Random(3), [1.0, 0.5, -1.0, 2.0]
    rows = [(*r, m) for r, m in ((r, rng.choice(["a", "b", None])) for r in _vectors(rng))] + [("z", 1, [0.0] * 4, "a"), ("nulls", 1, [1.0, None, 1.0, 1.0], "a"), ("none", 2, [], "a")]
    df = spark.createDataFrame(rows, "k string, c long, embedding array<float>, model string")
    path = f"file://{tmp_path}/blocks"
    V.write_blocks(df, path, "k", "c", block=64)
    blocks = V.read_blocks(spark, path, "a", 4)
    mine = [r[:3] for r in rows if r[3] == "a" and r[2] and None not in r[2]]
    for limit in (5, 2000):
        got = [(r["k"], -round(r["sim"], 9) + 0.0, r["c"]) for r in V.search_blocks(blocks, q, limit, "k", "c").collect()]
        assert got == [(k, s + 0.0, c) for k, s, c in _plain_nearest(mine, q, limit)]
    some = spark.createDataFrame([(f"k{i}",) for i in range(0, 300, 7)] * 2, "k string")
    got = [(r["k"], r["c"]) for r in V.search_blocks(blocks, q, 9, "k", "c", some).collect()]
    assert got == [(k, c) for k, _, c in _plain_nearest([r for r in mine if r[0][0] == "k" and int(r[0][1:]) % 7 == 0], q, 9)]
    stored = {(r["model"], r["dim"]): r["vectors"] for r in V.signatures(spark, path).collect()}
    assert stored == collections.Counter((m, len(v)) for _, _, v, m in rows if m and v and None not in v)
    plan = V.search_blocks(blocks, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and "(model" in plan.split("PartitionFilters")[1][:200]
    read = {r["f"] for r in blocks.select(F.input_file_name().alias("f")).collect()}
    assert read and all("model=a/dim=4" in f for f in read)
    assert max(r["n"] for r in blocks.select(F.size("keys").alias("n")).collect()) <= 64


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_ranks_by_refinement(spark, share):
    rng = random.Random(7)
    rows = [("hot", rng.lognormvariate(0, 6)) for _ in range(3000)] + [("same", 4.0)] * 500 + [(None, float(rng.randrange(5)))] * 90 + [("one", -1.5), ("null", None), ("nan", float("nan")), ("wide", -1e308), ("wide", 1e308)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["picked"] for r in T.nearest_rank_by_refinement(df, ["g"], "v", share, bins=8, held=20).collect()}
    by = collections.defaultdict(list)
    for g, v in rows:
        if v is not None and v == v:
            by[g].append(v)
    assert got == {g: sorted(v)[min(int(len(v) * share), len(v) - 1)] for g, v in by.items()}
    whole = T.nearest_rank_by_refinement(df.select((F.col("v") * 0).cast("long").alias("v")).filter("v IS NOT NULL").limit(0), ["v"], "v", share)
    assert whole.count() == 0


def test_pages_by_their_last_row(spark):
    from larder.operators.store import page_after

    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for i in range(80)]
    df, order = spark.createDataFrame(rows, "id long, n int, s string"), [("n", True), ("s", False), ("id", False)]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or "", r[0]))
    got, last = [], None
    while part := page_after(df, order, 9, last).collect():
        got += [tuple(r) for r in part]
        last = (part[-1]["n"], part[-1]["s"], part[-1]["id"])
    assert got == want
