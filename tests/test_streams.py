"""Streams that start again, and the limiter's state."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from larder.streaming import jobs as ST

START = dt.datetime(2024, 5, 1)


def _run(stream, root, limit=3, window=600):
    out = ST.rate_limiter(stream, "u", "ts", "e", limit, window, late="30 minutes", slice_s=120)
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_limiter_over_batches_out_of_order_and_a_restart(spark, tmp_path):
    """One caller has nearly all calls; they come out of order, in several batches and two runs of the stream."""
    rng, root = random.Random(8), f"file://{tmp_path}"
    rows = [(i, "hot" if i % 12 else f"u{i % 5}", START + dt.timedelta(seconds=20 * i + rng.randrange(900))) for i in range(700)]
    put = lambda part: spark.createDataFrame(part, "e long, u string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{root}/in")
    for k in range(0, 400, 100):
        put(rows[k : k + 100])
    stream = spark.readStream.schema("e long, u string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    _run(stream, root)
    early = spark.read.parquet(f"{root}/out").count()
    assert 0 < early < 400  # the rest waits in the state
    for k in range(400, 700, 100):
        put(rows[k : k + 100])
    put([(-1, None, START + dt.timedelta(days=900)), (-2, None, None)])
    _run(stream, root)
    passed, want = collections.defaultdict(list), {}
    for e, u, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        near = [p for p in passed[u] if p >= ts - dt.timedelta(seconds=600)]
        want[e] = (u, len(near) < 3)
        if want[e][1]:
            passed[u].append(ts)
    got = spark.read.parquet(f"{root}/out").filter("ord >= 0").collect()
    assert len(got) == len(want) and {r["ord"]: (r["caller"], r["allowed"]) for r in got} == want


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    root, tries = f"file://{tmp_path}", collections.Counter()
    for k in range(3):  # three files, three batches
        spark.range(10 * k, 10 * k + 10).withColumnRenamed("id", "url").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("url long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")

    def index(df, n):
        if n == 2:
            raise ValueError("no room")
        ST.put_batch(df, f"{root}/index", n)

    def done(n):
        tries[n] += 1
        if tries[n] == 1:
            raise RuntimeError("ends")

    for _ in range(4):
        q = ST.ingest(stream, lambda b: b.withColumn("title", F.lit("t")), index, f"{root}/states", f"{root}/cp", "url", done)
        try:
            q.awaitTermination()
        except Exception:
            pass
    assert tries == {0: 2, 1: 2}
    assert sorted(r["url"] for r in spark.read.parquet(f"{root}/index").collect()) == list(range(20))
    states = {r["url"]: (r["status"], r["error"]) for r in ST.job_states(spark.read.parquet(f"{root}/states")).collect()}
    assert states == {u: ("ready", None) if u < 20 else ("failed", "no room") for u in range(30)}
