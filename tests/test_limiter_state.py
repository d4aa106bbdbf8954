"""What the streaming limiter reads and writes of its state, and its answers where a caller's calls outgrow one value."""

import collections
import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from larder.streaming import jobs as ST

DAY = 86_400_000_000


class _State:
    """A value or a map that counts what is done with it."""

    def __init__(self, ops):
        self.ops, self.kept = ops, {}

    def __getattr__(self, name):
        def call(*args):
            self.ops[name] += 1
            key, value = (args + (None, None))[:2]
            if name in ("update", "updateValue"):
                self.kept[key if name == "updateValue" else None] = value if name == "updateValue" else key
            elif name in ("clear", "removeKey"):
                self.kept.pop(key, None)
            return {"get": self.kept.get(None), "getValue": self.kept.get(key), "containsKey": key in self.kept, "exists": None in self.kept, "keys": list(self.kept)}.get(name)

        return call


class _Handle:
    def __init__(self):
        self.ops, self.timers, self.states = collections.Counter(), set(), []

    def _state(self, *schema):
        self.states.append(_State(self.ops))
        return self.states[-1]

    getValueState = getMapState = getListState = _state

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class _Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _answers(limiter, handle, batches):
    """The answers to batches of (at, ord), the watermark being each batch's last time and at the end past all."""
    limiter.init(handle)
    out, mark = [], -1
    for batch in [*batches, None]:
        if batch:
            list(limiter.handleInputRows(("c",), iter([pd.DataFrame(batch[i : i + 40], columns=["at", "ord"]) for i in range(0, len(batch), 40)]), _Times(mark)))
            mark = max(mark, max(t for t, _ in batch) // 1000 - 3_600_000)
        else:
            mark = 10**15
        for ms in [ms for ms in handle.timers if ms <= mark]:
            for frame in limiter.handleExpiredTimer(("c",), _Times(mark), None):
                out += frame[["ord", "allowed"]].values.tolist()
            handle.timers.discard(ms)
    return dict(out), len(out)


def _brute(rows, limit, window):
    passed, want = collections.deque(), {}
    for t, e in sorted(rows):
        while passed and passed[0] < t - window:
            passed.popleft()
        want[e] = len(passed) < limit
        if want[e]:
            passed.append(t)
    return want


def test_state_operations_do_not_grow_with_a_callers_slices():
    rows = [(i * DAY // 2, i) for i in range(600)]  # 300 slices
    handle = _Handle()
    got, n = _answers(ST.Limiter(2, 86_400, 86_400), handle, [rows])
    assert n == 600 and got == _brute(rows, 2, DAY)
    assert sum(handle.ops.values()) < 20
    assert not any(s.kept.keys() - {None} for s in handle.states)


def test_answers_where_calls_wait_in_one_value_or_by_slice():
    rng = random.Random(5)
    for inline in (0, 1, 30, 100, 4096):
        rows = [(rng.randrange(3000) * 1_000_000 + i * 20_000_000, i) for i in range(500)]
        handle = _Handle()
        batches = [rows[i : i + 90] for i in range(0, 500, 90)]
        got, n = _answers(ST.Limiter(3, 600, 120, inline), handle, batches)
        assert n == 500 and got == _brute(rows, 3, 600_000_000)
        assert not handle.timers and not any(k is not None for s in handle.states for k in s.kept)


def test_a_busy_caller_in_the_stream(spark, tmp_path):
    rng, root, start = random.Random(9), f"file://{tmp_path}", dt.datetime(2024, 5, 1)
    rows = [(i, "hot" if i % 9 else f"u{i % 5}", start + dt.timedelta(seconds=20 * i + rng.randrange(900))) for i in range(400)]
    for part in (rows[:200], rows[200:], [(-1, None, start + dt.timedelta(days=900))]):
        spark.createDataFrame(part, "e long, u string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("e long, u string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = ST.rate_limiter(stream, "u", "ts", "e", 3, 600, late="30 minutes", slice_s=120, inline=25)
    out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    micros = {e: (u, int((ts - start).total_seconds()) * 1_000_000) for e, u, ts in rows}
    want = {}
    for u in {u for u, _ in micros.values()}:
        want |= _brute([(t, e) for e, (v, t) in micros.items() if v == u], 3, 600_000_000)
    got = spark.read.parquet(f"{root}/out").filter(F.col("ord") >= 0).collect()
    assert len(got) == 400 and {r["ord"]: r["allowed"] for r in got} == want
