"""Streaming twins of the batch operators, and the ingest loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, width: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; rows later than the watermark are left out."""
    w = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    out = events.withWatermark(ts, late) if events.isStreaming else events
    return out.groupBy(w.alias("w"), key).agg(F.count("*").alias("requests"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "requests", "total")


#: Keeps lists, maps and timers of stateful processors on the executors' disks.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Answers the calls of a caller in the order of their times, whatever order and batches they come in.

    Calls wait in the state until the watermark has passed their slice of time; a timer then answers the slices that are over.
    A caller's first ``inline`` calls wait together in one value with its timer and the calls that passed, so a caller costs a read and
    a write a batch; those of a busy caller go to a map by slice, which a timer takes one after the other.  So what a task
    holds is one slice of one caller, ``inline`` calls and the times of ``limit`` calls, and neither a batch nor a caller's history.
    """

    def __init__(self, limit: int, window_s: int, slice_s: int, inline: int = 4096):
        self.limit, self.window, self.slice, self.inline = limit, window_s * 1_000_000, slice_s * 1_000_000, inline

    def init(self, handle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "times binary, orders binary, passed binary, wake binary, slices int")
        self.waiting = handle.getMapState("waiting", "slice bigint, part int", "times binary, orders binary")
        self.parts = handle.getMapState("parts", "slice bigint", "parts int")

    def _own(self) -> tuple:
        """Times and numbers of the calls that wait in the value, times that passed, the timer (or none), whether others wait by slice."""
        import numpy as np

        kept = self.own.get()
        if kept is None:
            return *(np.empty(0, np.int64) for _ in range(4)), False
        return *(np.frombuffer(bytes(x), np.int64) for x in kept[:4]), bool(kept[4])

    def _keep(self, at, order, passed, wake: int | None, sliced: bool) -> None:
        import numpy as np

        if len(at) or len(passed) or wake is not None or sliced:
            as_bytes = lambda x: np.asarray(x, np.int64).tobytes()
            self.own.update((as_bytes(at), as_bytes(order), as_bytes(passed), as_bytes([] if wake is None else [wake]), int(sliced)))
        else:
            self.own.clear()

    def _end_ms(self, number: int) -> int:
        return (number + 1) * self.slice // 1000

    def _by_slice(self, at, order) -> None:
        """Puts calls into the map, each slice's as a further part of it."""
        import numpy as np

        numbers = at // self.slice
        for number in np.unique(numbers).tolist():
            mine, part = numbers == number, 0
            if self.parts.containsKey((number,)):
                part = self.parts.getValue((number,))[0]
            self.waiting.updateValue((number, part), (at[mine].tobytes(), order[mine].tobytes()))
            self.parts.updateValue((number,), (part + 1,))

    def _taken(self, number: int):
        """The calls of a slice, out of the map."""
        import numpy as np

        kept = [self.waiting.getValue((number, i)) for i in range(self.parts.getValue((number,))[0])]
        for i in range(len(kept)):
            self.waiting.removeKey((number, i))
        self.parts.removeKey((number,))
        return [np.frombuffer(b"".join(bytes(k[i]) for k in kept), np.int64) for i in (0, 1)]

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np

        at, order, passed, wake, sliced = self._own()
        first = None
        for frame in rows:
            more = frame["at"].to_numpy(np.int64)
            if not len(more):
                continue
            first = int(more.min()) if first is None else min(first, int(more.min()))
            at, order = np.concatenate([at, more]), np.concatenate([order, frame["ord"].to_numpy(np.int64)])
            if len(at) > self.inline:
                self._by_slice(at, order)
                at, order, sliced = at[:0], order[:0], True
        if first is None:
            return iter([])
        ms, old = max(self._end_ms(first // self.slice), timerValues.getCurrentWatermarkInMs() + 1), wake[0].item() if len(wake) else None
        if old is None or ms < old:  # one timer a caller, for its first slice that is not over
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
            old = ms
        self._keep(at, order, passed, old, sliced)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import collections

        import numpy as np
        import pandas as pd

        over = timerValues.getCurrentWatermarkInMs()
        at, order, passed, _, sliced = self._own()
        passed = collections.deque(passed.tolist())
        apart = sorted(k[0] for k in self.parts.keys()) if sliced else []

        def answered(at, order):
            by_time = np.lexsort((order, at))
            allowed = []
            for t in at[by_time].tolist():
                while passed and passed[0] < t - self.window:
                    passed.popleft()
                allowed.append(len(passed) < self.limit)
                if allowed[-1]:
                    passed.append(t)
            return pd.DataFrame({"caller": [key[0]] * len(at), "ord": order[by_time], "allowed": allowed})

        ready = np.array([self._end_ms(n) <= over for n in (at // self.slice).tolist()], bool)
        now, now_order, at, order = at[ready], order[ready], at[~ready], order[~ready]
        for number in [n for n in apart if self._end_ms(n) <= over]:
            before = now < (number + 1) * self.slice  # calls of earlier slices and of this one
            mine, mine_order = self._taken(number)
            yield answered(np.concatenate([now[before], mine]), np.concatenate([now_order[before], mine_order]))
            now, now_order = now[~before], now_order[~before]
        if len(now):
            yield answered(now, now_order)
        live = [p for p in passed if p >= over * 1000 - self.slice - self.window]  # a slice that is not over may have begun before
        later = [n for n in apart if self._end_ms(n) > over] + ([int(at.min()) // self.slice] if len(at) else [])
        wake = self._end_ms(min(later)) if later else None
        if wake is not None:
            self.handle.registerTimer(wake)
        self._keep(at, order, live, wake, any(self._end_ms(n) > over for n in apart))

    def close(self) -> None:
        pass


def rate_limiter(events: DataFrame, caller: str, ts: str, order: str, limit: int, window_s: int = 3600, late: str = "1 hour", slice_s: int = 600, inline: int = 4096) -> DataFrame:
    """(caller, order, allowed) of a stream: a call passes if fewer than ``limit`` passed in the window before it.

    Refused calls do not count.  An answer comes when the watermark has passed the call's slice of time, so calls that are
    late by no more than ``late`` are answered in their place, and the answers are those of the batch operator.  Calls without a
    time are left out.  A caller's first ``inline`` waiting calls are one value of the state.  The state store must be RocksDB; the
    session is set to it.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.select(F.col(caller).alias("caller"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).cast("long").alias("ord")).filter("ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("caller", "ts", F.unix_micros("ts").alias("at"), "ord")
    kind = dict(rows.dtypes)["caller"]
    return rows.groupBy("caller").transformWithStateInPandas(Limiter(limit, window_s, slice_s, inline), f"caller {kind}, ord long, allowed boolean", "Append", "EventTime")


def put_batch(df: DataFrame, path: str, number: int) -> None:
    """Writes a micro-batch's rows as that batch's: a batch that is run again replaces what its first run has left."""
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def ingest(requests: DataFrame, extract: Callable[[DataFrame], DataFrame], index: Callable[[DataFrame, int], None], status_path: str, checkpoint: str, key: str = "url", done: Callable[[int], None] | None = None):
    """Runs each micro-batch through extract and index and records its jobs' states, each batch's in a folder of its own.

    A batch is written as running before and as ready or failed after.  A stream that ends anywhere in a batch runs that
    batch again: its states begin anew, and index gets the batch's number, so that it can replace what it wrote
    (see put_batch).  done: called with the number when a batch's rows are indexed, before its jobs are ready.
    """

    def say(batch: DataFrame, number: int, status: str, error: str | None, mode: str) -> None:
        rows = batch.select(key, F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), F.current_timestamp().alias("at"))
        rows.write.mode(mode).parquet(f"{status_path}/batch={number}")

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            say(batch, number, "running", None, "overwrite")
            try:
                index(extract(batch), number)
            except Exception as e:  # the job's state holds the error; the stream goes on
                say(batch, number, "failed", str(e)[:500], "append")
            else:
                if done:
                    done(number)
                say(batch, number, "ready", None, "append")
        finally:
            batch.unpersist()

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(states: DataFrame, key: str = "url") -> DataFrame:
    """The newest state of each job; of equal times the one further on."""
    rank = F.array_position(F.lit(["queued", "running", "failed", "ready"]), F.col("status"))
    return states.groupBy(key).agg(F.max_by(F.struct("status", "error"), F.struct("batch", rank, "at")).alias("s")).select(key, "s.status", "s.error")
