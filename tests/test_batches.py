"""What operators hold of a large Arrow batch."""

import numpy as np
import pyarrow as pa

from larder.operators import chunking as C
from larder.operators.embedding import embed


class _Plan:
    """Stands for a table: keeps the function that an operator maps over its batches."""

    dtypes = [("k", "bigint")]

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def withColumnRenamed(self, old, new):
        return self


def _run(operator, *columns):
    """The operator's batches for one batch."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(columns[0])), pa.int64()), *map(pa.array, columns)], names=[f"c{i}" for i in range(len(columns) + 1)])
    return list(operator.run(iter([batch])))


def test_chunks_of_a_large_batch_come_in_pieces():
    n, text = 5000, "A sentence of some words. " * 400
    got = _run(C.chunks(_Plan(), "k", "a", "b", "c"), ["d"] * n, [["one detail"]] * n, [text] * (n - 2) + [None, ""])
    assert max(b.nbytes for b in got) < 8 << 20
    rows = pa.Table.from_batches(got)
    want = [("digest", "d"), ("detail", "one detail"), *(("body", p) for p in C.split_text(text))]
    assert rows.column(0).to_pylist() == [k for k in range(n) for _ in (want if k < n - 2 else want[:2])]
    assert list(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist()))[-2 * 2 - len(want) :] == [*want, *want[:2], *want[:2]]


def test_chunks_of_few_long_rows_and_of_none():
    plan = C.chunks(_Plan(), "k", "a", "b", "c")
    long = "word " * 1_000_000
    got = _run(plan, ["d"] * 3, [None] * 3, [long] * 3)
    assert len(got) == 3 and [b.column(0)[0].as_py() for b in got] == [0, 1, 2]
    assert not list(plan.run(iter([])))


def test_vectors_of_a_large_batch_come_call_by_call(spark):
    """Each call's vectors are given on before the next call is made; failures stay with their texts."""
    calls, seen = [], []

    def lengths(texts):
        calls.append(len(texts))
        if len(texts) > 1 and "bad" in texts or texts == ["bad"]:
            raise ValueError("no")
        return np.array([[len(t), 1] for t in texts], np.float32)

    plan = embed(_Plan(), ["k"], "t", "lengths", 2, lengths, batch=100, skip_failures=True)
    texts = ["x" * (i % 7) for i in range(950)] + [None, "bad"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(952), pa.int64()), pa.array(texts)], names=["k", "t"])
    rows = []
    for out in plan.run(iter([batch.slice(0, 0), batch])):
        seen.append((len(calls), out.num_rows))
        rows += out.to_pylist()
    assert seen[:9] == [(i + 1, 100) for i in range(9)] and max(n for n in calls) == 100
    assert [r["k"] for r in rows] == list(range(952)) and rows[-1]["embedding"] is None and rows[-2]["embedding"] == [0.0, 1.0]
    for k, r in enumerate(rows[:950]):
        assert np.allclose(r["embedding"], np.array([k % 7, 1]) / np.hypot(k % 7, 1))
