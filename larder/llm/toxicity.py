"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over the presence of words and word beginnings (3 to 6 letters) is trained from confirmed toxic examples and
unlabelled texts alone.  The risk of the unlabelled texts is corrected by the class prior
(the share of toxic rows among training labels); where the corrected negative risk falls below
zero, its gradient is climbed instead, so the risk never goes negative.

Training uses a bounded sample (``most_positive``, ``most_unlabelled``), chosen by a hash of the
id, one row for each id; every text is scored whole, by one pass without a shuffle.  Features are those whose shares differ between the
positives and the unlabelled texts, in either direction; the risk gives their weights.  What reaches the driver is bounded by the sample's sizes
and ``vocabulary``, however long the texts are.

Defined results: a null or empty text has no words and gets the intercept's score; without a positive
training label all scores are the prior; repeated labels of an id count once (toxic if any says so), and so
do repeated rows (of rows with one id and different texts one teaches); very long texts are scored whole;
rows with a null id are scored and not trained on; an empty table gives an empty result; further columns
are kept, but for score and predicted, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bare, held_out, slices, table

_BITS = 22
#: Far above rounding, so that a gradient of zero (the intercept's first one) makes no step, and models can be made again.
EPSILON = 1e-5
#: Numbers of a positive text's sketch, by which copies are told.
SKETCH = 64
_PERMUTATIONS = np.random.default_rng(5).integers(1, 1 << 62, (SKETCH, 2), dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Model:
    """Buckets of words and word beginnings, their weights, and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float


def _parts(chunk: str) -> list[str]:
    """A chunk's word, and its beginnings."""
    word = bare(chunk)
    return [word, *(f"{word[:n]}*" for n in range(3, 7) if len(word) >= n)] if word else []


def _bucket(part: str) -> int:
    return xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass")) >> (64 - _BITS)


def _buckets(text: str) -> np.ndarray:
    return np.array(sorted({_bucket(p) for c in set(text.lower().split()) for p in _parts(c)}), dtype=np.int32)


class Columns(dict):
    """Chunk -> the model's columns of its parts, as bytes; most chunks have none."""

    def __init__(self, model: Model, most: int = 500_000):
        super().__init__()
        self.column, self.most = {int(b): i for i, b in enumerate(model.words)}, most

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = [self.column[b] for b in map(_bucket, _parts(chunk)) if b in self.column]
        out = self[chunk] = np.array(found, dtype="<i4").tobytes() if found else b""
        return out


def _sketch(buckets: np.ndarray) -> np.ndarray:
    """The least of each of ``SKETCH`` permutations of a text's buckets; no buckets, no sketch."""
    if not len(buckets):
        return np.zeros(0, np.int32)
    out = np.empty(SKETCH, np.int32)
    for i, (a, b) in enumerate(_PERMUTATIONS):
        out[i] = ((buckets.astype(np.uint64) * a + b) >> np.uint64(20) & np.uint64(0x7FFFFFFF)).min()
    return out


def _groups(sketches: list[np.ndarray]) -> np.ndarray:
    """A number for each text; texts that share about half of their features share it."""
    out = np.arange(len(sketches))
    for k in range(SKETCH):
        first: dict = {}
        for i, mine in enumerate(sketches):
            if len(mine):
                j = first.setdefault(int(mine[k]), i)
                if out[i] != out[j] and np.mean(mine == sketches[j]) >= 0.5:
                    out[i] = out[j] = min(out[i], out[j])
    return out


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """The positives' part of the risk, and the unlabelled texts' part corrected by the prior, of logits."""
    loss = lambda t: np.logaddexp(0, -t)
    return prior * loss(fp).mean(), loss(-fu).mean() - prior * loss(-fp).mean()


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 0.03) -> Model:
    """Minimizes the non-negative risk; rows hold the distinct chosen buckets of each text.

    Weights shrink by ``decay`` over the root of the number of positives: the fewer there are, the less a feature can say.
    """
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    if not n_pos or not n_unl or not 0 < prior < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(p / (1 - p))))
    owner, values = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    words, column = np.unique(values, return_inverse=True)
    x = np.zeros((len(rows), len(words) + 1), dtype=np.float32)
    x[:, -1] = 1
    x[owner, column] = 1
    xp, xu = x[positive], x[~positive]
    del x
    w = np.zeros(len(words) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, steps + 1):
        at = w.astype(np.float32)
        fp, fu = xp @ at, xu @ at
        gp = -prior / n_pos * (sigmoid(-fp) @ xp)
        gn = (sigmoid(fu) @ xu) / n_unl - prior / n_pos * (sigmoid(fp) @ xp)
        g = (gp + gn if risk(fp, fu, prior)[1] >= 0 else -gn) + decay / n_pos**0.5 * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + EPSILON)
    return Model(words.astype(np.int32), w[:-1].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, most_positive: int = 2000, most_unlabelled: int = 6000, vocabulary: int = 1000) -> Model:
    """A model of the training rows (those that are not held out).

    The sample's sizes are parameters of the fit: so many labelled toxic texts, and so many texts of all kinds.  Features are
    counted and chosen by Spark; the driver gets the chosen ones alone, at most ``vocabulary`` a text.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pos = known.filter("toxic = 1").orderBy(*order).limit(most_positive).select("doc_id", F.lit(True).alias("positive"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out()).distinct()
    unl = ids.orderBy(*order).limit(most_unlabelled).select("doc_id", F.lit(False).alias("positive"))
    chosen = F.broadcast(pos.unionByName(unl))  # at most most_positive + most_unlabelled ids
    texts = docs.join(chosen, "doc_id").groupBy("doc_id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "positive", "text")

    def run(batches):
        for batch in slices(batches):
            ids, sure, texts = (c.to_pylist() for c in batch.columns)
            found = [_buckets(t) for t in texts]
            sketches = [_sketch(f) if s else None for s, f in zip(sure, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sketches, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "positive", "sketch", "buckets"])

    made = table(texts.mapInArrow(run, "doc_id long, positive boolean, sketch array<int>, buckets array<int>"), "sample")
    words = _choose(made, vocabulary)

    def keep(batches):
        for batch in batches:
            rows = [r[np.isin(r, words)] for r in _lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["positive", "buckets"])

    # The order of the rows must not depend on tasks, so that a model can be made again.
    got = made.select("positive", "buckets").mapInArrow(keep, "positive boolean, buckets array<int>").orderBy("positive", "buckets").toArrow()
    rows = [r for chunk in got["buckets"].chunks for r in _lists(chunk)]
    return fit(rows, np.array(got["positive"].to_pylist(), bool), float(prior))


def _choose(made: DataFrame, vocabulary: int, least_z: float = 2.5) -> np.ndarray:
    """The buckets whose share among positives and unlabelled texts differs most, in either direction, by z.

    What is there by chance gets small weights from the risk.  A bucket must be in five texts and a hundredth of the kind that has more of it; positives that are copies of each
    other count once for that.
    """
    n = {r["positive"]: r["n"] for r in made.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_pos, n_unl = n.get(True, 0), n.get(False, 0)
    if not n_pos or not n_unl:
        return np.zeros(0, np.int32)
    copies = made.filter("positive").select("doc_id", "sketch").orderBy("doc_id").toArrow()  # most_positive rows of SKETCH numbers
    same = _groups([r for chunk in copies["sketch"].chunks for r in _lists(chunk)])
    groups = made.sparkSession.createDataFrame(list(zip(copies["doc_id"].to_pylist(), same.tolist())), "doc_id long, same int")
    each = made.filter("positive").join(F.broadcast(groups), "doc_id").select("same", F.explode("buckets").alias("bucket")).groupBy("bucket", "same").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("of_pos"), F.count("*").alias("texts"), F.lit(0).alias("of_unl"))
    others = made.filter("NOT positive").select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.lit(0).alias("of_pos"), F.lit(0).alias("texts"), F.count("*").alias("of_unl"))
    counts = each.unionByName(others).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("of_pos", "texts", "of_unl")))
    p, u = (F.col("of_pos") + 0.5) / (n_pos + 1), (F.col("of_unl") + 0.5) / (n_unl + 1)
    z = F.abs(p - u) / F.sqrt(p * (1 - p) / n_pos + u * (1 - u) / n_unl)
    enough = F.when(p > u, F.col("texts") >= max(5, 0.01 * n_pos)).otherwise(F.col("of_unl") >= max(5, 0.01 * n_unl))
    best = counts.filter(enough).withColumn("z", z).filter(F.col("z") > least_z).orderBy(F.desc("z"), "bucket").limit(vocabulary).select("bucket").toArrow()
    return np.sort(best["bucket"].to_numpy())


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); columns that had these names are replaced."""
    docs = docs.drop("score", "predicted")
    names = docs.columns

    def run(batches):
        columns = Columns(model)
        for batch in slices(batches):
            scores = []
            for t in batch.column(names.index("text")).to_pylist():
                at = np.unique(np.frombuffer(b"".join(map(columns.__getitem__, (t or "").lower().split())), dtype="<i4"))
                scores.append(model.intercept + float(model.weights[at].sum(dtype=np.float64)))
            s = 1 / (1 + np.exp(-np.clip(np.array(scores, dtype=np.float64), -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")
