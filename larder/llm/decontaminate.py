"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are pairs of words of a test item, neighbours or with one word between, and meet such pairs of a text.  Between two
matched words of an alignment that follow one another, either at most one word is changed, added or left out, so
that both are a seed, or the gap costs as much as the match brings.  An alignment that reaches the threshold of an item of m words
has therefore at least ``threshold * m - 1`` seeds within ``m * (3 - 2 * threshold)`` words, however it is edited: a passage
with fewer is never aligned, and none that reaches the threshold is lost.

One pass over the corpus counts the documents that hold each seed.  A second finds the rare ones: an
item's places with a common seed are taken off the number asked for, and its common seeds are not looked at.  Only items that
would have nothing left to ask for are found through all their seeds.  Scores are parts of the item's best possible
score, so edited and paraphrased copies stay above the threshold and chance does not.

Benchmark items go to the tasks in blocks of at most ``block_words`` words (one item at least; two passes of the corpus each),
so what a task holds has a bound however large the benchmark is; texts are searched in stretches of ``STRETCH`` words, and alignments
are made in parts of at most ``CELLS`` cells a row.  Nothing is shuffled but seed counts.

Defined results: null and empty texts and items have no words and never meet; items of fewer than four
words are a seed as a whole, found anywhere in a text; repeated rows give a row each, repeated items too; null ids stay null; very long
texts are searched whole; an empty table on either side gives an empty result; further columns, whatever their names, are ignored
(``drop_leaking`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import shingles, slices
from larder.llm.wordhash import WordArrays

#: Items with fewer words are looked for as a whole.
SHORT = 4
MATCH, MISS, GAP = 2, -1, -1
#: Words of the windows that are aligned at once, padding included.
CELLS = 1 << 20
#: Words of a text that are searched at once (more for items as long).
STRETCH = 1 << 16
_MIX = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B185EBCA87))


def pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of the pairs of words that are so far apart; the distance is not part of them."""
    h = words[:-apart] * _MIX[0]
    h ^= h >> np.uint64(29)
    h += words[apart:]
    h *= _MIX[1]
    return h ^ (h >> np.uint64(32))


class Seeds:
    """The seeds of a block of items: hashes, and the items that each asks for."""

    def __init__(self, items: list[np.ndarray], threshold: float):
        grams, of, place = [], [], []
        for i, w in enumerate(items):
            for g in (pairs(w, 1), pairs(w, 2)) if len(w) >= SHORT else (shingles(w, SHORT),):
                grams.append(g)
                of.append(np.full(len(g), i))
                place.append(np.arange(len(g)))
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        self.items, self.threshold = items, threshold
        self.sizes = sorted({len(w) for w in items if 0 < len(w) < SHORT})
        self.hashes, self._seed = np.unique(join(grams, np.uint64), return_inverse=True)
        self._of, self._place = join(of, np.int64), join(place, np.int64)
        words = np.array([len(w) for w in items], dtype=np.int64)
        self.least = np.where(words < SHORT, 1, np.ceil(threshold * words - 1 - 1e-9)).astype(np.int64)
        self.reach = np.where(words < SHORT, words + 8, np.ceil(words * (3 - 2 * threshold)) + 1).astype(np.int64)
        self.mask = np.uint64((1 << min(27, max(20, (16 * len(self.hashes)).bit_length()))) - 1)
        self.filter = np.zeros(int(self.mask) + 1, dtype=bool)
        self.use(np.ones(len(self.hashes), bool))

    def use(self, rare: np.ndarray) -> None:
        """From now on finds by the rare seeds: an item's places with others are taken off what it asks for.

        An item with nothing left to ask for keeps all its seeds.
        """
        plain = ~rare[self._seed]
        where = np.unique(np.stack([self._of[plain], self._place[plain]]), axis=1)[0]
        left = self.least - np.bincount(where, minlength=len(self.items))
        self.need = np.where(left > 0, left, self.least)
        keep = np.flatnonzero((left <= 0)[self._of] | ~plain)
        order = keep[np.argsort(self._seed[keep], kind="stable")]
        self.item = self._of[order]
        self.begins = np.searchsorted(self._seed[order], np.arange(len(self.hashes) + 1))
        self.filter[:] = False
        self.filter[self._low(self.hashes[np.diff(self.begins) > 0])] = True

    def _low(self, h: np.ndarray) -> np.ndarray:
        return (h & self.mask).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a text's pairs and short runs that are seeds, and which."""
        found = [self.hits(pairs(text, n)) for n in (1, 2) if n < len(text)]
        found += [self.hits(shingles(text, n)) for n in self.sizes if n <= len(text)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of grams that are seeds, and which."""
        at = np.flatnonzero(self.filter[self._low(grams)])
        if not len(at):
            return at, at
        seed = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        ok = self.hashes[seed] == grams[at]
        return at[ok], seed[ok]

    def counted(self, text: np.ndarray) -> np.ndarray:
        """The seeds that a text holds, each once."""
        return np.unique(np.concatenate([np.unique(self.find(text[a : b + 2])[1]) for a, b in self._stretches(text)] or [np.zeros(0, np.int64)]))

    def _stretches(self, text: np.ndarray) -> list[tuple[int, int]]:
        step = max(STRETCH, 2 * int(self.reach.max(initial=0)))
        return [(a, min(a + step, len(text))) for a in range(0, len(text), step)]

    def windows(self, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last) of the places of a text that may hold an item: enough seeds within its reach, and enough of its words."""
        over = int(self.reach.max(initial=0)) + 3
        for a, b in self._stretches(text):
            at, seed = self.find(text[a : b + over])
            for i, first, last in self._dense(at + a, seed, b, len(text)) if len(at) else ():
                if MATCH * np.isin(self.items[i], text[first:last]).sum() >= self.threshold * MATCH * len(self.items[i]):
                    yield i, first, last

    def _dense(self, at: np.ndarray, seed: np.ndarray, before: int, n_words: int) -> list[tuple[int, int, int]]:
        """Windows around runs of as many seeds as their item needs; runs that begin ``before`` a place only."""
        reps = np.diff(self.begins)[seed]
        rows = np.repeat(self.begins[seed] - np.cumsum(reps) + reps, reps) + np.arange(int(reps.sum()))
        item, at = np.divmod(np.unique(self.item[rows] * (n_words + 1) + np.repeat(at, reps)), n_words + 1)
        end = np.arange(len(item)) + self.need[item] - 1
        run = np.flatnonzero((end < len(item)) & (at < before))
        end = end[run]
        near = (item[end] == item[run]) & (at[end] - at[run] <= self.reach[item[run]])
        run, end = run[near], end[near]
        if not len(run):
            return []
        item, begin, reach = item[run], at[run], self.reach[item[run]]
        # Runs of an item within four times its reach share a window.
        part = begin // (4 * reach)
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(item) != 0) | (np.diff(part) != 0)]))
        stop = np.concatenate([cut[1:], [len(run)]]) - 1
        first = np.maximum(0, at[end][cut] - reach[cut])
        last = np.minimum(n_words, begin[stop] + reach[stop] + 2)
        return list(zip(item[cut].tolist(), first.tolist(), last.tolist()))


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word sequences, and where it ends in b (exclusive)."""
    m, w = max(map(len, a)), max(map(len, b))
    left = np.zeros((len(a), m), dtype=np.uint64)
    right = np.ones((len(b), w), dtype=np.uint64)
    used_a, used_b = np.zeros(left.shape, bool), np.zeros(right.shape, bool)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, : len(x)], right[i, : len(y)] = x, y
        used_a[i, : len(x)], used_b[i, : len(y)] = True, True
    ramp = -GAP * np.arange(w + 1)
    row = np.zeros((len(a), w + 1), dtype=np.int32)
    best, end = np.zeros(len(a), dtype=np.int32), np.zeros(len(a), dtype=np.int64)
    for i in range(m):
        same = (left[:, i : i + 1] == right) & used_a[:, i : i + 1] & used_b
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, MATCH, MISS), row[:, 1:] + GAP)
        new = np.maximum(new, 0)
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        top = row.argmax(axis=1)
        value = row[np.arange(len(a)), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, common: float = 0.001, block_words: int = 500_000) -> DataFrame:
    """doc_id, text_hash, item_id, score, first_word and last_word (exclusive) of every aligned passage.

    One row for each document and item: the best alignment.  Seeds in at most ``common`` (a share) of the documents, or
    in three, are rare; that changes the work alone, never the rows.  The threshold is over a quarter and at most 1.
    """
    if not 0.25 < threshold <= 1:
        raise ValueError("the threshold is over 0.25 and at most 1")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash().alias("text_hash"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length(F.coalesce("text", F.lit(""))) > 0)
    n_docs, out = docs.count(), None
    hasher = WordArrays(signs=False)
    ids, held, size = [], [], 0

    def block():
        found = _leaks_of(docs, ids, held, threshold, max(3, common * n_docs))
        return found if out is None else out.unionByName(found)

    for r in items.toLocalIterator(prefetchPartitions=False):
        words = hasher.of([r["text"]])[0]
        if held and size + len(words) > block_words:
            out, ids, held, size = block(), [], [], 0
        ids.append(r["item_id"])
        held.append(words)
        size += len(words)
    return block() if held or out is None else out


_LEAK = "doc_id long, text_hash long, item_id long, score double, first_word int, last_word int"
_LEAK_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]


def _leaks_of(docs: DataFrame, ids: list, items: list[np.ndarray], threshold: float, common: float) -> DataFrame:
    seeds = Seeds(items, threshold)
    if not len(seeds.hashes):
        return docs.sparkSession.createDataFrame([], _LEAK)

    def count(batches):
        words, total = WordArrays(signs=False), np.zeros(len(seeds.hashes), dtype=np.int64)
        for batch in slices(batches):
            for text in words.of(batch.column(0).to_pylist()):
                total[seeds.counted(text)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["seed", "docs"])

    found = docs.select("text").mapInArrow(count, "seed int, docs long").groupBy("seed").agg(F.sum("docs").alias("docs")).toArrow()
    counts = np.zeros(len(seeds.hashes), dtype=np.int64)
    counts[found["seed"].to_numpy()] = found["docs"].to_numpy()
    seeds.use(counts <= common)

    def run(batches):
        words = WordArrays(signs=False)
        for batch in slices(batches):
            best: dict = {}
            todo, size = [], 0
            docs_in, keys_in, texts = (c.to_pylist() for c in batch.columns)
            for row, (doc, key, text) in enumerate(zip(docs_in, keys_in, words.of(texts))):
                for i, a, b in seeds.windows(text):
                    todo.append(((doc, key), row, i, a, text[a:b]))
                    size += b - a
                    if size > CELLS:
                        _aligned(best, todo, seeds.items, threshold)
                        todo, size = [], 0
            _aligned(best, todo, seeds.items, threshold)
            rows = [(*doc, ids[item], s, -f, e) for (s, f, e), doc, item in best.values()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_LEAK_KINDS)], names=[x.split()[0] for x in _LEAK.split(", ")])

    return docs.mapInArrow(run, _LEAK)


def _parts(todo: list) -> list[list]:
    """Windows of like lengths together, at most CELLS words each once padded (one window at least)."""
    out: list[list] = []
    for x in sorted(todo, key=lambda x: len(x[4])):
        if not out or (len(out[-1]) + 1) * len(x[4]) > CELLS or len(out[-1]) == 256:
            out.append([])
        out[-1].append(x)
    return out


def _aligned(best: dict, todo: list, items: list[np.ndarray], threshold: float) -> None:
    """Puts the windows (doc, row, item, first word, words) that reach the threshold into best, the best of a row and item."""
    for part in _parts(todo):
        a, b = [items[x[2]] for x in part], [x[4] for x in part]
        score, end = align(a, b)
        full = np.array([MATCH * len(x) for x in a])
        good = np.flatnonzero(score >= threshold * full)
        if not len(good):
            continue
        _, back = align([a[k][::-1] for k in good], [b[k][: end[k]][::-1] for k in good])
        for k, far in zip(good, back):
            doc, row, item, first, _ = part[k]
            new = (float(score[k] / full[k]), -int(first + end[k] - far), int(first + end[k]))
            if (row, item) not in best or new > best[row, item][0]:
                best[row, item] = (new, doc, item)


def _hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that hold a passage of a test item."""
    leaks = find_leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_hash")).distinct()
    return docs.join(leaks, F.col("doc_id").cast("long").eqNullSafe(F.col("__leak_id")) & (_hash() == F.col("__leak_hash")), "left_anti")
