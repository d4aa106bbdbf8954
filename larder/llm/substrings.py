"""Exact substring deduplication: words go that lie in a run of words which an earlier document has too.

A window is ``window`` consecutive words.  Whatever its place in a document, it holds one whole block of half as many words
that begins at a multiple of the block's length.  So the non-overlapping blocks of all documents are the anchors: their
hashes, a 25th of the corpus for windows of 50 words, each with the least document that has it, are the index, and every
rolling run of a block's length is a probe.  Where a probe meets an anchor of an earlier document, the windows around
the place are candidates, on both sides; a candidate is settled by a 96-bit hash of the whole window, again against the
least document that has it.  Windows that go and touch make the maximal exact repeats.  No pair of documents is ever made: a
passage that n documents share costs n probes.

Both questions ("at which of these places is a key that an earlier document has?") go through ``_earlier``.  Index and
probes are dealt by key, packed into one binary row for each task and bucket; a task merges the index of its bucket and
streams the probes past it.  Keys that very many places share are few (by pigeonhole no more than ``SHARE``): they are broadcast
with their least document and answered where their probes arise, so no bucket takes a hot passage.  Answers go
back packed, by document.

Defined results: a null or empty text has no words; a row without doc_id is in no order, keeps all its words and takes none
from others; of rows with one doc_id none is before the other, so they do not take each other's words; a repeated
row (same doc_id and text) is treated like its first; very long texts are hashed piece by piece (8 bytes a word are
held); ``drop_repeats`` keeps further columns, but for n_words and n_removed, which are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices, table
from larder.llm.wordhash import WordArrays

#: Words of which a task gathers the keys before it sends them; bytes of text that a bucket is meant for.
GATHER, BUCKET = 1 << 19, 128 << 20
#: There are no more hot keys than this; a key is hot from so many places.
SHARE, HOT = 4096, 200
#: Entries of a packed row, and those that a task holds before it merges them.
PACK, HELD = 1 << 16, 1 << 21
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


# --- hashes of runs of words ---------------------------------------------------------------------


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(by)
    x ^= x >> _U(29)
    return x


def run_hashes(words: np.ndarray, n: int, by: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """64-bit hashes of all runs of n words (none if there are fewer), made from runs of 1, 2, 4, 8 ... words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    many = len(words) - n + 1
    power, size, out, at = words, 1, None, 0
    while True:
        if n & size:
            part = power[at : at + many]
            out = _mixed(part, by) if out is None else _mixed(out * _U(0x9E3779B97F4A7C15) + part, by)
            at += size
        if 2 * size > n:
            return out
        power = _mixed(power[:-size] * _U(0xC2B2AE3D27D4EB4F) + power[size:], by)
        size *= 2


class Gathered:
    """Documents gathered by a task, by id: their keys and the hashes of their words, end to end.

    at: the place of a word in its document; left: the words from there to the document's end.  Of a very long document there
    is a segment at a time, with some words of the next, whose left is 0: no run is to begin there.
    """

    def __init__(self, docs: list[tuple]):
        docs.sort(key=lambda d: d[:2])
        self.ids, self.hashes, self.offsets, self.sizes = (np.array([d[i] for d in docs], np.int64) for i in (0, 1, 4, 5))
        lengths = np.array([len(d[2]) for d in docs], np.int64)
        self.words = np.concatenate([d[2] for d in docs])
        self.starts = np.cumsum(lengths) - lengths
        self.extra = [d[3] for d in docs]
        self.of = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
        self.at = (np.arange(len(self.words)) - (self.starts - self.offsets)[self.of]).astype(np.int32)
        self.left = self.sizes.astype(np.int32)[self.of] - self.at
        if len(docs) == 1 and lengths[0] < self.sizes[0] - self.offsets[0]:
            self.left[GATHER:] = 0


def _zipped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text, compressed: texts that a join moves cost less."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            texts = [pack.compress(t) for t in part.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.binary())], names=["doc_id", "text_hash", "text"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, text binary")


def _bytes(column: pa.Array) -> list[bytes]:
    """Texts in UTF-8, of a column of texts or of compressed ones."""
    if pa.types.is_binary(column.type):
        return [zstandard.decompress(t) for t in column.to_pylist()]
    return column.cast(pa.binary()).to_pylist()


def _gathered(batches, least: int, overlap: int):
    """Gathered documents of some GATHER words: each once, if it has an id and least words or more."""
    arrays, docs, seen, n = WordArrays(), [], set(), 0
    for part in slices(batches):
        keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist())
        words = arrays.raw(_bytes(part.column(2)))
        extra = part.column(3).to_pylist() if part.num_columns > 3 else [None] * part.num_rows
        for key, w, x in zip(keys, words, extra):
            if key[0] is not None and len(w) >= least and key not in seen:
                seen.add(key)
                if len(w) > 2 * GATHER:
                    for a in range(0, len(w), GATHER):
                        yield Gathered([(*key, w[a : a + GATHER + overlap], x, a, len(w))])
                    continue
                docs.append((*key, w, x, 0, len(w)))
                n += len(w)
        if n >= GATHER:
            yield Gathered(docs)
            docs, seen, n = [], set(), 0
    if docs:
        yield Gathered(docs)


# --- packed rows ---------------------------------------------------------------------------------
# Numbers are stored with all lowest bytes first, then the next: the zeros of small numbers lie together and pack well.


def _planes(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _whole(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _flat(keys: np.ndarray) -> np.ndarray:
    """Keys as 32-bit numbers: one or three of them."""
    return np.concatenate([np.ascontiguousarray(keys["a"]).view(np.uint32), keys["b"]]) if keys.dtype.names else keys


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours; sums of them give the numbers again, whatever their order."""
    return np.diff(a, prepend=a.dtype.type(0))


WIDE = np.dtype([("a", np.uint64), ("b", np.uint32)])
NARROW = np.dtype(np.uint32)
_KINDS = {"keys": None, "docs": np.int64, "hashes": np.int64, "places": np.int32, "weights": np.uint32}
_COLUMNS = ["bucket", "kind", *_KINDS]
_DDL = "bucket int, kind byte, keys binary, docs binary, hashes binary, places binary, weights binary"
INDEX, PROBE, ANSWERED = 0, 1, 2


def _batches(rows: list[tuple], types: list, names: list[str]):
    """Rows in batches of some 4 MB."""
    held, size = [], 0
    for k, row in enumerate(rows):
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > 4 << 20 or len(held) == 2000 or k == len(rows) - 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0


def _packed(kind: int, bucket: np.ndarray, keys, ids, hashes, places, weights=None):
    """Entries as rows of a bucket each; what comes in order of document and place packs best."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [None if c is None else c[order] for c in (keys, ids, hashes, places, weights)]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    rows = []
    for first, after in zip(cuts[:-1], cuts[1:]):
        for a in range(first, after, PACK):
            mine = [None if c is None else c[a : min(after, a + PACK)] for c in columns]
            k, d, h, p, w = mine
            k = k if k is None else _flat(k)
            same = not h.any()
            rows.append((int(bucket[a]), kind, k if k is None else _planes(k), _planes(_steps(d)), b"" if same else _planes(_steps(h)), _planes(_steps(p.astype(np.int32))), w if w is None else _planes(w.astype(np.uint32))))
    yield from _batches(rows, [pa.int32(), pa.int8(), *[pa.binary()] * 5], _COLUMNS)


def _unpacked(row: dict, key_kind) -> tuple:
    docs = np.cumsum(_whole(row["docs"], np.int64))
    n = len(docs)
    hashes = np.cumsum(_whole(row["hashes"], np.int64)) if row["hashes"] else np.zeros(n, np.int64)
    places = np.cumsum(_whole(row["places"], np.int32), dtype=np.int64)
    weights = None if row["weights"] is None else _whole(row["weights"], np.uint32).astype(np.int64)
    keys = None
    if row["keys"] is not None:
        keys = _whole(row["keys"], np.uint32)
        if key_kind.names:
            words, keys = keys, np.zeros(n, key_kind)
            keys["a"], keys["b"] = words[: 2 * n].view(np.uint64), words[2 * n :]
    return keys, docs, hashes, places, weights


# --- which places have a key of an earlier document? ---------------------------------------------


def _differ(keys: np.ndarray) -> np.ndarray:
    """Where a sorted array has the first of equal keys."""
    new = np.ones(len(keys), bool)
    new[1:] = np.logical_or.reduce([keys[n][1:] != keys[n][:-1] for n in keys.dtype.names]) if keys.dtype.names else keys[1:] != keys[:-1]
    return new


def _least(keys, docs, hashes, places, weights) -> tuple:
    """Sorted by key, the entries of the least document of each (a place once), with the weight of all."""
    parts = [keys[n] for n in keys.dtype.names] if keys.dtype.names else [keys]
    order = np.lexsort((places, hashes, docs, *parts[::-1]))
    keys, docs, hashes, places, weights = (x[order] for x in (keys, docs, hashes, places, weights))
    new = _differ(keys)
    at, key = np.flatnonzero(new), np.cumsum(new) - 1
    keep = docs == docs[at][key]
    keep[1:] &= new[1:] | (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1]) | (places[1:] != places[:-1])
    total = np.add.reduceat(weights, at)
    weights = np.where(new, total[key], 0)
    return keys[keep], docs[keep], hashes[keep], places[keep], weights[keep]


class _Index:
    """Entries of a bucket, merged now and then to those of the least document of each key."""

    def __init__(self):
        self.held, self.size, self.least = [], 0, None

    def add(self, entries: tuple) -> None:
        self.held.append(entries)
        self.size += len(entries[0])
        if self.size > HELD:
            self.settle()

    def settle(self) -> tuple | None:
        if self.held:
            parts = ([self.least] if self.least else []) + self.held
            self.least, self.held, self.size = _least(*(np.concatenate(x) for x in zip(*parts))), [], 0
            self.new = _differ(self.least[0])
            self.first = np.flatnonzero(self.new)
            self.keys = self.least[0][self.first]
        return self.least

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a key is there, and its number among the keys."""
        names = keys.dtype.names
        at = np.searchsorted(self.keys["a"] if names else self.keys, keys["a"] if names else keys)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == keys
        if names:  # keys that agree in their first 64 bits follow each other
            for k in np.flatnonzero((self.keys["a"][at] == keys["a"]) & ~found):
                i = at[k]
                while i < len(self.keys) and self.keys["a"][i] == keys["a"][k] and not found[k]:
                    found[k], at[k] = self.keys[i] == keys[k], i
                    i += 1
        return found, at


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind")


def _merged(rows: DataFrame, key_kind, hot_from: int, back: bool) -> DataFrame:
    """The index: rows as they came merged within their bucket, and the hot keys with their least documents.

    Without ``back`` one entry a key is enough, and none of keys that one place has.
    """

    def run(batches):
        index, bucket = _Index(), None

        def out():
            keys, docs, hashes, places, weights = index.settle()
            first = index.first[weights[index.first] >= hot_from]
            hot = [(bucket, 9, _planes(_flat(keys[first])), _planes(_steps(docs[first])), b"", _planes(np.zeros(len(first), np.int32)), None)] if len(first) else []
            if not back:
                some = index.first[weights[index.first] > 1]
                keys, docs, hashes, places = keys[some], docs[some], hashes[some], places[some]
            order = np.lexsort((places, hashes, docs))
            yield from _packed(INDEX, np.full(len(keys), bucket), *(x[order] for x in (keys, docs, hashes, places)))
            yield from _batches(hot, [pa.int32(), pa.int8(), *[pa.binary()] * 5], _COLUMNS)

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket and bucket is not None:
                    yield from out()
                    index = _Index()
                bucket = row["bucket"]
                index.add(_unpacked(row, key_kind))
        if bucket is not None:
            yield from out()

    return _by_bucket(rows).mapInArrow(run, _DDL)


class _Hot:
    """The hot keys of a question, with their least documents: SHARE at most."""

    def __init__(self, rows: list, key_kind):
        parts = [(np.full(len(x[1]), r["bucket"]), *x[:2]) for r in rows for x in [_unpacked(r.asDict(), key_kind)]]
        self.n = sum(len(p[1]) for p in parts)
        if self.n:
            bucket, keys, docs = (np.concatenate(x) for x in zip(*parts))
            handles = self.handle(bucket, keys)
            order = np.argsort(handles)
            self.handles, self.keys, self.docs = handles[order], keys[order], docs[order]

    @staticmethod
    def handle(bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return keys["a"] ^ keys["b"].astype(np.uint64) if keys.dtype.names else (bucket.astype(np.uint64) << _U(32)) | keys

    def find(self, bucket: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a key is hot, and its least document."""
        if not self.n:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        handles = self.handle(bucket, keys)
        at = np.searchsorted(self.handles, handles)
        at[at == self.n] = 0
        return (self.handles[at] == handles) & (self.keys[at] == keys), self.docs[at]


def _earlier(docs: DataFrame, index_of: Callable, probes_of: Callable, key_kind, buckets: int, hot_from: int, overlap: int, with_hash: bool, back: bool) -> DataFrame:
    """doc_id, text_hash, places (packed) of the probes whose key a document of a smaller id has in the index.

    index_of, probes_of: Gathered -> positions among its words, and their 64-bit hashes (two of them for wide keys).
    With ``back`` also the index's places that others ask for.  Without ``with_hash`` rows of one id are one document.
    """

    def keyed(found: Gathered, at: np.ndarray, hashes: tuple) -> tuple:
        bucket = ((hashes[0] & _U(0xFFFFFFFF)) % _U(buckets)).astype(np.int32)
        keys = np.zeros(len(at), key_kind)
        if key_kind.names:
            keys["a"], keys["b"] = hashes[0], (hashes[1] >> _U(32)).astype(np.uint32)
        else:
            keys[:] = hashes[0] >> _U(32)
        of = found.of[at]
        return bucket, keys, found.ids[of], found.hashes[of] if with_hash else np.zeros(len(at), np.int64), found.at[at]

    def send_index(batches):
        for found in _gathered(batches, 1, overlap):
            bucket, keys, ids, hashes, places = keyed(found, *index_of(found))
            if not len(keys):
                continue
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                mine = order[a:b]
                where = (hashes[mine], places[mine]) if back else (np.zeros(b - a, np.int64),) * 2
                least = _least(keys[mine], ids[mine], *where, np.ones(b - a, np.int64))
                by_doc = np.lexsort((least[3], least[2], least[1]))
                yield from _packed(INDEX, np.full(len(by_doc), bucket[mine[0]]), *(x[by_doc] for x in least))

    made = table(_merged(docs.mapInArrow(send_index, _DDL), key_kind, hot_from, back), "index", "zstd")
    hot = _Hot(made.filter("kind = 9").collect(), key_kind)  # SHARE keys at most

    def send_probes(batches):
        for found in _gathered(batches, 1, overlap):
            bucket, keys, ids, hashes, places = keyed(found, *probes_of(found))
            is_hot, least = hot.find(bucket, keys)
            known = is_hot & (least < ids)
            home = ids[known].view(np.uint64) % _U(buckets)
            yield from _packed(ANSWERED, home.astype(np.int32), None, ids[known], hashes[known], places[known])
            ask = ~is_hot
            yield from _packed(PROBE, bucket[ask], keys[ask], ids[ask], hashes[ask], places[ask])

    def answer(batches):
        index, used, bucket, answers, n = _Index(), None, None, [], 0

        def reply():
            if answers:
                yield from _homeward(*(np.concatenate(x) for x in zip(*answers)), buckets)
                answers.clear()

        def end():
            yield from reply()
            if not back or index.settle() is None:
                return
            keys, ids, hashes, places, _ = index.least
            mine = used if used is not None else np.zeros(len(index.keys), bool)
            mine |= hot.find(np.full(len(index.keys), bucket), index.keys)[0]
            rows = mine[np.cumsum(index.new) - 1]
            yield from _homeward(ids[rows], hashes[rows], places[rows], buckets)

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    yield from end()
                    index, used, bucket, n = _Index(), None, row["bucket"], 0
                keys, ids, hashes, places, _ = _unpacked(row, key_kind)
                if row["kind"] == INDEX:
                    index.add((keys, ids, hashes, places, np.zeros(len(keys), np.int64)))
                elif row["kind"] == ANSWERED:
                    answers.append((ids, hashes, places))
                elif index.settle() is not None:
                    found, at = index.find(keys)
                    found &= index.least[1][index.first[at]] < ids
                    if used is None:
                        used = np.zeros(len(index.keys), bool)
                    used[at[found]] = True
                    answers.append((ids[found], hashes[found], places[found]))
                n += len(answers[-1][0]) if answers else 0
                if n > HELD // 2:
                    yield from reply()
                    n = 0
        yield from end()

    rows = made.filter("kind = 0").unionByName(docs.mapInArrow(send_probes, _DDL))
    answers = _by_bucket(rows).mapInArrow(answer, _HOME_DDL)
    return answers.repartition("home").sortWithinPartitions("home").mapInArrow(_at_home, "doc_id long, text_hash long, places binary")


_HOME_DDL = "home int, docs binary, hashes binary, places binary"


def _once(docs: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different entries, in order."""
    order = np.lexsort((places, hashes, docs))
    docs, hashes, places = docs[order], hashes[order], places[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1]) | (places[1:] != places[:-1])
    return docs[new], hashes[new], places[new]


def _homeward(ids: np.ndarray, hashes: np.ndarray, places: np.ndarray, homes: int):
    """Answers, packed for the task in which the documents that they are for come together."""
    if len(ids):
        home = (_mixed(ids.view(np.uint64), 0xD6E8FEB86659FD93) % _U(homes)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        home, ids, hashes, places = home[order], ids[order], hashes[order], places[order]
        cuts = np.flatnonzero(np.diff(home, prepend=-1, append=-1))
        rows = [(int(home[a]), _planes(_steps(ids[a:b])), _planes(_steps(hashes[a:b])), _planes(_steps(places[a:b].astype(np.int32)))) for a, b in zip(cuts[:-1], cuts[1:])]
        yield from _batches(rows, [pa.int32(), *[pa.binary()] * 3], ["home", "docs", "hashes", "places"])


def _at_home(batches):
    held, home, size = [], None, 0

    def settled():
        return _once(*(np.concatenate(x) for x in zip(*held)))

    def out():
        docs, hashes, places = settled()
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
        cuts = np.append(np.flatnonzero(new), len(docs))
        rows = [(int(docs[a]), int(hashes[a]), _planes(_steps(places[a:b].astype(np.int32)))) for a, b in zip(cuts[:-1], cuts[1:])]
        yield from _batches(rows, [pa.int64(), pa.int64(), pa.binary()], ["doc_id", "text_hash", "places"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["home"] != home and held:
                yield from out()
                held, size = [], 0
            home = row["home"]
            held.append(_unpacked(row | {"keys": None, "weights": None}, NARROW)[1:4])
            size += len(held[-1][0])
            if size > HELD:  # repeated rows ask for the same
                held, size = [settled()], 0
    if held:
        yield from out()


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(_whole(packed, np.int32), dtype=np.int64)


# --- the operator --------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    letter = np.zeros(len(data) + 2, np.int8)
    letter[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(letter)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def join_words(data: bytes, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    """The kept words of a text with one space between them."""
    starts, ends = starts[keep], ends[keep]
    change = np.zeros(len(data) + 2, np.int8)
    # the byte before a word (one beyond the text's beginning) becomes its space
    change[starts] += 1
    change[ends + 1] -= 1
    raw = np.empty(len(data) + 1, np.uint8)
    raw[0], raw[1:] = 32, np.frombuffer(data, np.uint8)
    raw[starts] = 32
    return raw[np.cumsum(change[:-1], dtype=np.int8).astype(bool)].tobytes()[1:]


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, kept (text) and spans (start and end, in words, of the maximal repeats) of each
    document that loses words.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    mine = _keyed(docs)
    size = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one row
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, size // BUCKET)
    # a word has two bytes at least with its space, so there are no more than SHARE keys with so many places
    hot = lambda n: max(HOT, n // SHARE + 1)

    def block_starts(found):
        at = np.flatnonzero((found.at % block == 0) & (found.left >= block))
        return at, (run_hashes(found.words, block)[at],) if len(at) else (np.zeros(0, np.uint64),)

    def all_runs(found):
        at = np.flatnonzero((found.left >= block) & (found.sizes[found.of] >= window))
        return at, (run_hashes(found.words, block)[at],) if len(at) else (np.zeros(0, np.uint64),)

    def candidates(found):
        change = np.zeros(len(found.words) + 1, np.int64)
        ends = np.append(found.starts[1:], len(found.words))
        for start, end, offset, n, packed in zip(found.starts, ends, found.offsets, found.sizes, found.extra):
            places = _places(packed)
            low = np.maximum(np.maximum(places - (window - block), 0) - offset, 0)
            high = np.minimum(np.minimum(places, n - window) - offset, end - start - 1)
            some = low <= high
            np.add.at(change, start + low[some], 1)
            np.add.at(change, start + high[some] + 1, -1)
        at = np.flatnonzero((np.cumsum(change[:-1]) > 0) & (found.left >= window))
        if not len(at):
            return at, (np.zeros(0, np.uint64),) * 2
        return at, (run_hashes(found.words, window)[at], run_hashes(found.words, window, 0xA24BAED4963EE407)[at])

    hits = _earlier(mine, block_starts, all_runs, NARROW, buckets, hot(size // (2 * block)), window - 1, with_hash=False, back=True)
    near = _zipped(mine.filter("doc_id is not null")).join(hits.select("doc_id", "places"), "doc_id").select("doc_id", "text_hash", "text", "places")
    near = table(near, "candidates", "zstd")
    gone = _earlier(near, candidates, candidates, WIDE, buckets, hot(size // 2), window - 1, with_hash=True, back=False)
    gone = near.drop("places").join(gone, ["doc_id", "text_hash"])

    def apply(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text_hash, text, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1)), _bytes(batch.column(2)), batch.column(3).to_pylist()):
                starts, ends = _word_spans(text)
                places = _places(packed)
                first = np.flatnonzero(np.diff(places, prepend=-window - 1) > window)
                spans = list(zip(places[first].tolist(), (places[np.append(first[1:], len(places)) - 1] + window).tolist()))
                keep = np.ones(len(starts), bool)
                for a, b in spans:
                    keep[a:b] = False
                rows.append((doc_id, text_hash, len(starts), int((~keep).sum()), join_words(text, starts, ends, keep), [{"start": a, "end": b} for a, b in spans]))
            names = ["doc_id", "text_hash", "n_words", "n_removed", "kept", "spans"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            for out in _batches(rows, kinds, names):
                yield out.set_column(4, "kept", out.column(4).cast(pa.string()))

    found = gone.mapInArrow(apply, "doc_id long, text_hash long, n_words long, n_removed long, kept string, spans array<struct<start: long, end: long>>")
    return found.dropDuplicates(["doc_id", "text_hash"])


def plain_words(docs: DataFrame) -> DataFrame:
    """docs with the column n_words, and their words joined by one space in place of the text."""

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts, counts = [], []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                starts, ends = _word_spans(text or b"")
                counts.append(len(starts))
                texts.append(join_words(text or b"", starts, ends, np.ones(len(starts), bool)))
            columns = [*batch.columns, pa.array(counts, pa.int64())]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_words"])

    docs = docs.drop("n_words").withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in docs.dtypes) + ", n_words long")


def drop_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs without the words that an earlier document has in a window, with n_words (before) and n_removed.

    A text that loses words has one space between those that stay; other texts are as they were.
    """
    docs = docs.drop("n_words", "n_removed")
    names = docs.columns
    found = repeats(docs, window).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("kept").alias("__kept"), F.col("n_removed").alias("__gone"))
    mine = docs.withColumns({"__own": F.col("doc_id").cast("long"), "__text": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    joined = mine.join(found, (F.col("__own") == F.col("__id")) & (F.col("__text") == F.col("__hash")), "left")
    kept = [F.coalesce("__kept", F.col("text").cast("string")).alias("text") if c == "text" else F.col(c) for c in names]
    words = F.size(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^ \t-\r]+"), F.lit(0))).cast("long")
    return joined.select(*kept, words.alias("n_words"), F.coalesce("__gone", F.lit(0)).cast("long").alias("n_removed"))
