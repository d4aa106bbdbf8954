"""Line deduplication over the whole corpus, returned as keep bitmaps.

Line hashes are range-partitioned with a secondary sort by document and position, so a
partition streams its keys in order.  The sort key holds the document too, hence a line
that a third of all documents share is cut into many partitions.  A task decides on the keys that lie whole
in its partition; the rows of its first and last key, and of keys with very many rows, go out open, and each of these
keys with one row of counts.  Those counts (a few a partition) are added up on the driver and decide on the open rows.

Lines are told apart by 128 bits of XXH3, rows of one doc_id by 64 bits of their text.  The lines are hashed once,
into a stored table: range partitioning reads its input twice.

Two laws: ``keep="first"`` keeps the first occurrence of every key; ``keep="none"`` drops
all lines of keys found in ``min_docs`` documents or more.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars``
stay; a repeated row (same doc_id and text) counts as one document; rows with one doc_id and
different texts are different documents; a null doc_id is an id like others; very long texts and very many
repeats of a line pass in streams; an empty table gives an empty result; further columns are kept by
``dedup_lines``, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices, table

#: Stripped at both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of one key that a task holds before it leaves them open.
HELD = 100_000
_KEY, _DOC = ["hash1", "hash2"], ["doc_id", "text_hash"]


def line_table(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """hash1, hash2, doc_id, text_hash, pos and n_lines of each line with a key of min_chars or more."""
    names = [*_KEY, *_DOC, "pos", "n_lines"]

    def run(batches):
        for batch in slices(batches):
            lists = pc.split_pattern(batch.column("text"), "\n")
            n_lines = pc.list_value_length(lists).to_numpy()
            keys = pc.ascii_lower(pc.ascii_trim(lists.flatten(), characters=SPACE))
            row = np.repeat(np.arange(batch.num_rows), n_lines)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
            some = np.flatnonzero(pc.utf8_length(keys).to_numpy() >= min_chars)
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(some)).to_pylist())), dtype=">i8").astype(np.int64).reshape(-1, 2)
            of = pa.array(row[some])
            columns = [pa.array(digests[:, 0]), pa.array(digests[:, 1]), batch.column("doc_id").take(of), batch.column("text_hash").take(of)]
            columns += [pa.array(pos[some].astype(np.int32)), pa.array(n_lines[row[some]].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return keyed.mapInArrow(run, "hash1 long, hash2 long, doc_id long, text_hash long, pos int, n_lines int")


class _Rows:
    """Some sorted rows: keys, documents (with a column that says whether the id is null), positions and lengths."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        ids = batch.column(2)
        return cls([batch.column(0).to_numpy(), batch.column(1).to_numpy(), pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), *(batch.column(i).to_numpy() for i in (3, 4, 5))])

    def __len__(self) -> int:
        return len(self.columns[0])

    def cut(self, a: int, b: int | None = None) -> _Rows:
        return _Rows([c[a:b] for c in self.columns])

    def plus(self, other: _Rows) -> _Rows:
        return _Rows([np.concatenate(x) for x in zip(self.columns, other.columns)])

    def key(self, i: int) -> tuple:
        return int(self.columns[0][i]), int(self.columns[1][i])

    def doc(self, i: int) -> str:
        return "|".join(str(c[i]) for c in self.columns[2:5])

    def begins(self, columns: int) -> np.ndarray:
        """Where any of the first columns changes."""
        out = np.ones(len(self), dtype=bool)
        if len(self):
            out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in self.columns[:columns]])
        return out


_FOUND = [("kind", pa.string()), ("hash1", pa.int64()), ("hash2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32()), ("part", pa.int32()), ("docs", pa.int64()), ("first_doc", pa.string()), ("last_doc", pa.string())]
_FOUND_DDL = "kind string, hash1 long, hash2 long, doc_id long, text_hash long, pos int, n_lines int, part int, docs long, first_doc string, last_doc string"


def _batch(kind: str, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, t) if k == "kind" else columns[k].cast(t) if k in columns else pa.nulls(n, t) for k, t in _FOUND], names=[k for k, _ in _FOUND])


def _lines_out(kind: str, rows: _Rows, which=slice(None)) -> pa.RecordBatch:
    """Rows that are lost, or open (then with their key and partition)."""
    c = [x[which] for x in rows.columns]
    key = {}
    if kind == "open":
        key = {"hash1": pa.array(c[0]), "hash2": pa.array(c[1]), "part": pa.array(np.full(len(c[0]), TaskContext.get().partitionId()))}
    return _batch(kind, len(c[0]), **key, doc_id=pa.array(c[2], mask=c[3]), text_hash=pa.array(c[4]), pos=pa.array(c[5]), n_lines=pa.array(c[6]))


class _Open:
    """A key of which a task sees a part: its documents so far, and which are the first and the last."""

    def __init__(self, rows: _Rows):
        self.key, self.docs, self.first, self.last = rows.key(0), 0, rows.doc(0), None

    def add(self, rows: _Rows) -> None:
        self.docs += int(rows.begins(5).sum()) - (self.last == rows.doc(0))
        self.last = rows.doc(len(rows) - 1)

    def out(self) -> pa.RecordBatch:
        one = lambda x: pa.array([x])
        return _batch("count", 1, hash1=one(self.key[0]), hash2=one(self.key[1]), part=one(TaskContext.get().partitionId()), docs=one(self.docs), first_doc=one(self.first), last_doc=one(self.last))


def _in_many(batches, min_docs: int):
    """For the law "none": rows of keys in min_docs documents or more."""
    held: _Rows | None = None  # the rows of the last key so far
    open_key: _Open | None = None  # that key, if its rows go out open
    first = True  # it is the partition's first key
    for batch in batches:
        rows = _Rows.of(batch)
        if not len(rows):
            continue
        if open_key is not None:
            begins = rows.begins(2)
            begins[0] = rows.key(0) != open_key.key
            end = int(begins.argmax()) if begins.any() else len(rows)
            if end:
                open_key.add(mine := rows.cut(0, end))
                yield _lines_out("open", mine)
            if end == len(rows):
                continue
            yield open_key.out()
            rows, open_key, first = rows.cut(end), None, False
        rows = held.plus(rows) if held is not None else rows
        at = np.flatnonzero(rows.begins(2))
        if first and len(at) > 1:
            mine = rows.cut(0, at[1])
            open_key = _Open(mine)
            open_key.add(mine)
            yield _lines_out("open", mine)
            yield open_key.out()
            open_key, first = None, False
            rows = rows.cut(at[1])
            at = at[1:] - at[1]
        docs = np.add.reduceat(rows.begins(5).astype(np.int64), at)
        yield _lines_out("lost", rows, np.repeat((docs >= min_docs)[:-1], np.diff(at)).nonzero()[0])
        held = rows.cut(at[-1])
        if len(held) > HELD:
            open_key = _Open(held)
            open_key.add(held)
            yield _lines_out("open", held)
            held = None
    if held is not None and open_key is None:
        open_key = _Open(held)
        open_key.add(held)
        yield _lines_out("open", held)
    if open_key is not None:
        yield open_key.out()


def _after_first(batches):
    """For the law "first": all rows of a key but its first; the first row of a partition is open.

    The counts say with which key a partition begins and ends.
    """
    last = None

    def end(key):
        return _batch("count", 1, hash1=pa.array([key[0]]), hash2=pa.array([key[1]]), part=pa.array([TaskContext.get().partitionId()]))

    for batch in batches:
        rows = _Rows.of(batch)
        if not len(rows):
            continue
        lose = ~rows.begins(2)
        if last is None:
            yield _lines_out("open", rows, slice(0, 1))
            yield end(rows.key(0))
        else:
            lose[0] = last == rows.key(0)
        last = rows.key(len(rows) - 1)
        yield _lines_out("lost", rows, lose.nonzero()[0])
    if last is not None:
        yield end(last)


def _going(counts: list, min_docs: int, keep: str) -> set[tuple]:
    """(hash1, hash2, part) of the open rows that go; part is -1 where those of all partitions do."""
    if keep == "none":
        docs: dict = {}
        last: dict = {}
        for r in counts:
            key = r["hash1"], r["hash2"]
            docs[key] = docs.get(key, 0) + r["docs"] - (last.get(key) == r["first_doc"])
            last[key] = r["last_doc"]
        return {(*key, -1) for key, n in docs.items() if n >= min_docs}
    ends: dict = {}  # part -> its first and last key
    for r in counts:
        ends.setdefault(r["part"], set()).add((r["hash1"], r["hash2"]))
    parts = sorted(ends)
    return {(*key, part) for before, part in zip(parts, parts[1:]) for key in ends[part] & ends[before]}


def lost_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first") -> DataFrame:
    """doc_id, text_hash, pos and n_lines of every line that goes."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*_KEY, *_DOC, "pos"]
    lines = table(line_table(docs, min_chars), "lines").repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = lines.mapInArrow((lambda batches: _in_many(batches, min_docs)) if keep == "none" else _after_first, _FOUND_DDL)
    found = table(found, "found")
    counts = found.filter("kind = 'count'").select(*_KEY, "part", "docs", "first_doc", "last_doc").orderBy("part", *_KEY).collect()  # a few a partition
    going = spark.createDataFrame(sorted(_going(counts, min_docs, keep)), "hash1 long, hash2 long, at int")
    fits = [F.col("open." + k) == F.col("going." + k) for k in _KEY] + [F.col("at").isin(-1) | (F.col("part") == F.col("at"))]
    columns = [*_DOC, "pos", "n_lines"]
    still = found.filter("kind = 'open'").alias("open").join(F.broadcast(going).alias("going"), fits, "left_semi")
    return found.filter("kind = 'lost'").select(*columns).unionByName(still.select(*columns))


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first") -> DataFrame:
    """doc_id, text_hash, n_lines and keep (a compressed bitmap, a bit for each line) of each
    document that loses a line; documents that lose none have no row.
    """
    lost = lost_lines(docs, min_docs, min_chars, keep)
    lost = lost.groupBy(*_DOC).agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("lost"))

    def pack(batches):
        for batch in batches:
            maps = []
            for n_lines, gone in zip(batch.column(2).to_pylist(), batch.column(3)):
                bits = np.ones(n_lines, dtype=bool)
                bits[gone.values.to_numpy()] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(maps, type=pa.binary())], names=["doc_id", "text_hash", "n_lines", "keep"])

    return lost.mapInArrow(pack, "doc_id long, text_hash long, n_lines int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with their kept text, and the columns n_lines and n_dropped (in place of any of these names)."""
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"__lines_id": F.col("doc_id").cast("long"), "__lines_hash": F.xxhash64(text)})
    maps = bitmaps.select(F.col("doc_id").alias("__lines_id2"), F.col("text_hash").alias("__lines_hash2"), F.col("keep").alias("__lines_keep"))
    joined = keyed.join(maps, F.col("__lines_id").eqNullSafe(F.col("__lines_id2")) & (F.col("__lines_hash") == F.col("__lines_hash2")), "left").select(*names, "__lines_keep")

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts, total, gone = [], [], []
            for t, keep in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                n = (t or "").count("\n") + 1
                if keep is None:
                    texts.append(t)
                    gone.append(0)
                else:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=n).astype(bool)
                    texts.append("\n".join(x for x, b in zip((t or "").split("\n"), bits) if b))
                    gone.append(n - int(bits.sum()))
                total.append(n)
            cols = [*batch.columns[: len(names)], pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64())]
            cols[at] = pa.array(texts, type=pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_lines", "n_dropped"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in docs.dtypes)
    return joined.mapInArrow(run, f"{kinds}, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first") -> DataFrame:
    """docs without their duplicate lines, with n_lines (before) and n_dropped."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep))
