"""Audit of how far the sources of a language differ in the words they use.

Terms are counted inside tasks, one row a (task, language, source, term), and those in enough documents of their
language are kept.  Each group (a language's source) then has a smoothed share for every kept term, an integer in units of
1 / ``scale``, so that all sums are exact.

All pairs of a language's groups are compared in tiles.  The vocabulary is cut into chunks of some thousand terms, the
counts of a group in a chunk are one packed vector, and the groups are cut into blocks.  A vector is replicated to the
tiles (block by block, span of chunks) that its block takes part in; a task holds one tile, whose size has a bound, goes
through the span's chunks one after the other, and adds up the submatrix of its pairs.  Terms that no group of a tile has
are not sent: they add the same amount each.

Defined results: a null text, language or source is an empty one; every row is a document, repeated rows too; a group
without any kept term has all shares equal; a language without kept terms has pairs of value 0 and no term rows; ties go
by the item's UTF-8 order; very long texts are counted piece by piece (what is held of a text is its distinct terms);
other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import slices, table

#: Bytes of terms: letters in lower case, bytes of other code points as they are; all else separates.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at once, and distinct terms that a task holds before it sends their counts.
PIECE, HELD = 1 << 20, 300_000
#: Terms of a chunk, chunks of a span, groups of a block: they bound what a tile's task holds.
CHUNK, SPAN, BLOCK = 2048, 8, 8

per = Window.partitionBy


def pieces(data: bytes, most: int = PIECE):
    """data in pieces of about most bytes, cut at spaces."""
    start = 0
    while len(data) - start > most:
        end = data.find(b" ", start + most)
        if end < 0:
            break
        yield data[start:end]
        start = end
    yield data[start:] if start else data


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents), a row or a few for each task and key."""

    def out(held: dict) -> pa.RecordBatch:
        sizes = [len(n) for n, _ in held.values()]
        at = np.repeat(np.arange(len(held)), sizes)
        langs, sources = (pa.array([k[i] for k in held], pa.string()).take(pa.array(at)) for i in (0, 1))
        terms = pa.array([t for n, _ in held.values() for t in n], pa.binary()).cast(pa.string())
        counts = pa.array([x for n, _ in held.values() for x in n.values()], pa.int64())
        seen = pa.array([d[t] for n, d in held.values() for t in n], pa.int64())
        return pa.RecordBatch.from_arrays([langs, sources, terms, counts, seen], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        held: dict = {}
        for batch in slices(batches):
            for text, lang, source in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, docs_of = held.setdefault((lang, source), (Counter(), Counter()))
                mine: set = set()
                for piece in pieces(text.translate(_BYTES)):
                    terms = piece.split()
                    n.update(terms)
                    mine.update(terms)
                docs_of.update(mine)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text.alias("text"), *_group()).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def kept_terms(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """lang, term, source, n, lang_n (the term's count in the language) and first (one source of a term has it true) of
    the terms in min_docs documents of their language or more.
    """
    of_term = per("lang", "term")
    # one exchange serves the sums of the sources and those of the term
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.select("lang", "term", "source", "n", F.sum("docs").over(of_term).alias("in_docs"), F.sum("n").over(of_term).alias("lang_n"), F.min("source").over(of_term).alias("least"))
    return counts.filter(F.col("in_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n", (F.col("source") == F.col("least")).alias("first"))


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), lang_total, v (kept terms of the language), g (the group's number
    in its language, from 0) and n_groups of every group that occurs.
    """
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"))
    groups = docs.select(*_group()).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "lang_total", "v")})
    return groups.withColumns({"g": F.row_number().over(per("lang").orderBy("source")) - 1, "n_groups": F.count("*").over(per("lang"))})


def share(count, total, v, smoothing: int, scale_digits: int = 9):
    """1 + floor(10 ** scale_digits * (count + smoothing) / (total + smoothing * v)), exactly and within 64 bits.

    The division goes by three digits at a time, so that counts up to 9e15 do not overflow.  For columns and numpy arrays.
    """
    plain = not isinstance(count, Column)
    div = (lambda a, b: a // b) if plain else (lambda a, b: F.call_function("div", a, b))
    x, d = count + smoothing, total + smoothing * v
    out, rest = div(x, d), x % d
    for _ in range(scale_digits // 3):
        rest = rest * 1000
        out, rest = out * 1000 + div(rest, d), rest % d
    return out + 1


def distinctive_terms(kept: DataFrame, groups: DataFrame, top: int = 50, smoothing: int = 5) -> DataFrame:
    """lang, source, item, value, rank: the terms that a group uses more than its language, by the difference."""
    both = kept.join(groups, ["lang", "source"])
    p, q = (share(F.col(n), F.col(t), F.col("v"), smoothing) for n, t in (("n", "total"), ("lang_n", "lang_total")))
    rows = both.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    # the limit also holds inside each task before the rows are dealt, so a group with a very large vocabulary sends few
    rank = F.row_number().over(per("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def _tile(smoothing: int, per_block: int):
    def run(rows: pa.Table) -> pa.Table:
        chunk, g = rows["chunk"].to_numpy(), rows["g"].to_numpy()
        head = np.flatnonzero(chunk < 0)
        head = head[np.argsort(g[head])]
        members, v = g[head], int(rows["v"][int(head[0])].as_py())
        totals = rows["total"].to_numpy()[head].astype(np.int64)
        none = share(np.zeros(len(head), np.int64), totals, v, smoothing) if v else np.zeros(len(head), np.int64)
        block, (i, j) = members // per_block, (rows["i"][0].as_py(), rows["j"][0].as_py())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sums, seen = np.zeros((len(left), len(right)), np.int64), 0
        vectors = rows["vector"].combine_chunks()
        for c in np.unique(chunk[chunk >= 0]):
            of = np.flatnonzero(chunk == c)
            some = vectors.take(pa.array(of))
            entries = some.flatten()
            at, n = entries.field("at").to_numpy(), entries.field("n").to_numpy()
            of_row = np.repeat(np.searchsorted(members, g[of]), np.diff(some.offsets.to_numpy()))
            terms, column = np.unique(at, return_inverse=True)
            shares = np.repeat(none[:, None], len(terms), axis=1)
            shares[of_row, column] = share(n, totals[of_row], v, smoothing)
            seen += len(terms)
            for k, a in enumerate(left):
                sums[k] += np.abs(shares[right] - shares[a]).sum(axis=1)
        a, b = (x.ravel() for x in np.meshgrid(members[left], members[right], indexing="ij"))
        use = a < b
        n = int(use.sum())
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * n, pa.string()), "a": a[use], "b": b[use], "part": sums.ravel()[use], "seen": np.full(n, seen, np.int64)})

    return run


def pair_divergences(kept: DataFrame, groups: DataFrame, smoothing: int = 5, chunk: int = CHUNK, span: int = SPAN, per_block: int = BLOCK) -> DataFrame:
    """lang, source, item (another source of the language) and value: the sum of the differences of all shares."""
    terms = kept.join(groups, ["lang", "source"]).select("lang", "term", "g", "n", "n_groups", "total", "v")
    terms = terms.withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / chunk)).cast("int"))
    terms = terms.withColumn("at", F.dense_rank().over(per("lang", "chunk").orderBy("term")) - 1)
    entry = F.struct("at", "n")
    vectors = terms.groupBy("lang", "chunk", "g", "n_groups", "total", "v").agg(F.collect_list(entry).alias("vector")).withColumn("span", F.expr(f"chunk div {span}"))
    spans = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("v") / (chunk * span))) - 1)
    empty = F.array().cast("array<struct<at: int, n: bigint>>")
    heads = groups.select("lang", F.lit(-1).alias("chunk"), "g", "n_groups", "total", "v", empty.alias("vector"), F.explode(spans).alias("span"))
    rows = heads.unionByName(vectors)
    block, other = F.expr(f"g div {per_block}"), F.col("other")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_groups - 1) div {per_block}"))))
    rows = rows.select("lang", F.least(block, other).alias("i"), F.greatest(block, other).alias("j"), "span", "chunk", "g", "total", "v", "vector")
    sums = rows.groupBy("lang", "i", "j", "span").applyInArrow(_tile(smoothing, per_block), "lang string, a int, b int, part long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    ends = F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("h")), F.struct(F.col("b").alias("g"), F.col("a").alias("h")))
    sums = sums.select("lang", "part", "seen", F.inline(ends))
    mine = groups.select("lang", "g", "source", "total", "v")
    others = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("total").alias("item_total"))
    both = sums.join(mine, ["lang", "g"]).join(others, ["lang", "h"])
    p, q = (share(F.lit(0), F.col(t), F.col("v"), smoothing) for t in ("total", "item_total"))
    rest = F.when(F.col("v") > 0, (F.col("v") - F.col("seen")) * F.abs(p - q)).otherwise(0)
    return both.select("lang", "source", "item", (F.col("part") + rest).alias("value"))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, smoothing: int = 5) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: the sources of a language by how far they are from each
    other, and the ``top`` terms of each.
    """
    kept = table(kept_terms(docs, min_docs), "terms")
    groups = table(group_table(docs, kept), "groups")
    rank = F.row_number().over(per("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_divergences(kept, groups, smoothing).withColumn("rank", rank)
    terms = distinctive_terms(kept, groups, top, smoothing)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
