"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Every text gets 128 MinHash values: 16 trees of labels, each eight values long, and a sketch of four bits a value.
   Equal texts (by 128 bits of SHA-256) are one node from here on.
2. The labels of all trees are sorted (range partitions): each tree is a trie, and texts that share a prefix stand
   side by side.
3. The matched prefix is shortened from the full label until the target recall is met.  Recall is measured: a
   bounded sample of texts (``PROBES``) is compared with all texts by sketch, and of what is alike the share is taken that
   shares a prefix of that length in some tree, each probe counting once.  ``PRIOR`` made-up links at the threshold
   itself, whose recall is known by formula, stand in where the sample says little, so a corpus with few copies gets the safe depth.
4. One walk over the sorted labels compares the sketches of texts that share the prefix; pairs that may
   reach the threshold join a candidate class.  Of a large group only overlapping runs of neighbours are
   compared; what these and the other trees have not joined into one class is then compared in blocks, its largest
   class against the others and the others among themselves, so a dense group never meets itself pair by pair.
   The same goes for groups at the edge of a partition.
5. The shingles of the texts of candidate classes alone are made again, and every pair of a class is
   verified exactly, in blocks that meet in pairs.  What leaves a block is a link count and a root for each text, never
   the pairs.
6. Verified links give the classes by connected components.

The counts of links ask for all pairs of a class of different near copies: that work grows with the square of its size, over
as many tasks as there are pairs of blocks.  Joins on a hot text or class are sort-merge joins whose other side has one row
a key; adaptive execution splits their hot partitions.

Words are runs of non-space characters, lower-cased; a text with fewer than n words is one shingle, one without
words is alike only to texts without words.

Defined results: a null text is empty; repeated rows and equal texts are copies of one another; rows with
a null doc_id take part (the class id is the least non-null id of the class, null if there is
none); very long texts are taken whole; an empty table gives an empty result; further columns, whatever their names, are
ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import shingles, slices, table
from larder.llm.components import components
from larder.llm.wordhash import WordArrays

TREES, DEPTH = 16, 8
#: Texts in a block at most, fewest texts for which a group is cut further to keep all tasks busy, and shingles in a block.
BLOCK_TEXTS, LEAST_TEXTS, BLOCK_SHINGLES = 256, 32, 1_000_000
#: The largest group of a prefix that is compared at once.
GROUP = 256
#: Texts that measure the recall, and made-up links at the threshold that keep it honest.
PROBES, PRIOR = 256, 50
#: Parts that the rows of a hot prefix are dealt to.
SALTS = 32
#: Bytes of a tree's label, two a value.
_LABEL = 2 * DEPTH

_MULTIPLIERS = (np.random.default_rng(7).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: How many of a byte's two halves are zero.
_ZERO_HALVES = np.array([(b >> 4 == 0) + (b & 15 == 0) for b in range(256)], dtype=np.uint8)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each of TREES * DEPTH permutations of the hashes."""
    out = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(out, np.multiply.outer(_MULTIPLIERS, hashes[at : at + 1024]).min(axis=1), out=out)
    return out


def labels_and_sketch(sig: np.ndarray) -> tuple[bytes, bytes]:
    """The labels of all trees (two bytes a value), and half a byte of each value."""
    mixed = (sig ^ (sig >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    halves = ((mixed >> np.uint64(12)) & np.uint64(15)).astype(np.uint8)
    return (mixed >> np.uint64(48)).astype(">u2").tobytes(), (halves[::2] << 4 | halves[1::2]).tobytes()


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the signature's values two sketches (last axis) share, chance ones included."""
    return _ZERO_HALVES[a ^ b].sum(axis=-1, dtype=np.uint8)


def values_for(similarity: float) -> int:
    """Shared values at which the estimated similarity is reached; a sixteenth of unequal values agree by chance."""
    return int(np.ceil(TREES * DEPTH * (similarity * 15 / 16 + 1 / 16) - 1e-9))


def found_at(similarity: float, depth: int) -> float:
    """The chance that a pair of this similarity shares a prefix so long in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def shortened(found: dict, threshold: float, recall: float) -> int:
    """The longest prefix with the target recall.

    ``found`` has the links of each probe by the longest prefix that they share in any tree (0: none).
    """
    depth = DEPTH
    while depth > 1:
        shares = [sum(n for d, n in links.items() if d >= depth) / sum(links.values()) for links in found.values()]
        if (sum(shares) + PRIOR * found_at(threshold, depth)) / (len(shares) + PRIOR) >= recall:
            break
        depth -= 1
    return depth


def _text_key():
    """128 bits that tell texts apart; a null text is an empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)), 1, 16)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key, labels (of all trees) and sketch of every row; no shuffle."""

    def run(batches):
        words = WordArrays()
        for batch in slices(batches):
            both = [labels_and_sketch(signature(shingles(found, n))) for found in words.of(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in both], pa.binary()) for i in (0, 1))], names=["doc_id", "key", "labels", "sketch"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, key binary, labels binary, sketch binary")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of values of one width, as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def measured(nodes: DataFrame, threshold: float) -> dict:
    """Probe -> {longest prefix shared with it in any tree: texts} of the texts alike to it by sketch."""
    probes = nodes.select("node", "labels", "sketch").orderBy(F.xxhash64("node"), "node").limit(PROBES).collect()
    if not probes:
        return {}
    ids = np.array([r["node"] for r in probes])
    labels = np.frombuffer(b"".join(r["labels"] for r in probes), dtype=">u2").reshape(-1, TREES, DEPTH)
    sketches = np.frombuffer(b"".join(r["sketch"] for r in probes), dtype=np.uint8).reshape(len(probes), -1)
    need = values_for(threshold)

    def run(batches):
        total = np.zeros((len(ids), DEPTH + 1), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                mine, sk = part.column(0).to_numpy(), _bytes(part.column(2), TREES * DEPTH // 2)
                text, probe = np.nonzero((shared(sk[:, None, :], sketches[None, :, :]) >= need) & (mine[:, None] != ids[None, :]))
                if len(text):
                    own = _bytes(part.column(1), TREES * _LABEL).view(">u2").reshape(-1, TREES, DEPTH)
                    same = np.logical_and.accumulate(own[text] == labels[probe], axis=2).sum(axis=2).max(axis=1)
                    np.add.at(total, (probe, same), 1)
        probe, depth = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(probe.astype(np.int32)), pa.array(depth.astype(np.int32)), pa.array(total[probe, depth])], names=["probe", "depth", "texts"])

    rows = nodes.select("node", "labels", "sketch").mapInArrow(run, "probe int, depth int, texts long")
    out: dict = {}
    for r in rows.groupBy("probe", "depth").agg(F.sum("texts").alias("texts")).collect():  # nine rows a probe at most
        out.setdefault(r["probe"], {})[r["depth"]] = r["texts"]
    return out


def tries(nodes: DataFrame) -> DataFrame:
    """tree, label, node and sketch of every text and tree, sorted: the forest, cut into range partitions."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("node", "sketch", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    label = F.substring(F.col("labels"), F.col("tree") * _LABEL + 1, F.lit(_LABEL))
    rows = rows.select("tree", label.alias("label"), "node", "sketch")
    return rows.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")


def _roots(alike: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The least node that each node of a block (or of each of many) reaches over the matrix of like pairs."""
    label = nodes.copy()
    top = np.iinfo(np.int64).max
    while True:
        near = np.minimum(label, np.where(alike, label[..., None, :], top).min(axis=-1))
        if (near == label).all():
            return label
        label = near


def _stars(nodes: np.ndarray, sketches: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from texts to the root of their part of a group, for many groups of one size."""
    a, b = [], []
    step = max(1, (1 << 24) // (nodes.shape[1] ** 2 * sketches.shape[2]))
    for at in range(0, len(nodes), step):
        some, sk = nodes[at : at + step], sketches[at : at + step]
        root = _roots(shared(sk[:, :, None, :], sk[:, None, :, :]) >= need, some)
        a.append(some[root != some])
        b.append(root[root != some])
    return np.concatenate(a), np.concatenate(b)


_WALK = "edge boolean, tree int, prefix binary, a long, b long, sketch binary"


def walk(sorted_rows: DataFrame, depth: int, need: int) -> DataFrame:
    """What the tries say at a depth: edges (a, b) between texts that share a prefix and so many values, and the rows
    (tree, prefix, a: node, sketch) of groups that are too large or that may go on in another partition.
    """
    kinds = [pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _WALK.split(", ")]

    def edges(a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), pa.nulls(n, kinds[1]), pa.nulls(n, kinds[2]), pa.array(a, kinds[3]), pa.array(b, kinds[4]), pa.nulls(n, kinds[5])], names=names)

    def left_over(keys, nodes, sketches):
        n = len(nodes)
        prefix = [k[4:].tobytes() for k in keys]
        tree = keys[:, 3].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(tree), pa.array(prefix, kinds[2]), pa.array(nodes), pa.nulls(n, kinds[4]), pa.array([s.tobytes() for s in sketches], kinds[5])], names=names)

    def columns(batch):
        tree = batch.column(0).to_numpy().astype(">i4").view(np.uint8).reshape(-1, 4)
        return [np.hstack([tree, _bytes(batch.column(1), _LABEL)[:, : 2 * depth]]), batch.column(2).to_numpy(), _bytes(batch.column(3), TREES * DEPTH // 2)]

    def large(group, told):
        """Runs of a large group that overlap by half; all its rows but those told already are left over."""
        keys, nodes, sketches = group
        for at in range(0, max(1, len(nodes) - GROUP // 2), GROUP // 2):
            yield edges(*_stars(nodes[None, at : at + GROUP], sketches[None, at : at + GROUP], need))
        yield left_over(keys[told:], nodes[told:], sketches[told:])

    def run(batches):
        held, told, edge = None, 0, True  # the open group, how many of its rows are told, whether it began the partition
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = columns(batch)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            begins = np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]).any(axis=1)]))
            sizes = np.diff([*begins, len(cols[1])])
            done = sizes[:-1]
            special = done > GROUP
            if len(done):
                special[0] |= edge or told > 0
            for i in np.flatnonzero(special):
                yield from large([c[begins[i] : begins[i] + done[i]] for c in cols], told if i == 0 else 0)
            for size in np.unique(done[~special & (done > 1)]):
                at = begins[:-1][~special & (done == size)][:, None] + np.arange(size)
                yield edges(*_stars(cols[1][at], cols[2][at], need))
            if len(done):
                told, edge = 0, False
            held = [c[begins[-1] :] for c in cols]
            if len(held[1]) > 2 * GROUP:
                yield from large(held, told)
                held, told = [c[-GROUP // 2 :] for c in held], GROUP // 2
        if held is not None:
            yield from large(held, told)

    return sorted_rows.mapInArrow(_gathered(run), _WALK)


def candidates(nodes: DataFrame, depth: int, least: float) -> DataFrame:
    """(node, root): classes of texts joined by estimated similarity of ``least`` or more and a shared prefix."""
    need = values_for(least)
    found = table(walk(tries(nodes), depth, need), "walk")
    first = table(components(found.filter("edge").select("a", "b")), "candidates")
    rest = found.filter("NOT edge").select(F.struct("tree", "prefix").alias("key"), F.col("a").alias("node"), "sketch")
    known = first.select("node", "root")
    rest = rest.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = rest.groupBy("key", "root").agg(F.count("*").alias("n"))
    by_key = by_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("in_major"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    # A prefix may be hot: its rows meet its one row of counts in many salts.
    counts = by_key.filter("roots > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(counts, ["key", "salt"]).drop("salt")
    rest = table(rest, "unjoined")
    if rest.isEmpty():
        return first
    more = components(_across(rest, need).select("a", "b"))
    more = more.select(F.col("node").alias("root"), F.col("root").alias("farther"))
    every = first.unionByName(more.select(F.col("root").alias("node"), "root").join(first, "node", "left_anti"))
    return table(every.join(more, "root", "left").select("node", F.coalesce("farther", "root").alias("root")), "candidates")


def _across(rest: DataFrame, need: int) -> DataFrame:
    """Edges between the classes (roots) of texts that share a prefix: each group's largest class against the others, and these
    among themselves, in pairs of blocks."""
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    major = F.col("root") == F.col("major")
    blocks_major, blocks_other = _blocks(F.col("in_major"), parts), _blocks(F.col("n") - F.col("in_major"), parts)
    hashed = F.xxhash64("node", F.lit(11))
    block = F.when(major, F.pmod(hashed, blocks_major)).otherwise(blocks_major + F.pmod(hashed, blocks_other)).cast("int")
    first = F.when(major, blocks_major).otherwise(F.lit(0)).cast("int")
    rest = rest.withColumns({"block": block, "other": F.explode(F.sequence(first, (blocks_major + blocks_other - 1).cast("int")))})
    rest = rest.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "root", "sketch")
    rest = rest.select(F.xxhash64("key").alias("group"), "key", "lo", "hi", "node", "root", "sketch")
    rest = rest.repartition(parts, "group", "lo", "hi").sortWithinPartitions("group", "key", "lo", "hi")
    rest = rest.select("group", "lo", "hi", F.col("key.tree").alias("tree"), F.hex("key.prefix").alias("prefix"), "root", "sketch")

    def run(batches):
        for parts in _groups(batches, 5):
            roots = np.concatenate([p.column(5).to_numpy() for p in parts])
            sk = np.concatenate([_bytes(p.column(6), TREES * DEPTH // 2) for p in parts])
            order = np.argsort(roots, kind="stable")
            roots, sk = roots[order], sk[order]
            for at in range(0, len(roots), 64):
                i, j = np.nonzero((shared(sk[at : at + 64, None, :], sk[None, :, :]) >= need) & (roots[at : at + 64, None] > roots[None, :]))
                pairs = np.unique(np.stack([roots[at + i], roots[j]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rest.mapInArrow(_gathered(run), "a long, b long").distinct()


def _blocks(texts, parts: int):
    """Blocks of a group: one if it is small, else so many that their pairs keep all partitions busy."""
    busy = F.least(F.ceil(texts / LEAST_TEXTS), F.lit(int(np.ceil((2 * parts) ** 0.5))))
    return F.when(texts <= BLOCK_TEXTS, F.lit(1)).otherwise(F.greatest(F.ceil(texts / BLOCK_TEXTS), busy))


def _block_pairs(rows: DataFrame, blocks) -> DataFrame:
    """Deals each row to the pairs of blocks that its block is part of: columns lo, hi and block."""
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    rows = rows.withColumn("other", other)
    return rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")


def _groups(batches, key_columns: int):
    """Runs of rows with equal keys, of batches that are sorted by them: lists of batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for i in range(key_columns):
            k = batch.column(i).to_numpy(zero_copy_only=False)
            new[1:] |= k[1:] != k[:-1]
        new[0] = not held or any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(key_columns))
        cuts = [*np.flatnonzero(new), batch.num_rows]
        if not new[0]:
            held.append(batch.slice(0, cuts[0]))
        for a, b in zip(cuts, cuts[1:]):
            if held:
                yield held
            held = [batch.slice(a, b - a)]
    if held:
        yield held


def _gathered(run, rows: int = 5000):
    """Joins the small batches that run gives."""

    def all_of(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if n:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return all_of


def verified(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """For the rows (root, node, text) of candidate classes: node, links, near (the least text reached in a
    block) and whole (all of its class was in one block).  Every pair of a class is compared exactly once.
    """

    def make(batches):
        words = WordArrays()
        for batch in slices(batches):
            sets = [np.unique(shingles(found, n)) for found in words.of(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["root", "node", "size", "shingles"])

    made = texts.select("root", "node", "text").mapInArrow(make, "root long, node long, size long, shingles binary")
    made = table(made, "shingles")
    if made.select("node").distinct().count() < made.count():  # repeated rows of one id and text
        made = table(made.dropDuplicates(["node"]), "shingles")
    sizes = made.groupBy("root").agg(F.count("*").alias("texts"), F.sum("size").alias("total"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.greatest(_blocks(F.col("texts"), parts), F.ceil(F.col("total") / BLOCK_SHINGLES))
    dealt = _block_pairs(made.join(sizes, "root"), blocks).withColumn("whole", blocks == 1).select("root", "lo", "hi", "block", "node", "shingles", "whole")
    dealt = dealt.repartition(parts, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")

    def run(batches):
        for group in _groups(batches, 3):
            get = lambda i: np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in group])
            lo, hi = group[0].column(1)[0].as_py(), group[0].column(2)[0].as_py()
            nodes, block, whole = get(4), get(3), get(6)
            sets = [np.frombuffer(x, dtype=np.uint64) for p in group for x in p.column(5).to_pylist()]
            alike = alike_sets(sets, threshold)
            if lo != hi:
                counts = (alike & (block[:, None] != block[None, :])).sum(axis=1)
            else:
                counts = alike.sum(axis=1)
            root = _roots(alike, nodes)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts.astype(np.int64)), pa.array(root), pa.array(whole)], names=["node", "links", "near", "whole"])

    return dealt.mapInArrow(_gathered(run), "node long, links long, near long, whole boolean")


def alike_sets(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sorted sets have a Jaccard similarity of the threshold or more (not a set with itself)."""
    m, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.float64)
    both = np.zeros((m, m))
    if m == 2:
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), sizes.astype(np.int64))
        column = np.cumsum(times > 1) - 1
        ok = times[where] > 1
        where, owner = column[where[ok]], owner[ok]
        order = np.argsort(where, kind="stable")
        where, owner = where[order], owner[order]
        for at in range(0, int(where[-1]) + 1 if len(where) else 0, 4096):
            a, b = np.searchsorted(where, [at, at + 4096])
            dense = np.zeros((m, min(4096, int(where[-1]) + 1 - at)), dtype=np.float32)
            dense[owner[a:b], where[a:b] - at] = 1
            both += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - both
    alike = both >= threshold * union - 1e-9
    np.fill_diagonal(alike, False)
    return alike


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """doc_id, key, class_node, class_id, n_links (different texts that are alike) and n_copies (other rows with
    the same text) of every row of docs.
    """
    rows = table(signatures(docs, n), "signatures")
    nodes = rows.groupBy("key").agg(F.first("labels").alias("labels"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first_id"), (F.count("*") - 1).alias("n_copies"))
    nodes = table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    depth = shortened(measured(nodes, threshold), threshold, recall)
    margin = 4 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5
    classes = candidates(nodes, depth, threshold - margin)
    # one row of each text in a candidate class, with its text
    wanted = classes.join(nodes.select("node", F.col("key").alias("key2"), "first_id"), "node")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("key2"))).select("root", "node", "text")
    found = table(verified(texts, n, threshold), "verified")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("near").alias("near"), F.first("whole").alias("whole"))
    rest = components(found.filter("NOT whole").select(F.col("node").alias("a"), F.col("near").alias("b")))
    links = links.join(rest.select("node", F.col("root").alias("far")), "node", "left")
    links = links.select("node", "n_links", F.coalesce("far", F.when(F.col("whole"), F.col("near")), F.col("node")).alias("class_node"))
    texts = nodes.select("node", "key", "n_copies", "first_id").join(links, "node", "left")
    texts = texts.select("key", "n_copies", "first_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_node", "node").alias("class_node"))
    texts = table(texts, "texts")
    ids = texts.groupBy("class_node").agg(F.min("first_id").alias("class_id"))
    texts = texts.join(ids, "class_node").select("key", "class_node", "class_id", "n_links", "n_copies")
    return rows.select("doc_id", "key").join(texts, "key").select("doc_id", "key", "class_node", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class: a row with the class's id (where all ids are null, any)."""
    names = docs.columns
    classes = jaccard_classes(docs, n, threshold).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    chosen = classes.groupBy("class_node").agg(F.min(F.struct("key", "class_id")).alias("best"), F.count("*").alias("rows"))
    chosen = table(chosen.select(F.col("best.key").alias("__near_key2"), F.col("best.class_id").alias("__near_id2"), F.col("rows").alias("__near_rows")), "chosen")
    keyed = docs.withColumns({"__near_id": F.col("doc_id").cast("long"), "__near_key": _text_key()})
    out = keyed.join(chosen, F.col("__near_id").eqNullSafe(F.col("__near_id2")) & (F.col("__near_key") == F.col("__near_key2")))
    if chosen.filter("__near_rows > 1").isEmpty():
        return out.select(*names)
    many = out.filter("__near_rows > 1").dropDuplicates(["__near_id", "__near_key"])
    return out.filter("__near_rows = 1").select(*names).unionByName(many.select(*names))
