"""Retrieval: weighted BM25 over postings, exact cosine search, reciprocal rank fusion.

Statistics are those of the whole index, whatever filter a query has.  Both legs are branches of
one plan and end in TakeOrderedAndProject, so a query shuffles per-document partial scores at most.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.text import index_tokens

# Words that a keyword query drops, and the weights of the fields -----------
QUERY_STOPWORDS = """
    a an and are as at be been but by can could did do does doing for from had has have how i if in into is it its me
    my of on or our so some that the their them then there these they this those to us was we were what when where which
    who whom why will with would you your about again all also any because before being below between both during each
    few further here more most no nor not now only other over own same should such than too under until up very thing
    things stuff lot lots way ways better best good great nice really just get got want need make made like show tell
    find look see know""".split()
FIELD_WEIGHTS = {"title": 8.0, "summary": 6.0, "description": 4.0, "tags": 6.0, "entities": 5.0, "body": 1.0}
# -----------------------------------------------------------------------------------------
K1, B = 1.2, 0.75
RRF_K, KEYWORD_WEIGHT, VECTOR_WEIGHT, DEPTH = 60, 0.5, 1.0, 50


def compile_query(text: str, prefix_last: bool = True) -> list[tuple[str, bool]]:
    """(term, is prefix) pairs that a query asks for, joined by OR.

    The last word is a prefix while it is still being typed.  One-letter and function words go,
    function words come back when there is nothing else.
    """
    found = [t for t in re.split(r"[^\w]+", text.lower()) if t]
    typing = bool(found) and prefix_last and (text[-1].isalnum() or text[-1] == "_")
    whole, part = (found[:-1], found[-1]) if typing else (found, None)
    whole = [t for t in whole if len(t) > 1]
    terms = [(t, False) for t in whole if t not in QUERY_STOPWORDS]
    if not terms and part is None:
        terms = [(t, False) for t in whole]
    if part is not None and (len(part) > 1 or not terms):
        terms.append((part, True))
    return terms


def compile_queries(queries: DataFrame, key: str, column: str, prefix_last: bool = True) -> DataFrame:
    """(key, ordinal, term, is_prefix) of many queries: compile_query for a column of texts, in expressions."""
    q, length = F.coalesce(F.col(column), F.lit("")), F.length
    found = F.filter(F.split(F.lower(q), r"(?U)[^\w]+"), lambda w: w != "")
    rows = queries.select(key, found.alias("_f"), (F.lit(prefix_last) & q.rlike(r"(?U)\w\z")).alias("_typing"))
    whole = F.when(F.col("_typing"), F.slice("_f", F.lit(1), F.size("_f") - 1)).otherwise(F.col("_f"))
    rows = rows.select(key, "_typing", F.when(F.col("_typing"), F.element_at("_f", -1)).alias("_part"), F.filter(whole, lambda w: length(w) > 1).alias("_whole"))
    rows = rows.withColumn("_kept", F.filter("_whole", lambda w: ~w.isin(*QUERY_STOPWORDS)))
    none = F.size("_kept") == 0
    terms = F.when(none & ~F.col("_typing"), F.col("_whole")).otherwise(F.col("_kept"))
    last = F.col("_typing") & ((length("_part") > 1) | none)
    as_terms = lambda words, prefix: F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(prefix).alias("is_prefix")))
    both = F.concat(as_terms(terms, False), as_terms(F.when(last, F.array("_part")).otherwise(F.array().cast("array<string>")), True))
    return rows.select(key, F.posexplode(both).alias("ordinal", "t")).select(key, "ordinal", "t.term", "t.is_prefix")


def postings(docs: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, field, token, pos) of every token; the index table, best stored sorted by token."""
    parts = [docs.select(key, F.lit(name).alias("field"), F.posexplode(index_tokens(F.coalesce(F.col(name), F.lit("")))).alias("pos", "token")) for name in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def index_words(term: str) -> list[str]:
    """A query term as the index tokenizer splits and folds it."""
    from unicodedata import category, combining, normalize

    folded = "".join(c for c in normalize("NFD", term.lower()) if not combining(c))
    return "".join(c if category(c)[0] in "LN" or category(c) == "Co" else " " for c in folded).split()


def _phrase_counts(tokens: Column, term: str, prefix: bool) -> Column:
    """Occurrences of a term in a token array; a term that the index splits is a run of tokens."""
    words = index_words(term)
    if not words:
        return F.lit(0)
    if len(words) == 1:
        w = words[0]
        return F.size(F.filter(tokens, lambda t: t.startswith(w) if prefix else t == w))
    run = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    wanted = " " + "  ".join(words) + ("" if prefix else " ")
    return ((F.length(run) - F.length(F.replace(run, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")


def term_frequencies(docs: DataFrame, key: str, fields: dict[str, float], terms: list[tuple[str, bool]]) -> DataFrame:
    """One row a document: key, dl (tokens in all fields), f0.. (weighted frequency) and n0.. (has the term)."""
    # a generator row keeps the optimizer from copying the tokenizing into every count
    made = F.struct(*[index_tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"_{c}") for c in fields])
    out = docs.select(key, F.inline(F.array(made)))
    counts = [[_phrase_counts(F.col(f"_{c}"), t, p) for c in fields] for t, p in terms]
    dl = sum((F.size(f"_{c}") for c in fields), F.lit(0)).cast("double").alias("dl")
    freq = [sum((x * w for x, w in zip(row, fields.values())), F.lit(0.0)).alias(f"f{i}") for i, row in enumerate(counts)]
    return out.select(key, dl, *freq, *[sum(row, F.lit(0)).alias(f"n{i}") for i, row in enumerate(counts)])


def bm25(docs: DataFrame, key: str, terms: list[tuple[str, bool]], fields: dict[str, float] | None = None, limit: int | None = DEPTH, allowed: DataFrame | None = None) -> DataFrame:
    """(key, score) of the best documents for any of the terms; higher is better, ties by key.

    ``allowed`` (a table of keys) restricts the result and never the statistics, which come as one
    row from a partial aggregate.  The texts are tokenized once: statistics and hits read one exchange of narrow rows, a few
    numbers a document.  So that Spark sees it is the same, both need all of its columns, and the hits are
    picked by a condition that cannot move below it.
    """
    fields = fields or FIELD_WEIGHTS
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    tf = term_frequencies(docs, key, fields, terms).repartition(key)
    frequencies = [F.sum((F.col(f"n{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]
    every = F.max(F.xxhash64(*tf.columns)).alias("_every")
    stats = tf.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), every, *frequencies).filter("_every IS NOT NULL")
    found = sum((F.col(f"n{i}") for i in range(len(terms))), F.lit(0))
    scored = tf.crossJoin(F.broadcast(stats)).filter(found * F.col("n_docs") > 0)  # one row
    if allowed is not None:
        scored = scored.join(allowed.select(key), key, "left_semi")
    total = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = F.col(f"f{i}")
        total = total + F.when(F.col(f"n{i}") > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    out = scored.select(key, total.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def build_index(docs: DataFrame, key: str, fields: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored form of the keyword index: postings(token, key, field, positions) and lengths(key, dl).

    Written sorted by token, a query reads the row groups of its tokens alone; texts are tokenized
    when they are indexed and never again.
    """
    fields = fields or FIELD_WEIGHTS
    grouped = postings(docs, key, fields).groupBy("token", key, "field").agg(F.sort_array(F.collect_list("pos")).alias("positions"))  # one token of one field of one document
    made = F.struct(*[F.size(index_tokens(F.coalesce(F.col(c), F.lit("")))).alias(f"_{i}") for i, c in enumerate(fields)])
    lengths = docs.select(key, F.inline(F.array(made))).select(key, sum((F.col(f"_{i}") for i in range(len(fields))), F.lit(0)).cast("double").alias("dl"))
    return grouped, lengths


def bm25_from_index(index: tuple[DataFrame, DataFrame], key: str, terms: list[tuple[str, bool]], fields: dict[str, float] | None = None, limit: int | None = DEPTH, allowed: DataFrame | None = None) -> DataFrame:
    """The same (key, score) as bm25, from a stored index: reads the terms' postings only.

    A phrase meets the postings of its words by document and field.  Document frequencies are a row a term,
    the length statistics one row.
    """
    fields = fields or FIELD_WEIGHTS
    stored, lengths = index
    weight = F.create_map(*[F.lit(x) for p in fields.items() for x in p])[F.col("field")]
    found = []
    for i, (term, prefix) in enumerate(terms):
        words = index_words(term)
        if not words:
            continue
        of = lambda w, p: stored.filter(F.col("token").startswith(w) if p else F.col("token") == w).select(key, "field", "positions")
        rows = of(words[0], prefix and len(words) == 1)
        for n, w in enumerate(words[1:], 1):
            after = of(w, prefix and n == len(words) - 1).groupBy(key, "field").agg(F.flatten(F.collect_list("positions")).alias("_after"))
            here = F.array_intersect("positions", F.transform("_after", _back(n)))
            rows = rows.join(after, [key, "field"]).withColumn("positions", here).drop("_after").filter(F.size("positions") > 0)
        found.append(rows.groupBy(key).agg(F.sum(F.size("positions") * weight).alias("f")).withColumn("term", F.lit(i)))
    if not found:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    scored = hits if allowed is None else hits.join(allowed.select(key), key, "left_semi")
    scored = scored.join(F.broadcast(df), "term").join(lengths, key).crossJoin(F.broadcast(stats))  # a row a term, one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = scored.groupBy(key).agg(F.sum(one).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def _back(n: int):
    return lambda p: p - n


def cosine(a: Column, b: Column) -> Column:
    """Dot product of L2-normalized arrays; a zero vector stays as it is."""
    d = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.coalesce(F.nullif(F.sqrt(d(x, x)), F.lit(0.0)), F.lit(1.0))
    return d(a, b) / (norm(a) * norm(b))


def _unit(query: list[float]):
    import numpy as np

    q = np.asarray(query, dtype=np.float64)
    return q / (np.linalg.norm(q) or 1.0)


def _similar(lists, q):
    """Cosine similarities of a column of arrays to a unit vector, and which arrays have its dimension."""
    import numpy as np

    offsets = lists.offsets.to_numpy()
    fits = (np.diff(offsets) == len(q)) & lists.is_valid().to_numpy(zero_copy_only=False)
    sim, ok = np.zeros(len(lists)), np.flatnonzero(fits)
    if len(ok):
        flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        rows = flat[offsets[ok][:, None] + np.arange(len(q))]
        norm = np.linalg.norm(rows, axis=1)
        sim[ok] = rows @ q / np.where(norm == 0, 1, norm)
    return sim, fits


def similarities(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """vectors with sim, their cosine similarity to the query: numpy over Arrow batches, no shuffle."""
    import pyarrow as pa

    q = _unit(query)
    at, rest = vectors.columns.index(column), [n for n in vectors.columns if n != column]

    def run(batches):
        for batch in batches:
            sim, fits = _similar(batch.column(at), q)
            out = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sim, mask=~fits)], names=[*rest, "sim"])

    kinds = ", ".join(f"`{k}` {v}" for k, v in vectors.dtypes if k != column)
    return vectors.mapInArrow(run, f"{kinds}, sim double")


class Nearest:
    """The nearest keys that a task has seen so far, each with its best similarity and the chunk that has it.

    A key among the ``limit`` best of all is among them in the task that has its best chunk: what is ahead of it there is
    ahead of it everywhere.  So a task need send no more rows than that.
    """

    def __init__(self, limit: int):
        self.limit, self.held = limit, None

    def add(self, keys, chunks, sim) -> None:
        """Arrow arrays of keys and chunks, a numpy array of their similarities."""
        import numpy as np
        import pyarrow as pa

        keep = ~np.isnan(sim)
        if self.held is not None and len(self.held) == self.limit:
            keep &= sim >= self.held["sim"][-1].as_py()
        some = pa.array(np.flatnonzero(keep))
        if not len(some):
            return
        rows = pa.table({"key": keys.take(some), "sim": pa.array(sim[keep]), "chunk": chunks.take(some)})
        rows = (rows if self.held is None else pa.concat_tables([self.held, rows])).sort_by([("sim", "descending"), ("chunk", "ascending")])
        of_key = rows["key"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        self.held = rows.take(pa.array(np.unique(of_key, return_index=True)[1])).sort_by([("sim", "descending"), ("key", "ascending")]).slice(0, self.limit).combine_chunks()

    def batches(self):
        return [] if self.held is None else self.held.to_batches()


def nearest_in_tasks(vectors: DataFrame, key: str, chunk: str, query: list[float], limit: int, column: str = "embedding") -> DataFrame:
    """(key, sim, chunk) of the nearest documents of each task, ``limit`` rows a task at most."""
    q, kinds = _unit(query), dict(vectors.dtypes)

    def run(batches):
        import numpy as np

        best = Nearest(limit)
        for batch in batches:
            sim, fits = _similar(batch.column(2), q)
            best.add(batch.column(0), batch.column(1), np.where(fits, sim, np.nan))
        yield from best.batches()

    out = vectors.select(key, chunk, column).mapInArrow(run, f"key {kinds[key]}, sim double, chunk {kinds[chunk]}")
    return out.withColumnsRenamed({"key": key, "chunk": chunk})


def best_chunk(sims: DataFrame, key: str, chunk: str) -> DataFrame:
    """Best similarity of each document, and the chunk that has it (ties: the smaller chunk)."""
    best = F.max(F.struct(F.col("sim"), (-F.col(chunk)).alias("c")))
    return sims.groupBy(key).agg(best.alias("b")).select(key, F.col("b.sim").alias("sim"), (-F.col("b.c")).alias(chunk))


def vector_search(vectors: DataFrame, key: str, chunk: str, query: list[float], limit: int = DEPTH, allowed: DataFrame | None = None) -> DataFrame:
    """(key, sim, chunk) of the nearest documents; allowed documents are picked before they are ranked.

    Vectors of another dimension, or not of numbers, are near to nothing.
    """
    rows = vectors if allowed is None else vectors.join(allowed.select(key), key, "left_semi")
    return best_chunk(nearest_in_tasks(rows, key, chunk, query, limit), key, chunk).orderBy(F.desc("sim"), F.asc(key)).limit(limit)


def ranked(hits: DataFrame, key: str, score: str) -> DataFrame:
    """(key, rank) from 1 of a leg's hits; a leg has at most its depth in rows."""
    return hits.select(key, F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))).alias("rank"))


def fuse(legs: dict[str, tuple[DataFrame, float]], key: str, k: int = RRF_K) -> DataFrame:
    """(key, score, best_rank, <leg>_rank): weighted reciprocal rank fusion; a leg of no weight takes no part."""
    names = list(legs)
    used = [df.select(key, "rank", F.lit(name).alias("leg"), F.lit(float(w)).alias("weight")) for name, (df, w) in legs.items() if w]
    if not used:
        raise ValueError("no leg has a weight")
    rows = used[0]
    for u in used[1:]:
        rows = rows.unionByName(u)
    return rows.groupBy(key).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"), *[F.min(F.when(F.col("leg") == n, F.col("rank"))).alias(f"{n}_rank") for n in names])


def top_fused(fused: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The best fused hits with their position: score, then best rank, then key."""
    top = fused.orderBy(F.desc("score"), F.asc("best_rank"), F.asc(key)).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("best_rank"), F.asc(key))))


def keys_with(meta: DataFrame, key: str, **equal) -> DataFrame | None:
    """Keys whose columns equal the given values; None when nothing is asked."""
    asked = {c: v for c, v in equal.items() if v is not None}
    if not asked:
        return None
    for c, v in asked.items():
        meta = meta.filter(F.col(c) == v)
    return meta.select(key).distinct()


def keys_with_tag(tags: DataFrame, key: str, tag: str) -> DataFrame:
    return tags.filter(F.col("tag") == tag).select(key).distinct()


def search(docs: DataFrame, vectors: DataFrame | None, key: str, chunk: str, text: str, query: list[float] | None = None, mode: str = "hybrid", fields: dict[str, float] | None = None, limit: int = 10, meta: DataFrame | None = None, tags: DataFrame | None = None, tag: str | None = None, index: tuple[DataFrame, DataFrame] | None = None, **equal) -> DataFrame:
    """(key, position, score, keyword_rank, vector_rank, sim, chunk): the whole search.

    Metadata filters act before each leg's depth.  A tag filter acts before the vector leg, and
    after the keyword leg's depth, which is observable.  Without vectors or a query vector hybrid search is
    keyword search.  With a stored index the documents are not tokenized again.
    """
    if mode not in ("hybrid", "keyword", "vector"):
        raise ValueError(f"unknown mode {mode!r}")
    depth = max(limit, DEPTH)
    by_meta = keys_with(meta, key, **equal) if meta is not None else None
    by_tag = keys_with_tag(tags, key, tag) if tag is not None else None
    legs = {}
    sims = None
    if mode != "vector":
        terms = compile_query(text)
        hits = bm25(docs, key, terms, fields, depth, by_meta) if index is None else bm25_from_index(index, key, terms, fields, depth, by_meta)
        hits = hits if by_tag is None else hits.join(by_tag, key, "left_semi")
        legs["keyword"] = (ranked(hits, key, "score"), KEYWORD_WEIGHT if mode == "hybrid" else 1.0)
    if mode != "keyword" and vectors is not None and query is not None:
        allowed = by_meta if by_tag is None else by_tag if by_meta is None else by_meta.join(by_tag, key, "left_semi")
        sims = vector_search(vectors, key, chunk, query, 3 * depth, allowed)
        legs["vector"] = (ranked(sims.orderBy(F.desc("sim"), F.asc(key)).limit(depth), key, "sim"), VECTOR_WEIGHT)
    out = top_fused(fuse(legs, key), key, limit)
    for name in ("keyword_rank", "vector_rank"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("int"))
    if sims is None:
        return out.withColumns({"sim": F.lit(None).cast("double"), chunk: F.lit(None).cast("long")})
    return out.join(sims, key, "left")


def hydrate(hits: DataFrame, docs: DataFrame, key: str, chunks: DataFrame | None = None, chunk: str | None = None) -> DataFrame:
    """Hits with their documents (a hit without one is lost, after the limit) and the text of their best chunk."""
    out = docs.join(F.broadcast(hits), key)  # hits are at most the search's limit
    return out if chunks is None else out.join(chunks, [key, chunk], "left")


def compare_modes(results: dict[str, DataFrame], key: str) -> DataFrame:
    """Result lists side by side, by position."""
    out = None
    for name, df in results.items():
        mine = df.select("position", F.col(key).alias(f"{name}_{key}"))
        out = mine if out is None else out.join(mine, "position", "full")
    return out
