"""Search queries: keyword, vector, fused; filters before and after the depth."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators import retrieval as R
from larder.operators import vectors as V
from larder.plans.common import Query, bm25_sql, read, shared_folder, texts

#: The battery: common word parts of the synthetic corpus, and a word that queries drop.
TEXT = "thing thnd erre "
TERMS = R.compile_query(TEXT)
BODY = {"body": 1.0}
BODY_SQL = {"body": ("text", 1.0)}
TWO = {"title": 8.0, "body": 1.0}
TWO_SQL = {"title": ("split_part(text, '.', 1)", 8.0), "body": ("text", 1.0)}


def _docs(spark, d):
    return texts(spark, d).select("doc_id", F.col("text").alias("body"), F.split("text", r"\.").getItem(0).alias("title"), "lang", "source")


def _vectors(spark, d, per_doc=1):
    return read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / per_doc).cast("long").alias("doc_id"), F.col("vec_id").alias("chunk"), "embedding", "label")


def _query(spark, d):
    """The query vector: the embedding of vector 0."""
    row = read(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else [1.0] * 64


def _ranked(df, score, key="doc_id"):
    return df.select(key, F.round(score, 6).alias(score), F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))).alias("rank"))


_RANK = "row_number() OVER (ORDER BY score DESC, doc_id)"
_SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_SIMS = f"sims AS (SELECT e.vec_id AS doc_id, e.vec_id AS chunk, e.label, {_SIM} AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_KW50 = "kw AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored QUALIFY r <= 50)"
_VEC50 = "vec AS (SELECT doc_id, sim, row_number() OVER (ORDER BY sim DESC, doc_id) AS r FROM sims QUALIFY r <= 50)"


def bm25_topk(spark, d):
    return _ranked(R.bm25(_docs(spark, d), "doc_id", TERMS, BODY, 10), "score")


def bm25_weighted_columns(spark, d):
    return _ranked(R.bm25(_docs(spark, d), "doc_id", TERMS, TWO, 20), "score")


def bm25_prefix(spark, d):
    return _ranked(R.bm25(_docs(spark, d), "doc_id", R.compile_query("erst thn"), BODY, 20), "score")


def bm25_indexed(spark, d):
    """The weighted search from a stored index instead of the texts."""
    index = R.build_index(_docs(spark, d), "doc_id", TWO)
    return _ranked(R.bm25_from_index(index, "doc_id", TERMS, TWO, 20), "score")


def bm25_indexed_phrase(spark, d):
    index = R.build_index(_docs(spark, d), "doc_id", BODY)
    return _ranked(R.bm25_from_index(index, "doc_id", [("of_the", False)], BODY, 20), "score")


def _good(spark, d):
    return read(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()


def bm25_filtered(spark, d):
    return _ranked(R.bm25(_docs(spark, d), "doc_id", TERMS, BODY, 20, _good(spark, d)), "score")


def bm25_phrase(spark, d):
    """A term with an underscore is a phrase of two index tokens."""
    return _ranked(R.bm25(_docs(spark, d), "doc_id", [("of_the", False)], BODY, 20), "score")


def postings_stats(spark, d):
    p = R.postings(_docs(spark, d), "doc_id", BODY)
    return p.groupBy("token").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("docs"))


def vector_topk(spark, d):
    return _ranked(R.vector_search(_vectors(spark, d), "doc_id", "chunk", _query(spark, d), 10), "sim")


def vector_max_over_chunks(spark, d):
    hits = R.vector_search(_vectors(spark, d, 5), "doc_id", "chunk", _query(spark, d), 20)
    return hits.select("doc_id", F.round("sim", 6).alias("sim"), "chunk")


def vector_filtered(spark, d):
    v = _vectors(spark, d)
    return _ranked(R.vector_search(v, "doc_id", "chunk", _query(spark, d), 20, R.keys_with(v, "doc_id", label=3)), "sim")


def vector_signatures(spark, d):
    """Vectors by model and dimension; the label stands for the model."""
    v = read(spark, d, "embeddings").select(F.concat(F.lit("model-"), (F.col("label") % 2).cast("string")).alias("model"), F.size("embedding").alias("dim"))
    return v.groupBy("model", "dim").agg(F.count("*").alias("vectors"))


def _stored_vectors(spark, d):
    """The embeddings of two models written as blocks; where they are."""
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("chunk"), F.concat(F.lit("model-"), (F.col("label") % 2).cast("string")).alias("model"), "embedding")
    V.write_blocks(v, path, "doc_id", "chunk")
    return path


def vector_blocks(spark, d):
    """The nearest vectors of one of two stored models: the scan reads that model's folder only."""
    q = _query(spark, d)
    blocks = V.read_blocks(spark, _stored_vectors(spark, d), "model-0", len(q), "bigint")
    return _ranked(V.search_blocks(blocks, q, 25, "doc_id"), "sim")


def vector_blocks_filtered(spark, d):
    """The same among the documents of good quality."""
    q = _query(spark, d)
    blocks = V.read_blocks(spark, _stored_vectors(spark, d), "model-1", len(q), "bigint")
    return _ranked(V.search_blocks(blocks, q, 25, "doc_id", allowed=_good(spark, d)), "sim")


def stored_signatures(spark, d):
    return V.signatures(spark, _stored_vectors(spark, d), "bigint")


def _legs(spark, d, kw=R.KEYWORD_WEIGHT, vec=R.VECTOR_WEIGHT):
    k = R.ranked(R.bm25(_docs(spark, d), "doc_id", TERMS, BODY), "doc_id", "score")
    v = R.ranked(R.vector_search(_vectors(spark, d), "doc_id", "chunk", _query(spark, d)), "doc_id", "sim")
    return {"keyword": (k, kw), "vector": (v, vec)}


def rrf_hybrid(spark, d):
    """The whole hybrid search with hydration: position, score, both ranks and the document's columns."""
    hits = R.search(_docs(spark, d), _vectors(spark, d), "doc_id", "chunk", TEXT, _query(spark, d), "hybrid", BODY, 10)
    out = R.hydrate(hits, _docs(spark, d).select("doc_id", "lang", "source"), "doc_id")
    return out.select("position", "doc_id", F.round("score", 6).alias("score"), "keyword_rank", "vector_rank", F.round("sim", 6).alias("sim"), "lang", "source")


def rrf_weights(spark, d):
    """Equal weights, and a leg of no weight."""
    even = R.top_fused(R.fuse(_legs(spark, d, 1.0, 1.0), "doc_id"), "doc_id", 20).withColumn("setting", F.lit("even"))
    alone = R.top_fused(R.fuse(_legs(spark, d, 0.0, 1.0), "doc_id"), "doc_id", 20).withColumn("setting", F.lit("vector only"))
    return even.unionByName(alone).select("setting", "position", "doc_id", F.round("score", 6).alias("score"))


def mode_compare(spark, d):
    run = lambda mode: R.search(_docs(spark, d), _vectors(spark, d), "doc_id", "chunk", TEXT, _query(spark, d), mode, BODY, 10)
    return R.compare_modes({m: run(m) for m in ("hybrid", "keyword", "vector")}, "doc_id")


def _tags(spark, d):
    return read(spark, d, "documents").select("doc_id", F.col("lang").alias("tag"))


def tag_post_filter(spark, d):
    """A tag takes keyword hits away after the depth: fewer may be left than exist."""
    hits = R.bm25(_docs(spark, d), "doc_id", TERMS, BODY, 50).join(R.keys_with_tag(_tags(spark, d), "doc_id", "en"), "doc_id", "left_semi")
    return _ranked(hits, "score")


def meta_pre_filter(spark, d):
    """The same restriction as a metadata filter acts before the depth."""
    return _ranked(R.bm25(_docs(spark, d), "doc_id", TERMS, BODY, 50, R.keys_with(_docs(spark, d), "doc_id", lang="en")), "score")


def allowed_intersection(spark, d):
    """Metadata keys and tagged keys met."""
    meta = R.keys_with(_docs(spark, d), "doc_id", source="src0")
    return meta.join(R.keys_with_tag(_tags(spark, d), "doc_id", "en"), "doc_id", "left_semi").join(_good(spark, d), "doc_id", "left_semi")


def found_by(spark, d):
    from larder.functions.envelope import found_by as how

    hits = R.search(_docs(spark, d), _vectors(spark, d), "doc_id", "chunk", TEXT, _query(spark, d), "hybrid", BODY, 40)
    return hits.groupBy(how(F.col("keyword_rank"), F.col("vector_rank")).alias("found_by")).agg(F.count("*").alias("hits"))


_TOP = lambda n, where="": f"SELECT doc_id, round(score, 6) AS score, {_RANK} AS rank FROM scored {where} QUALIFY rank <= {n}"
_HYBRID = f"""WITH {bm25_sql('documents', 'doc_id', BODY_SQL, TERMS)}, {_SIMS}, {_KW50}, {_VEC50},
    u AS (SELECT doc_id, r, 0.5 AS w, 'k' AS leg FROM kw UNION ALL SELECT doc_id, r, 1.0, 'v' FROM vec),
    f AS (SELECT doc_id, sum(w / (60 + r)) AS score, min(r) AS best, min(r) FILTER (leg = 'k') AS keyword_rank, min(r) FILTER (leg = 'v') AS vector_rank FROM u GROUP BY doc_id),
    p AS (SELECT *, row_number() OVER (ORDER BY score DESC, best, doc_id) AS position FROM f)"""

_PHRASE = r"""
        WITH t AS (SELECT doc_id, ' ' || array_to_string([x FOR x IN regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+') IF x <> ''], '  ') || ' ' AS s,
                          len([x FOR x IN regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+') IF x <> ''])::DOUBLE AS dl FROM documents),
        tf AS (SELECT doc_id, dl, ((length(s) - length(replace(s, ' of  the ', ''))) / 9)::DOUBLE AS f FROM t),
        st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (f > 0)::DOUBLE AS d FROM tf),
        scored AS (SELECT doc_id, (CASE WHEN ln((n - d + 0.5) / (d + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d + 0.5) / (d + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM tf, st WHERE f > 0)
        """ + _TOP(20)
_ENGLISH = "WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"

QUERIES = [
    Query("bm25_topk", bm25_topk, f"WITH {bm25_sql('documents', 'doc_id', BODY_SQL, TERMS)} {_TOP(10)}"),
    Query("bm25_weighted_columns", bm25_weighted_columns, f"WITH {bm25_sql('documents', 'doc_id', TWO_SQL, TERMS)} {_TOP(20)}"),
    Query("bm25_indexed", bm25_indexed, f"WITH {bm25_sql('documents', 'doc_id', TWO_SQL, TERMS)} {_TOP(20)}"),
    Query("bm25_prefix", bm25_prefix, f"WITH {bm25_sql('documents', 'doc_id', BODY_SQL, R.compile_query('erst thn'))} {_TOP(20)}"),
    Query("bm25_filtered", bm25_filtered, f"WITH {bm25_sql('documents', 'doc_id', BODY_SQL, TERMS)} {_TOP(20, 'WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)')}"),
    Query("bm25_phrase", bm25_phrase, _PHRASE),
    Query("bm25_indexed_phrase", bm25_indexed_phrase, _PHRASE),
    Query("postings_stats", postings_stats, r"""
        WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+')) AS token FROM documents)
        SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM t WHERE token <> '' GROUP BY token"""),
    Query("vector_topk", vector_topk, f"WITH {_SIMS} SELECT doc_id, round(sim, 6) AS sim, row_number() OVER (ORDER BY sim DESC, doc_id) AS rank FROM sims QUALIFY rank <= 10"),
    Query("vector_max_over_chunks", vector_max_over_chunks, f"""
        WITH {_SIMS}, b AS (SELECT chunk // 5 AS doc_id, sim, chunk, row_number() OVER (PARTITION BY chunk // 5 ORDER BY sim DESC, chunk) AS r FROM sims)
        SELECT doc_id, round(sim, 6) AS sim, chunk FROM b WHERE r = 1 ORDER BY b.sim DESC, doc_id LIMIT 20"""),
    Query("vector_filtered", vector_filtered, f"WITH {_SIMS} SELECT doc_id, round(sim, 6) AS sim, row_number() OVER (ORDER BY sim DESC, doc_id) AS rank FROM sims WHERE label = 3 QUALIFY rank <= 20"),
    Query("vector_signatures", vector_signatures, "SELECT 'model-' || (label % 2) AS model, len(embedding)::INTEGER AS dim, count(*) AS vectors FROM embeddings GROUP BY 1, 2"),
    Query("vector_blocks", vector_blocks, f"WITH {_SIMS} SELECT doc_id, round(sim, 6) AS sim, row_number() OVER (ORDER BY sim DESC, doc_id) AS rank FROM sims WHERE label % 2 = 0 QUALIFY rank <= 25"),
    Query("vector_blocks_filtered", vector_blocks_filtered, f"WITH {_SIMS} SELECT doc_id, round(sim, 6) AS sim, row_number() OVER (ORDER BY sim DESC, doc_id) AS rank FROM sims WHERE label % 2 = 1 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) QUALIFY rank <= 25"),
    Query("stored_signatures", stored_signatures, "SELECT 'model-' || (label % 2) AS model, len(embedding)::INTEGER AS dim, count(*) AS vectors FROM embeddings GROUP BY 1, 2"),
    Query("rrf_hybrid", rrf_hybrid, f"""{_HYBRID}, near AS (SELECT doc_id, sim, row_number() OVER (ORDER BY sim DESC, doc_id) AS r FROM sims)
        SELECT position, p.doc_id AS doc_id, round(p.score, 6) AS score, keyword_rank, vector_rank, round(near.sim, 6) AS sim, lang, source
        FROM p JOIN documents USING (doc_id) LEFT JOIN near ON near.doc_id = p.doc_id AND near.r <= 150 WHERE position <= 10"""),
    Query("rrf_weights", rrf_weights, f"""{_HYBRID},
        e AS (SELECT doc_id, sum(1.0 / (60 + r)) AS score, min(r) AS best FROM u GROUP BY doc_id)
        SELECT 'even' AS setting, row_number() OVER (ORDER BY score DESC, best, doc_id) AS position, doc_id, round(score, 6) AS score FROM e QUALIFY position <= 20
        UNION ALL SELECT 'vector only', r, doc_id, round(1.0 / (60 + r), 6) FROM vec WHERE r <= 20"""),
    Query("mode_compare", mode_compare, f"""{_HYBRID}
        SELECT coalesce(h.position, k.r, v.r) AS position, h.doc_id AS hybrid_doc_id, k.doc_id AS keyword_doc_id, v.doc_id AS vector_doc_id
        FROM (SELECT * FROM p WHERE position <= 10) h FULL JOIN (SELECT * FROM kw WHERE r <= 10) k ON h.position = k.r FULL JOIN (SELECT * FROM vec WHERE r <= 10) v ON v.r = coalesce(h.position, k.r)"""),
    Query("tag_post_filter", tag_post_filter, f"WITH {bm25_sql('documents', 'doc_id', BODY_SQL, TERMS)}, {_KW50} SELECT doc_id, round(score, 6) AS score, {_RANK} AS rank FROM kw WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    Query("meta_pre_filter", meta_pre_filter, f"WITH {bm25_sql('documents', 'doc_id', BODY_SQL, TERMS)} {_TOP(50, _ENGLISH)}"),
    Query("allowed_intersection", allowed_intersection, "SELECT DISTINCT doc_id FROM documents WHERE source = 'src0' AND lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    Query("found_by", found_by, f"{_HYBRID} SELECT CASE WHEN keyword_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'both' WHEN keyword_rank IS NOT NULL THEN 'keyword' ELSE 'vector' END AS found_by, count(*) AS hits FROM p WHERE position <= 40 GROUP BY 1"),
]
