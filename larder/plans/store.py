"""Store, merge and scan queries: upserts, replacement, deletes, change detection, the cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from larder.functions.text import upper_letterwise
from larder.operators import merge as M
from larder.operators import store as S
from larder.plans.common import Query, read


def _docs(spark, d):
    return read(spark, d, "documents")


def _versions(spark, d):
    """Events as versions of a record keyed by user."""
    return read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("state"), "value", F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"))


def upsert_latest(spark, d):
    v = S.latest(_versions(spark, d).filter("state <> 'error'"), "user_id", ["updated_at", "event_id"])
    new = S.latest(_versions(spark, d).filter("state = 'error'"), "user_id", ["updated_at", "event_id"])
    return S.upsert(v, new, "user_id").select("user_id", "event_id", "state", "created_at")


def replace_chunks(spark, d):
    old = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    new = _docs(spark, d).filter("lang = 'fr'").select("doc_id", F.lit(0).alias("ordinal"), upper_letterwise(F.col("text")).alias("text"))
    return S.replace_children(old, new, "doc_id").select("doc_id", "ordinal", F.sha2("text", 256).alias("text_hash"))


def tag_table(spark, d):
    e = _docs(spark, d).select("doc_id", F.split(F.concat_ws(",", "lang", "source", "lang"), ",").alias("tags"))
    return S.tag_rows(e, "doc_id")


def forget_cascade(spark, d):
    """Rows left in each table after all documents with a toxic label are forgotten."""
    gone = read(spark, d, "labels").filter("toxic = 1").select("doc_id")
    left = S.forget({"documents": _docs(spark, d).select("doc_id"), "labels": read(spark, d, "labels").select("doc_id"), "vectors": read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))}, gone, "doc_id")
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("name"), "rows") for k, df in left.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def forget_existed(spark, d):
    gone = read(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return S.existed(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), gone, "doc_id")


def _fingerprints(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(F.concat_ws("|", "text", "lang"), 256).alias("source_hash"))


def change_detect(spark, d):
    """Stored: all but French documents, the sources' first with an old fingerprint."""
    stored = _docs(spark, d).filter("lang <> 'fr'").select("doc_id", F.sha2(F.concat_ws("|", F.when(F.col("source") == "src0", F.lit("old")).otherwise(F.col("text")), "lang"), 256).alias("source_hash"))
    return S.changed(_fingerprints(spark, d), stored, "doc_id").select("doc_id")


def stale_backfill(spark, d):
    """What to enrich again: documents without a current enrichment, or with a degraded one, in scan order."""
    env = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("source_hash"), F.lit(4).alias("prompt_version"), "n_chars")
    enr = read(spark, d, "labels").join(env.select("doc_id", "source_hash"), "doc_id").select("doc_id", "source_hash", F.when(F.col("quality") == 1, 4).otherwise(1).alias("prompt_version"), (F.col("toxic") == 1).alias("degraded"))
    return S.backfill(env, enr, "doc_id", 100, -F.col("n_chars")).select("doc_id", "n_chars")


def fresh_enrichments(spark, d):
    env = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("source_hash"), F.lit(4).alias("prompt_version"))
    enr = read(spark, d, "labels").join(env.select("doc_id", "source_hash"), "doc_id").select("doc_id", "source_hash", F.when(F.col("quality") == 1, 4).otherwise(1).alias("prompt_version"))
    return S.is_current(enr, env, "doc_id").select("doc_id")


def rewrite_guard(spark, d):
    """Without an embedder only documents that have no vectors may get new chunks."""
    return S.may_rewrite(_docs(spark, d).select("doc_id"), read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", False)


def schema_defaults(spark, d):
    old = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).alias("enriched"))
    return S.with_defaults(old, {"enriched": ("int", 0), "visual": ("boolean", False), "source_hash": ("string", "")})


def library_page(spark, d):
    return S.page(_docs(spark, d).select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 50, 100)


def library_next_page(spark, d):
    """The third page of a listing, each page asked for by the last row of the one before."""
    docs, order, last = _docs(spark, d).select("doc_id", "n_chars"), [("n_chars", True), ("doc_id", False)], None
    for _ in range(2):
        last = S.page_after(docs, order, 50, last).collect()[-1]  # a page of rows
        last = (last["n_chars"], last["doc_id"])
    return S.page_after(docs, order, 50, last)


def point_lookup(spark, d):
    """A key, a list of keys and an existence test, as one filter and one semi join."""
    keys = spark.createDataFrame([(3,), (5,), (8,), (-1,)], "doc_id long")
    return _docs(spark, d).join(F.broadcast(keys), "doc_id", "left_semi").select("doc_id", "lang", "source")  # a literal list


def item_detail(spark, d):
    """A document with its label and vector where they exist."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))
    return _docs(spark, d).select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id", "left").join(v, "doc_id", "left")


# -- The cascade: roles of a conversation as tiers ----------------------------------------


def _candidates(spark, d):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    c = read(spark, d, "conversations").select("conv_id", rank.alias("tier_rank"), "turn", "role", "text")
    c = c.groupBy("conv_id", "tier_rank", "role").agg(F.min_by("text", "turn").alias("text"), F.count("*").alias("turns"))
    return c.select("conv_id", "tier_rank", "role", F.when(F.length("text") > 120, F.col("text")).otherwise("").alias("body"), F.when(F.col("role") != "assistant", F.col("text")).alias("caption"), "turns")


_CANDIDATES = """r AS (SELECT conv_id, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS tier_rank, role, arg_min(text, turn) AS text, count(*) AS turns FROM conversations GROUP BY ALL),
    c AS (SELECT conv_id, tier_rank, role, CASE WHEN length(text) > 120 THEN text END AS body, CASE WHEN role <> 'assistant' THEN nullif(text, '') END AS caption, turns FROM r),
    s AS (SELECT *, min(tier_rank) FILTER (turns >= 3) OVER (PARTITION BY conv_id) AS stop FROM c), k AS (SELECT * FROM s WHERE stop IS NULL OR tier_rank <= stop)"""


def cascade_merge(spark, d):
    """Tiers until the first full one (three turns): later ones win, earlier ones fill gaps."""
    out = M.cascade(_candidates(spark, d), "conv_id", "tier_rank", F.col("turns") < 3, ["body", "caption"], ["role"])
    return out.select("conv_id", F.sha2("body", 256).alias("body"), F.sha2("caption", 256).alias("caption"), "role", "tiers_run", "stopped")


def cascade_attempts(spark, d):
    inputs = read(spark, d, "conversations").select("conv_id")
    a = M.attempts(inputs, _candidates(spark, d), "conv_id", "tier_rank", [0, 1, 2], F.col("turns") < 3)
    return a.groupBy("tier_rank").agg(F.count("*").alias("attempts"), F.sum(F.col("ok").cast("long")).alias("ok"), F.sum(F.col("skipped").cast("long")).alias("skipped"))


def merge_records(spark, d):
    """A newer record filled from an older one; zero is a value, an empty text is none."""
    new = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("caption"), F.lit(0).alias("likes"), F.lit("new").alias("tier"))
    old = _docs(spark, d).select("doc_id", F.col("source").alias("caption"), F.lit(5).alias("likes"), F.lit("old").alias("tier"))
    return M.merged(new, old, "doc_id", ("tier",))


def degraded_placeholder(spark, d):
    found = read(spark, d, "labels").select("doc_id", "quality")
    return M.with_placeholders(_docs(spark, d), found, "doc_id")


def cache_misses(spark, d):
    store = read(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("degraded"))
    return M.not_cached(_docs(spark, d).select("doc_id"), store, "doc_id", retry_degraded=True)


def source_priority(spark, d):
    a = read(spark, d, "labels").filter("quality = 1").select("doc_id", F.lit("labels").alias("origin"))
    b = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("vectors").alias("origin"))
    c = _docs(spark, d).select("doc_id", F.lit("documents").alias("origin"))
    return M.by_priority([a, b, c], "doc_id")


def provider_chain(spark, d):
    """The first provider with an answer."""
    value, name = M.first_provider([("media", F.when(F.col("doc_id") % 5 == 0, F.lit("m"))), ("metadata", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), ("heuristic", F.col("source"))])
    return _docs(spark, d).select("doc_id", value.alias("answer"), name.alias("provider"))


QUERIES = [
    Query("upsert_latest", upsert_latest, """
        WITH v AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at FROM events WHERE event_type <> 'error' GROUP BY user_id),
        n AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, 'error' AS state, max(ts) AS at FROM events WHERE event_type = 'error' GROUP BY user_id)
        SELECT user_id, coalesce(n.event_id, v.event_id) AS event_id, coalesce(n.state, v.state) AS state, least(n.at, v.at) AS created_at FROM v FULL JOIN n USING (user_id)"""),
    Query("replace_chunks", replace_chunks, """
        SELECT doc_id, ordinal, sha256(text) AS text_hash FROM (
            SELECT doc_id, (unnest(range(len(string_split(text, chr(10)))))) AS ordinal, unnest(string_split(text, chr(10))) AS text FROM documents WHERE lang <> 'fr'
            UNION ALL SELECT doc_id, 0, upper(text) FROM documents WHERE lang = 'fr')"""),
    Query("tag_table", tag_table, "SELECT doc_id, lang AS tag, 0 AS position FROM documents UNION ALL SELECT doc_id, source, 1 FROM documents"),
    Query("forget_cascade", forget_cascade, """
        WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1)
        SELECT 'documents' AS name, count(*) AS rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM g)
        UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM g)"""),
    Query("forget_existed", forget_existed, "SELECT DISTINCT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS existed FROM labels WHERE toxic = 1"),
    Query("change_detect", change_detect, "SELECT doc_id FROM documents WHERE lang = 'fr' OR (source = 'src0' AND text <> 'old')"),
    Query("stale_backfill", stale_backfill, """
        WITH s AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 400),
        p AS (SELECT doc_id FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 500)
        SELECT doc_id, n_chars FROM s WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) OR doc_id IN (SELECT doc_id FROM p) ORDER BY n_chars DESC, doc_id LIMIT 100"""),
    Query("fresh_enrichments", fresh_enrichments, "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    Query("rewrite_guard", rewrite_guard, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
    Query("schema_defaults", schema_defaults, "SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS enriched, false AS visual, '' AS source_hash FROM labels"),
    Query("library_page", library_page, "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100"),
    Query("library_next_page", library_next_page, "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100"),
    Query("point_lookup", point_lookup, "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (3, 5, 8, -1)"),
    Query("item_detail", item_detail, "SELECT d.doc_id AS doc_id, lang, quality, toxic, e.label AS cluster FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id"),
    Query("cascade_merge", cascade_merge, f"""
        WITH {_CANDIDATES} SELECT conv_id, sha256(arg_max(body, tier_rank) FILTER (body IS NOT NULL)) AS body, sha256(arg_max(caption, tier_rank) FILTER (caption IS NOT NULL)) AS caption, arg_max(role, tier_rank) AS role, count(*) AS tiers_run, bool_or(stop IS NOT NULL) AS stopped FROM k GROUP BY conv_id"""),
    Query("cascade_attempts", cascade_attempts, f"""
        WITH {_CANDIDATES}, st AS (SELECT conv_id, min(tier_rank) FILTER (turns >= 3) AS stop FROM c GROUP BY conv_id), g AS (SELECT conv_id, stop, unnest([0, 1, 2]) AS tier_rank FROM st)
        SELECT g.tier_rank AS tier_rank, count(*) AS attempts, count(c.role) AS ok, count(*) - count(c.role) AS skipped FROM g LEFT JOIN c ON g.conv_id = c.conv_id AND g.tier_rank = c.tier_rank WHERE g.stop IS NULL OR g.tier_rank <= g.stop GROUP BY 1"""),
    Query("merge_records", merge_records, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS caption, 0 AS likes, 'new' AS tier FROM documents"),
    Query("degraded_placeholder", degraded_placeholder, "SELECT d.doc_id AS doc_id, quality, quality IS NULL AS degraded FROM documents d LEFT JOIN labels USING (doc_id)"),
    Query("cache_misses", cache_misses, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic <> 1)"),
    Query("source_priority", source_priority, "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'labels' WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'vectors' ELSE 'documents' END AS origin FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings UNION SELECT doc_id FROM labels WHERE quality = 1)"),
    Query("provider_chain", provider_chain, "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'm' WHEN doc_id % 2 = 0 THEN lang ELSE source END AS answer, CASE WHEN doc_id % 5 = 0 THEN 'media' WHEN doc_id % 2 = 0 THEN 'metadata' ELSE 'heuristic' END AS provider FROM documents"),
]
