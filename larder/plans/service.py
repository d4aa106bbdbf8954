"""Service-side queries: model answers, prompts, gates, embedding, the meter's late tokens, the ledger."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import models as MD
from larder.operators import retrieval as R
from larder.operators import telemetry as T
from larder.operators.embedding import embed
from larder.plans.common import Query, read, texts


def prompts(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.length(MD.text_prompt(F.col("text"), F.lit("web"), F.col("source"))).alias("text_chars"), F.length(MD.media_prompt(F.lit(""), F.lit("web"), F.col("source"), F.lit(31.4))).alias("media_chars"))


def payload_gate(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", MD.has_substance(F.when(F.col("page_id") % 2 == 0, F.col("html")), F.lit(" ")).alias("substance"))


def analyzed_seconds(spark, d):
    s = (F.col("value") * 10) - 200
    return read(spark, d, "events").select("event_id", F.round(MD.analyzed_seconds(s, 300.0), 6).alias("seconds"), MD.clip_end(s, 300.0).alias("clip_end"))


def quota_violations(spark, d):
    """Events as the bodies of refused calls: named limits, broken quotas, and bodies that say nothing."""
    body = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"error": {"message": "free-models-per-day ', user_id, '"}}')
        WHEN 1 THEN concat('{"error": {"message": "exceeded", "details": [{"@type": "type/Help"}, {"@type": "type/QuotaFailure", "violations": [{"quotaMetric": ""}, {"quotaId": "Q', user_id, '", "quotaValue": "', event_id, '"}]}]}}')
        WHEN 2 THEN '{"error": {"details": [{"@type": "QuotaFailure", "violations": [{"quotaMetric": "m"}]}]}}' ELSE 'busy' END""")
    return read(spark, d, "events").select("event_id", MD.quota_violation(body).alias("violation"))


def success_rules(spark, d):
    """The three meanings of success, over documents."""
    docs, none = read(spark, d, "documents"), F.lit(None).cast("string")
    text, words = F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars"))
    status = F.when(F.col("doc_id") % 5 == 0, 500).otherwise(200)
    return docs.select("doc_id", T.extracted(none, F.lit(""), text).alias("extracted"), T.served(status, words, none.cast("int")).alias("served"), T.processed(words, F.lit("")).alias("processed"))


def embed_batch(spark, d):
    """Every document embedded by a provider that counts characters: unit vectors, each with its own text."""
    counts = lambda texts: np.array([[len(t), t.count(" "), t.count("e"), 1] for t in texts], dtype=np.float32).reshape(-1, 4)
    e = embed(texts(spark, d).select("doc_id", "text"), ["doc_id"], "text", "counts", 4, counts)
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 3)
    return e.select("doc_id", "dim", at(0).alias("v0"), at(1).alias("v1"), at(2).alias("v2"), at(3).alias("v3"))


def vector_parity(spark, d):
    """The batched similarity equals the expression form."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = [float(x) for x in v.filter("doc_id = 0").first()["embedding"]]
    own = v.select("doc_id", F.round(R.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q])), 6).alias("by_expression"))
    return own.join(R.similarities(v, q), "doc_id").select("doc_id", "by_expression", F.round("sim", 6).alias("by_batches"))


def late_tokens(spark, d):
    """Tokens that become known later count for the caller's latest request before (views are such corrections)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = read(spark, d, "events").withColumn("request", F.sum((F.col("event_type") != "view").cast("long")).over(w))
    return e.filter("request > 0").groupBy("user_id", "request").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.sum(F.floor("value")).alias("tokens"))


def run_ledger(spark, d):
    """Lines of a run ledger: percent, signs, differences against the first run."""
    from larder.plans.telemetry import bench_delta

    r = bench_delta(spark, d)
    sign = F.when(F.col("avg_total_ms_diff") > 0, "+").otherwise("")
    delta = F.when(F.col("run") == "run-0", "BASELINE").otherwise(F.format_string("%s%.1fms (%s%.1f%%)", sign, F.col("avg_total_ms_diff"), sign, F.col("avg_total_ms_pct")))
    return r.select("run", F.format_string("%.1f%%", F.col("success_pct")).alias("success"), delta.alias("delta"))


def host_dimension(spark, d):
    """Pages met with a small taxonomy of domain patterns."""
    from larder.sources.files import taxonomy

    domains, _ = taxonomy(spark, {"platforms": {"com": {"domain_patterns": ["example.com"]}, "net": {"domain_patterns": ["example.net"]}}})
    pages = read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"([^./]+\.[^./]+)/", 1).alias("domain_pattern"))
    return pages.join(domains, "domain_pattern", "left").groupBy(F.coalesce("platform", F.lit("other")).alias("platform")).agg(F.count("*").alias("pages"))


QUERIES = [
    Query("prompts", prompts, r"""
        SELECT doc_id, length(e'Index this saved link.\n\nPlatform: web\nURL: ' || source || e'\n\nContent at hand:\n----\n' || text || e'\n----\n\nAnswer with the JSON object.') AS text_chars,
               length(e'Index this saved link. Its media is attached.\n\nPlatform: web\nURL: ' || source || e'\nLength: 31 seconds\n\nThere is no text for this item.\n\nDescribe all that is seen and heard, then answer with the JSON object.') AS media_chars FROM documents"""),
    Query("payload_gate", payload_gate, "SELECT page_id, page_id % 2 = 0 AS substance FROM pages"),
    Query("analyzed_seconds", analyzed_seconds, "SELECT event_id, round(CASE WHEN value * 10 - 200 <= 0 THEN 300 ELSE least(value * 10 - 200, 300) END, 6) AS seconds, CASE WHEN value * 10 - 200 > 0 AND value * 10 - 200 <= 300 THEN NULL ELSE 300 END AS clip_end FROM events"),
    Query("embed_batch", embed_batch, """
        WITH c AS (SELECT doc_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS b, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS c FROM documents), n AS (SELECT *, sqrt(a * a + b * b + c * c + 1) AS n FROM c)
        SELECT doc_id, 4 AS dim, round((a / n)::FLOAT::DOUBLE, 3) AS v0, round((b / n)::FLOAT::DOUBLE, 3) AS v1, round((c / n)::FLOAT::DOUBLE, 3) AS v2, round((1 / n)::FLOAT::DOUBLE, 3) AS v3 FROM n"""),
    Query("quota_violations", quota_violations, """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'free-models-per-day ' || user_id WHEN 1 THEN 'Q' || user_id || ' (limit ' || event_id || ')' WHEN 2 THEN 'm' END AS violation FROM events"""),
    Query("success_rules", success_rules, """
        SELECT doc_id, doc_id % 2 = 0 AND text <> '' AS extracted, doc_id % 5 <> 0 AND doc_id % 3 = 0 AND n_chars > 0 AS served, doc_id % 3 = 0 AND n_chars > 0 AS processed FROM documents"""),
    Query("vector_parity", vector_parity, "SELECT e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS by_expression, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS by_batches FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"),
    Query("late_tokens", late_tokens, """
        WITH g AS (SELECT *, sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS request FROM events)
        SELECT user_id, request, arg_min(event_id, (ts, event_id)) AS event_id, sum(floor(value))::BIGINT AS tokens FROM g WHERE request > 0 GROUP BY user_id, request"""),
    Query("run_ledger", run_ledger, """
        WITH b AS (SELECT 'run-' || (event_id % 3) AS run, event_type <> 'error' AS success, CASE WHEN event_id % 4 <> 0 THEN value END AS total_ms FROM events),
        s AS (SELECT run, round(count(*) FILTER (success) * 100.0 / count(*), 4) AS pct, round(coalesce(sum(total_ms), 0) / count(*), 4) AS ms FROM b GROUP BY run), f AS (SELECT ms AS m FROM s ORDER BY run LIMIT 1),
        d AS (SELECT run, pct, round(ms - m, 4) AS diff, round((ms - m) * 100 / m, 4) AS rel, CASE WHEN round(ms - m, 4) > 0 THEN '+' ELSE '' END AS sign FROM s, f)
        SELECT run, printf('%.1f%%', round(pct, 1)) AS success, CASE WHEN run = 'run-0' THEN 'BASELINE' ELSE sign || printf('%.1f', round(diff, 1)) || 'ms (' || sign || printf('%.1f', round(rel, 1)) || '%)' END AS delta FROM d"""),
    Query("host_dimension", host_dimension, "SELECT CASE WHEN regexp_extract(url, '([^./]+\\.[^./]+)/', 1) = 'example.com' THEN 'com' WHEN regexp_extract(url, '([^./]+\\.[^./]+)/', 1) = 'example.net' THEN 'net' ELSE 'other' END AS platform, count(*) AS pages FROM pages GROUP BY 1"),
]
