"""Operational queries over events: tiers, cost, runs, quotas, jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.functions import pricing
from larder.operators import governor as G
from larder.operators import telemetry as T
from larder.plans.common import Query, read, shared_folder
from larder.sources import files

TIERS = ["click", "view", "signup", "purchase"]


def _attempts(spark, d):
    """Events as attempts: the type is the tier, the value the duration; errors failed, every seventh was skipped."""
    e = read(spark, d, "events")
    return e.select("event_id", F.col("event_type").alias("tier"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 7 == 0).alias("skipped"), F.col("value").alias("duration_ms"))


def tier_stats(spark, d):
    a = _attempts(spark, d).withColumn("ok", F.col("ok") & ~F.col("skipped"))
    return T.tier_stats(a, TIERS).withColumn("success_rate", F.round("success_rate", 6))


def library_summary(spark, d):
    docs = read(spark, d, "documents")
    return T.library_summary(docs, ["lang", "source"], F.col("n_chars") < 200)


def _calls(spark, d):
    """Events as provider calls with tokens, a model and a cost."""
    e = read(spark, d, "events")
    names = list(pricing.PRICES)[:4]
    model = F.when(F.col("event_id") % 5 == 4, F.lit(None)).otherwise(F.element_at(F.lit(names), (F.col("event_id") % 5 + 1).cast("int")))
    e = e.select("event_id", "event_type", F.col("value").alias("duration_ms"), model.alias("model"), (F.col("event_id") % 900).alias("input_tokens"), (F.col("user_id") % 300).alias("output_tokens"))
    return e.withColumn("cost_usd", pricing.cost(F.coalesce("model", F.lit("?")), F.col("input_tokens"), F.col("output_tokens")))


_CALLS = """calls AS (SELECT event_id, event_type, value AS duration_ms, event_id % 900 AS input_tokens, user_id % 300 AS output_tokens,
        CASE event_id % 5 WHEN 0 THEN 'gemini-3.7-flash' WHEN 1 THEN 'gemini-3.6-flash' WHEN 2 THEN 'gemini-3.5-flash' WHEN 3 THEN 'gemini-3.1-flash' END AS model,
        round(((event_id % 900) * CASE event_id % 5 WHEN 0 THEN 0.75 WHEN 1 THEN 0.75 WHEN 2 THEN 1.5 WHEN 3 THEN 0.5 ELSE 0 END
             + (user_id % 300) * CASE event_id % 5 WHEN 0 THEN 3.75 WHEN 1 THEN 3.75 WHEN 2 THEN 9.0 WHEN 3 THEN 3.0 ELSE 0 END)::DOUBLE / 1000000, 8) AS cost_usd FROM events)"""


def cost_summary(spark, d):
    return T.cost_summary(_calls(spark, d))


def cost_by_model(spark, d):
    return T.cost_summary(_calls(spark, d), "model")


def backfill_cost(spark, d):
    return _calls(spark, d).agg(F.round(F.sum("cost_usd"), 6).alias("total_usd"))


def top_tags(spark, d):
    rows = read(spark, d, "documents").select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) > 6))).alias("tag"))
    return T.top_values(rows, "tag", 25)


def index_stats(spark, d):
    docs, labels, vectors = read(spark, d, "documents"), read(spark, d, "labels"), read(spark, d, "embeddings")
    marked = docs.join(labels.select("doc_id", F.lit(1).alias("e")).dropDuplicates(["doc_id"]), "doc_id", "left")
    base = marked.agg(F.count("*").alias("documents"), F.coalesce(F.sum("e"), F.lit(0)).alias("enriched"), F.count_distinct("source").alias("sources"))
    return base.crossJoin(vectors.agg(F.count("*").alias("vectors")))  # one row each


def _bench(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.concat(F.lit("run-"), (F.col("event_id") % 3).cast("string")).alias("run"), F.col("event_type").alias("platform"), (F.col("event_type") != "error").alias("success"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("total_ms"))


_BENCH = "b AS (SELECT event_id, 'run-' || (event_id % 3) AS run, event_type AS platform, event_type <> 'error' AS success, CASE WHEN event_id % 4 <> 0 THEN value END AS total_ms FROM events)"


def bench_summary(spark, d):
    return T.run_summary(_bench(spark, d), ["run"], "success", ["total_ms"])


def bench_platform(spark, d):
    return T.run_summary(_bench(spark, d), ["run", "platform"], "success", ["total_ms"])


def bench_mode(spark, d):
    """The most frequent user of each event type; of equals, the first to appear."""
    return T.most_common(read(spark, d, "events"), ["event_type"], "user_id", F.col("event_id"))


def bench_p95(spark, d):
    return T.nearest_rank_by_refinement(_bench(spark, d), ["run"], "total_ms", 0.95).select("run", F.round("picked", 6).alias("p95_ms"))


def bench_median(spark, d):
    return _bench(spark, d).groupBy("platform").agg(F.round(F.percentile("total_ms", 0.5), 6).alias("median_ms"), F.round(F.avg("total_ms"), 6).alias("mean_ms"))


def bench_delta(spark, d):
    return T.run_delta(bench_summary(spark, d).select("run", "success_pct", "avg_total_ms"), "run", ["success_pct", "avg_total_ms"])


def bench_compare(spark, d):
    s = T.run_summary(_bench(spark, d), ["run", "platform"], "success", ["total_ms"])
    return T.compare_runs(s.filter("run = 'run-0'"), s.filter("run = 'run-1' AND platform <> 'view'"), "platform", "avg_total_ms")


def first_n_per_group(spark, d):
    from larder.operators.store import first_per_group

    return first_per_group(read(spark, d, "events").select("event_type", "event_id"), "event_type", [F.col("event_id")], 10)


def _run_files(spark, d):
    """The events as files of three runs, and among them one that is broken and one that holds no run; where they are."""
    from larder.operators.store import overwrite_text

    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    items = _bench(spark, d).select(F.col("run").alias("tag"), F.col("event_id").cast("string").alias("item_id"), "platform", "success", "total_ms")
    runs = items.groupBy("tag").agg(F.count("*").alias("total_items"), F.count_if("success").alias("successful_items"))
    files.write_runs(runs, items, path)
    overwrite_text(spark, "{\"tag\": broken", f"{path}/tag=broken")
    overwrite_text(spark, "{}", f"{path}/tag=empty")
    return path


def run_files(spark, d):
    """Run files read back: each run's items, and how many files hold no run."""
    runs, items, bad = files.read_run_files(spark, f"{_run_files(spark, d)}/*/*.txt")
    found = items.groupBy("tag").agg(F.count("*").alias("items"), F.count_if("success").alias("successes"), F.round(F.sum("total_ms"), 4).alias("total_ms"))
    found = runs.join(found, "tag").select("tag", "total_items", "successful_items", "items", "successes", "total_ms")
    rest = bad.agg(F.lit("unreadable").alias("tag"), F.count("*").alias("items"))
    return found.unionByName(rest, allowMissingColumns=True)


def run_ledger_file(spark, d):
    """The ledger of the runs as a Markdown file, read back line by line."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    files.write_ledger(bench_summary(spark, d), "run", ["run", "items", "successes"], path)
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")


def corpus_quality(spark, d):
    pages = read(spark, d, "pages").select(F.regexp_extract("url", r"/(en|fr|de|es)/", 1).alias("page_type"), F.regexp_extract("url", "://([^/]*)", 1).alias("domain"), F.length("html").alias("n"))
    return T.corpus_quality(pages, "page_type", "domain", F.col("n"))


def quota_window(spark, d):
    out = G.window_metrics(read(spark, d, "events"), "user_id", "ts", F.floor("value").cast("bigint"))
    return out.select("event_id", "user_id", "rpm", F.col("tpm").cast("bigint").alias("tpm"), "rpd", F.col("tpd").cast("bigint").alias("tpd"))


def quota_state(spark, d):
    e = quota_window(spark, d)
    state = G.pacing_state(F.col("rpm"), F.col("tpm"), F.col("rpd"), 20, 1e6, 12)
    return e.groupBy(state.alias("state")).agg(F.count("*").alias("events"))


def time_to_free(spark, d):
    e = read(spark, d, "events").withColumn("type_key", F.col("event_type"))
    return G.seconds_to_free(e, "type_key", "ts", 1).select("event_id", F.round("free_s", 6).alias("free_s"))


def error_counts(spark, d):
    k = F.get_json_object("props", "$.k")
    return read(spark, d, "events").filter("event_type = 'error'").groupBy(k.alias("code")).agg(F.count("*").alias("errors"))


def lifetime_counters(spark, d):
    out = G.lifetime_counters(read(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], F.col("value"))
    return out.select("event_id", "requests", F.round("tokens", 4).alias("tokens"))


def _one_service(spark, d):
    """All events as those of one service: a key with every row."""
    return read(spark, d, "events").select("event_id", "event_type", "ts", "value", F.lit("one").alias("service"))


def hot_service(spark, d):
    """Windows, counters and failure runs of a service that has all events."""
    e = _one_service(spark, d)
    windows = G.window_metrics(e, "service", "ts", F.floor("value").cast("bigint")).select("event_id", "rpm", F.col("tpm").cast("bigint").alias("tpm"), "rpd", F.col("tpd").cast("bigint").alias("tpd"))
    totals = G.lifetime_counters(e, "service", ["ts", "event_id"], F.floor("value").cast("bigint")).select("event_id", "requests", "tokens")
    failed = G.failure_runs(e, "service", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "in_a_row")
    return windows.join(totals, "event_id").join(failed, "event_id")


def hot_percentiles(spark, d):
    """Exact percentiles of all events as one group."""
    out = None
    for share in (0.05, 0.5, 0.95, 0.999):
        one = T.nearest_rank_by_refinement(_one_service(spark, d), ["service"], "value", share, held=100).select(F.lit(share).alias("share"), F.round("picked", 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def backoff_runs(spark, d):
    runs = G.failure_runs(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return runs.filter("in_a_row > 0").select("event_id", "in_a_row", G.backoff_seconds(F.col("in_a_row")).alias("cooldown_s"))


def rate_limit(spark, d):
    """Two calls a day for each user; refused ones do not count."""
    return G.hourly_cap(read(spark, d, "events"), "user_id", "ts", "event_id", 2, 86_400)


def job_states(spark, d):
    """Events as job states; the newest of each user's job."""
    from larder.operators.store import latest

    e = read(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ready").otherwise("running").alias("status"))
    return latest(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "status")


def interrupted_jobs(spark, d):
    """Jobs that were still running when the service stopped count as failed."""
    from larder.operators.store import interrupted

    return interrupted(job_states(spark, d).withColumn("error", F.lit(None).cast("string"))).select("user_id", "status", "error")


def job_updates(spark, d):
    """Jobs with a stage and an error put in where an update has one, and the open ones left."""
    from larder.operators.store import open_jobs, partial_update

    jobs = job_states(spark, d).select("user_id", "status", F.lit("extracting").alias("stage"), F.lit("old").alias("error"))
    u = jobs.select("user_id", F.when(F.col("user_id") % 2 == 0, "indexing").alias("stage"), F.when(F.col("user_id") % 3 == 0, "slow").alias("error"))
    return open_jobs(partial_update(jobs, u, "user_id"))


def recent_jobs(spark, d):
    from larder.operators.store import page

    return page(job_states(spark, d).filter("status = 'failed'").select("user_id", "event_id"), [F.desc("event_id")], 20)


def video_cost(spark, d):
    s = F.col("value")
    return read(spark, d, "events").select("event_id", pricing.video_tokens(s).alias("tokens"), pricing.video_tokens(s, high=True).alias("high_tokens"), F.round(pricing.video_cost(s, F.lit("gemini-3.5-flash-lite-001")), 8).alias("cost_usd"))


def mode_decision(spark, d):
    e = read(spark, d, "events")
    signal = F.when(F.col("event_id") % 3 == 0, "strong").when(F.col("event_id") % 3 == 1, "weak").otherwise("none")
    kind = F.when(F.col("event_type") == "view", "video").otherwise("image")
    media = F.when(F.col("user_id") % 2 == 0, F.lit("https://x/v.mp4"))
    mode = pricing.enrichment_mode(signal, media, kind, F.col("value") * 20, 1800)
    return e.select("event_id", mode.alias("mode"), pricing.within_budget(mode, pricing.video_cost(F.col("value") * 20, F.lit("gemini-3.5-flash")), 0.05).alias("final_mode"))


_TOK = lambda k: f"CASE WHEN value <= 0 THEN 0 ELSE greatest(1, floor(value)) * {k} + floor(value * 32) END::BIGINT"

QUERIES = [
    Query("tier_stats", tier_stats, """
        WITH a AS (SELECT event_type AS tier, event_id % 7 = 0 AS skipped, event_type <> 'error' AND event_id % 7 <> 0 AS ok, value FROM events)
        SELECT tier, count(*) AS attempts, count(*) FILTER (ok) AS wins, count(*) FILTER (skipped) AS skips, count(*) FILTER (NOT skipped) AS ran,
               round(count(*) FILTER (ok) / nullif(count(*) FILTER (NOT skipped), 0), 6) AS success_rate, nullif(floor(avg(value) FILTER (NOT skipped))::BIGINT, 0) AS avg_ms,
               CASE tier WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 99 END AS tier_rank FROM a GROUP BY tier"""),
    Query("library_summary", library_summary, """
        SELECT 'total' AS facet, NULL AS value, count(*) AS items, sum((n_chars < 200)::INT)::BIGINT AS flagged FROM documents
        UNION ALL SELECT 'lang', lang, count(*), sum((n_chars < 200)::INT)::BIGINT FROM documents GROUP BY lang
        UNION ALL SELECT 'source', source, count(*), sum((n_chars < 200)::INT)::BIGINT FROM documents GROUP BY source"""),
    Query("cost_summary", cost_summary, f"WITH {_CALLS} SELECT count(*) AS items, round(sum(cost_usd), 6) AS cost_usd, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd) / count(*), 6) AS avg_cost_usd FROM calls"),
    Query("cost_by_model", cost_by_model, f"WITH {_CALLS} SELECT coalesce(model, 'none') AS model, count(*) AS items, round(sum(cost_usd), 6) AS cost_usd, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd) / count(*), 6) AS avg_cost_usd, floor(avg(duration_ms))::BIGINT AS avg_ms FROM calls GROUP BY 1"),
    Query("backfill_cost", backfill_cost, f"WITH {_CALLS} SELECT round(sum(cost_usd), 6) AS total_usd FROM calls"),
    Query("top_tags", top_tags, """
        WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS tag FROM documents)
        SELECT tag, count(*) AS items FROM t WHERE length(tag) > 6 GROUP BY tag ORDER BY items DESC, tag LIMIT 25"""),
    Query("index_stats", index_stats, "SELECT count(*) AS documents, count(DISTINCT l.doc_id) AS enriched, count(DISTINCT source) AS sources, (SELECT count(*) FROM embeddings) AS vectors FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)"),
    Query("bench_summary", bench_summary, f"WITH {_BENCH} SELECT run, count(*) AS items, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) * 100.0 / count(*), 4) AS success_pct, round(coalesce(sum(total_ms), 0) / count(*), 4) AS avg_total_ms FROM b GROUP BY run"),
    Query("bench_platform", bench_platform, f"WITH {_BENCH} SELECT run, platform, count(*) AS items, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) * 100.0 / count(*), 4) AS success_pct, round(coalesce(sum(total_ms), 0) / count(*), 4) AS avg_total_ms FROM b GROUP BY run, platform"),
    Query("bench_mode", bench_mode, "SELECT event_type, user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY 1, 2) WHERE r = 1"),
    Query("bench_p95", bench_p95, f"WITH {_BENCH}, r AS (SELECT run, total_ms, row_number() OVER (PARTITION BY run ORDER BY total_ms) AS i, count(*) OVER (PARTITION BY run) AS n FROM b WHERE total_ms IS NOT NULL) SELECT run, round(total_ms, 6) AS p95_ms FROM r WHERE i = least(floor(n * 0.95), n - 1) + 1"),
    Query("bench_median", bench_median, f"WITH {_BENCH} SELECT platform, round(quantile_cont(total_ms, 0.5), 6) AS median_ms, round(avg(total_ms), 6) AS mean_ms FROM b GROUP BY platform"),
    Query("bench_delta", bench_delta, f"""
        WITH {_BENCH}, s AS (SELECT run, round(count(*) FILTER (success) * 100.0 / count(*), 4) AS success_pct, round(coalesce(sum(total_ms), 0) / count(*), 4) AS avg_total_ms FROM b GROUP BY run),
        f AS (SELECT success_pct AS a, avg_total_ms AS m FROM s ORDER BY run LIMIT 1)
        SELECT run, success_pct, avg_total_ms, round(success_pct - a, 4) AS success_pct_diff, round((success_pct - a) * 100 / a, 4) AS success_pct_pct, CASE WHEN success_pct > a THEN '+' WHEN success_pct < a THEN '-' ELSE '=' END AS success_pct_sign,
               round(avg_total_ms - m, 4) AS avg_total_ms_diff, round((avg_total_ms - m) * 100 / m, 4) AS avg_total_ms_pct, CASE WHEN avg_total_ms > m THEN '+' WHEN avg_total_ms < m THEN '-' ELSE '=' END AS avg_total_ms_sign FROM s, f"""),
    Query("bench_compare", bench_compare, f"""
        WITH {_BENCH}, s AS (SELECT run, platform, round(coalesce(sum(total_ms), 0) / count(*), 4) AS v FROM b GROUP BY run, platform)
        SELECT platform, x.v AS before, y.v AS after, round(y.v - x.v, 4) AS diff FROM (SELECT * FROM s WHERE run = 'run-0') x FULL JOIN (SELECT * FROM s WHERE run = 'run-1' AND platform <> 'view') y USING (platform)"""),
    Query("first_n_per_group", first_n_per_group, "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position FROM events QUALIFY position <= 10"),
    Query("run_files", run_files, f"""
        WITH {_BENCH} SELECT run AS tag, count(*) AS total_items, count(*) FILTER (success) AS successful_items, count(*) AS items, count(*) FILTER (success) AS successes, round(sum(total_ms), 4) AS total_ms FROM b GROUP BY run
        UNION ALL SELECT 'unreadable', NULL, NULL, 2, NULL, NULL"""),
    Query("run_ledger_file", run_ledger_file, f"""
        WITH {_BENCH}, s AS (SELECT run, count(*) AS items, count(*) FILTER (success) AS successes FROM b GROUP BY run)
        SELECT 0 AS line, '| run | items | successes |' AS value UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY run), '| ' || run || ' | ' || items || ' | ' || successes || ' |' FROM s"""),
    Query("corpus_quality", corpus_quality, """
        WITH p AS (SELECT regexp_extract(url, '/(en|fr|de|es)/', 1) AS page_type, regexp_extract(url, '://([^/]*)', 1) AS domain, length(html) AS n FROM pages)
        SELECT page_type, count(*) AS pages, count(DISTINCT domain) AS domains, round(avg(n), 4) AS avg_score, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share_pct FROM p GROUP BY page_type"""),
    Query("quota_window", quota_window, """
        SELECT event_id, user_id, count(*) OVER m AS rpm, (sum(greatest(floor(value), 0)) OVER m)::BIGINT AS tpm, count(*) OVER d AS rpd, (sum(greatest(floor(value), 0)) OVER d)::BIGINT AS tpd FROM events
        WINDOW m AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)"""),
    Query("quota_state", quota_state, """
        WITH q AS (SELECT count(*) OVER m AS rpm, sum(greatest(floor(value), 0)) OVER m AS tpm, count(*) OVER d AS rpd FROM events
            WINDOW m AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW))
        SELECT CASE WHEN greatest((rpm + 1) / 20, tpm / 1e6) >= 0.9 OR (rpd + 1) / 12 >= 1 THEN 'throttled' WHEN greatest((rpm + 1) / 20, tpm / 1e6) >= 0.75 THEN 'warning' ELSE 'healthy' END AS state, count(*) AS events FROM q GROUP BY 1"""),
    Query("time_to_free", time_to_free, """
        SELECT event_id, round((60000000 + epoch_us(min(ts) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)) - epoch_us(ts)) / 1e6, 6) AS free_s FROM events"""),
    Query("error_counts", error_counts, "SELECT json_extract_string(props, '$.k') AS code, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1"),
    Query("lifetime_counters", lifetime_counters, "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    Query("backoff_runs", backoff_runs, """
        WITH g AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
        r AS (SELECT event_id, event_type, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS in_a_row FROM g)
        SELECT event_id, in_a_row, least(15.0 * pow(2, least(in_a_row - 1, 4)), 90.0) AS cooldown_s FROM r WHERE in_a_row > 0"""),
    Query("rate_limit", rate_limit),
    Query("hot_service", hot_service, """
        WITH e AS (SELECT *, floor(value)::BIGINT AS t, event_type = 'error' AS failed FROM events),
        g AS (SELECT *, sum((NOT failed)::INT) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e)
        SELECT event_id, count(*) OVER m AS rpm, (sum(greatest(t, 0)) OVER m)::BIGINT AS tpm, count(*) OVER d AS rpd, (sum(greatest(t, 0)) OVER d)::BIGINT AS tpd,
               count(*) OVER l AS requests, (sum(t) OVER l)::BIGINT AS tokens, (sum(failed::INT) OVER (PARTITION BY g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS in_a_row
        FROM g WINDOW m AS (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW), d AS (ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW),
               l AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""),
    Query("hot_percentiles", hot_percentiles, """
        WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
        SELECT share::DOUBLE AS share, round(value, 6) AS value FROM r, (VALUES (0.05), (0.5), (0.95), (0.999)) s(share) WHERE i = least(floor(n * share::DOUBLE), n - 1) + 1"""),
    Query("job_states", job_states, "SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ready' ELSE 'running' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    Query("interrupted_jobs", interrupted_jobs, """
        WITH j AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ready' ELSE 'running' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT user_id, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, CASE status WHEN 'running' THEN 'interrupted' END AS error FROM j"""),
    Query("job_updates", job_updates, """
        WITH j AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT user_id, 'running' AS status, CASE WHEN user_id % 2 = 0 THEN 'indexing' ELSE 'extracting' END AS stage, CASE WHEN user_id % 3 = 0 THEN 'slow' ELSE 'old' END AS error FROM j WHERE event_type NOT IN ('error', 'purchase')"""),
    Query("recent_jobs", recent_jobs, """
        WITH j AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT user_id, event_id FROM j WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20"""),
    Query("video_cost", video_cost, f"SELECT event_id, {_TOK(70)} AS tokens, {_TOK(280)} AS high_tokens, round((({_TOK(70)}) * 0.3 + 500 * 2.5) / 1000000, 8) AS cost_usd FROM events"),
    Query("mode_decision", mode_decision, """
        WITH m AS (SELECT event_id, value * 20 AS s, CASE WHEN event_id % 3 <> 0 AND (event_type = 'view' OR user_id % 2 = 0) AND value * 20 <= 1800 THEN 'media' ELSE 'metadata' END AS mode FROM events)
        SELECT event_id, mode, CASE WHEN mode = 'media' AND round(((CASE WHEN s <= 0 THEN 0 ELSE greatest(1, floor(s)) * 70 + floor(s * 32) END) * 1.5 + 500 * 9.0) / 1000000, 8) > 0.05 THEN 'metadata' ELSE mode END AS final_mode FROM m"""),
]
