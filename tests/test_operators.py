"""Operators on small inputs: literal cases, invariants, brute force, batch against stream."""

import collections
import html as html_lib
import ipaddress
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.functions import envelope as E
from larder.functions import pricing
from larder.operators import chunking as C
from larder.operators import governor as G
from larder.operators import merge as M
from larder.operators import retrieval as R
from larder.operators import store as S
from larder.operators import telemetry as T
from larder.operators.html import Page, clean
from larder.plans import catalog
from larder.schema import ATTEMPTS, ENVELOPES
from larder.sources import files
from tests.conftest import SF


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .!?\n", max_size=60), max_size=20), st.integers(20, 80))
def test_split_text_keeps_all_words(parts, size):
    text = "\n\n".join(parts)
    pieces = C.split_text(text, size, 0)
    assert " ".join(pieces).split() == text.split()
    assert all(len(p) <= size or " " not in p.strip() for p in pieces)


def test_overlap_is_prepended():
    pieces = C.split_text("\n\n".join(["alpha beta gamma delta"] * 4), 50, 12)
    assert len(pieces) > 1 and pieces[1].startswith("gamma delta\n\n")
    assert C.split_text("", 50, 12) == []


def test_rrf_case(spark):
    kw = spark.createDataFrame([("a", 1), ("b", 2)], "k string, rank int")
    vec = spark.createDataFrame([("b", 1), ("c", 2)], "k string, rank int")
    got = R.top_fused(R.fuse({"keyword": (kw, 0.5), "vector": (vec, 1.0)}, "k"), "k").orderBy("position").collect()
    assert [r["k"] for r in got] == ["b", "c", "a"]
    assert abs(got[0]["score"] - (0.5 / 62 + 1 / 61)) < 1e-12
    assert R.fuse({"keyword": (kw, 0.0), "vector": (vec, 1.0)}, "k").count() == 2


def test_bm25_without_terms_is_empty(spark):
    docs = spark.createDataFrame([(1, "x")], "k int, body string")
    assert R.bm25(docs, "k", [], {"body": 1.0}).count() == 0


def test_search_without_vectors_is_keyword_search(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "grey")], "k int, body string")
    got = R.search(docs, None, "k", "chunk", "fox ", None, "hybrid", {"body": 1.0}).collect()
    assert {r["k"] for r in got} <= {1, 2}


def test_rate_limit_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.randrange(5000)) for i in range(300)]
    df = spark.createDataFrame(rows, "u int, e int, s int").select("u", "e", F.timestamp_seconds("s").alias("ts"))
    got = {r["e"]: r["allowed"] for r in G.hourly_cap(df, "u", "ts", "e", 4, 600).collect()}
    passed = collections.defaultdict(list)
    for u, e, s in sorted(rows, key=lambda r: (r[2], r[1])):
        passed[u] = [p for p in passed[u] if p >= s - 600]
        ok = len(passed[u]) < 4
        passed[u] += [s] * ok
        assert got[e] == ok


def test_streaming_limiter_equals_batch(spark):
    q = catalog.queries()
    a = {tuple(r) for r in q["rate_limit"](spark, SF).select("event_id", "allowed").collect()}
    b = {tuple(r) for r in q["stream_rate_limit"](spark, SF).select("event_id", "allowed").collect()}
    assert a == b


def test_quota_cases(spark):
    t = lambda rows: spark.createDataFrame([("s", s, n) for s, n in rows], "svc string, s long, n long").select("svc", F.timestamp_seconds("s").alias("ts"), "n")
    last = lambda rows: G.window_metrics(t(rows), "svc", "ts", F.col("n")).orderBy(F.desc("ts")).first()
    r = last([(0, 100), (10, 200), (20, 0)])
    assert (r["rpm"], r["tpm"], r["rpd"], r["tpd"]) == (3, 300.0, 3, 300.0)
    r = last([(0, 50), (30, 50), (65, 0)])
    assert (r["rpm"], r["tpm"], r["rpd"], r["tpd"]) == (2, 50.0, 3, 100.0)
    free = G.seconds_to_free(t([(0, 1), (10, 1)]), "svc", "ts").orderBy(F.desc("ts")).first()["free_s"]
    assert free == 50.0
    states = [spark.range(1).select(G.pacing_state(F.lit(n), F.lit(0), F.lit(0), 10, 1e9, 1e9)).first()[0] for n in (5, 7, 8, 9)]
    assert states == ["healthy", "warning", "throttled", "throttled"]
    waits = spark.range(1).select(G.backoff_seconds(F.lit(9), F.lit(5.0)), G.backoff_seconds(F.lit(3)), G.backoff_seconds(F.lit(9))).first()
    assert tuple(waits) == (5.0, 60.0, 90.0)


def test_costs(spark):
    r = spark.range(1).select(pricing.video_tokens(F.lit(60.0)), F.round(pricing.video_cost(F.lit(60.0), F.lit("gemini-3.5-flash-lite")), 6), pricing.cost(F.lit("nobody"), F.lit(5), F.lit(5)), pricing.is_priced(F.lit("gemini-2.5-pro-preview")), pricing.video_tokens(F.lit(0.0))).first()
    assert tuple(r) == (6120, 0.003086, 0.0, True, 0)


def test_signal_cases(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(words(40), "article", None, "strong"), (None, "article", words(60), "strong"), (None, "video", words(60), "weak"), (None, "article", words(5), "weak"), (None, "article", words(4), "none"), (None, "article", "#a #b #c #d #e #f", "none")]
    df = spark.createDataFrame(rows, "article_text string, media_kind string, caption string, want string")
    for c in ("title", "author", "transcript", "ocr_text", "visual_description", "thumbnail_url", "media_url"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("platform_tags", F.array().cast("array<string>"))
    assert [r[0] for r in df.select(E.signal()).collect()] == [r[3] for r in rows]


def test_cascade_fills_gaps(spark):
    c = spark.createDataFrame([(1, 0, "X", None, 5), (1, 1, "", "Y", 0), (2, 0, "only", None, None)], "k int, r int, caption string, transcript string, likes int")
    got = {r["k"]: r for r in M.cascade(c, "k", "r", F.col("transcript").isNull(), ["caption", "transcript", "likes"], []).collect()}
    assert (got[1]["caption"], got[1]["transcript"], got[1]["likes"], got[1]["stopped"]) == ("X", "Y", 0, True)
    assert (got[2]["caption"], got[2]["stopped"]) == ("only", False)


def test_fold_repeats(spark):
    r = spark.range(1).select(M.fold_repeats(F.array(*map(F.lit, ["a", "a b", "b", "c", "c"])))).first()[0]
    assert r == ["a", "a b", "c"]


def test_versioned_table(spark, tmp_path):
    t = S.Table(spark, f"file://{tmp_path}/t", "k int, v string, created_at int, updated_at int", "k")
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], t.schema))
    t.upsert(spark.createDataFrame([(2, "c", 9, 9)], t.schema))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", 1, 1), (2, "c", 1, 9)]
    t.forget(spark.createDataFrame([(1,)], "k int"))
    assert [r["k"] for r in t.read().collect()] == [2]


def test_a_change_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    t = S.Table(spark, f"file://{tmp_path}/t", "k int, v string", "k", buckets=5)
    t.append(spark.range(100).selectExpr("cast(id as int) AS k", "'old' AS v"))
    first = t._state()
    assert len(first) == 5 and t.buckets == 5
    again = S.Table(spark, t.path, t.schema, "k", buckets=99)  # what is stored counts
    assert again.buckets == 5
    again.replace(spark.createDataFrame([(7, "new"), (7, "two")], t.schema))
    second = t._state()
    assert sum(first[b] != second[b] for b in first) == 1
    assert sorted(r["v"] for r in t.read().filter("k = 7").collect()) == ["new", "two"] and t.read().count() == 101
    t.append(spark.createDataFrame([(7, "more")], t.schema))
    assert t.read().count() == 102 and max(map(len, t._state().values())) == 2
    t.forget(spark.createDataFrame([(7,)], "k int"))
    assert t.read().count() == 99 and t.vacuum() >= 2 and t.read().count() == 99
    assert t.read().filter("v = 'old'").count() == 99


def test_nearest_rank(spark):
    df = spark.range(1, 26).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    assert df.groupBy("g").agg(T.nearest_rank(F.col("v"), 0.95).alias("p")).first()["p"] == 24.0
    assert T.nearest_rank_by_window(df, ["g"], "v", 0.95).first()["picked"] == 24.0


def test_tier_stats_of_skips_only(spark):
    a = spark.createDataFrame([("h", "t", False, True, None, None, None)], ATTEMPTS)
    r = T.tier_stats(a, ["t"]).first()
    assert (r["ran"], r["success_rate"], r["avg_ms"]) == (0, None, None)


def test_files(spark, tmp_path):
    (tmp_path / "u.json").write_text('[{"id": "1", "url": "u", "final_url": "f"}, {"id": "2", "url": " "}, {"id": "3", "url": "x"}]')
    assert [r["url"] for r in files.read_urls(spark, f"{tmp_path}/u.json").collect()] == ["f", "x"]
    (tmp_path / "run1.json").write_text('{"tag": "a", "total_items": 1, "items": [{"item_id": "i", "total_ms": 2.5}]}')
    (tmp_path / "run2.json").write_text("{broken")
    runs, items = files.read_runs(spark, f"{tmp_path}/run*.json")
    assert runs.count() == 1 and items.first()["total_ms"] == 2.5
    (tmp_path / "r.csv").write_text('Index,Latency (ms),Body\n1,2.5,"{""a"": 1}"\n2,3,oops\n')
    got = files.read_report_csv(spark, f"{tmp_path}/r.csv", ("body",)).select("latency_ms", F.try_variant_get("body", "$.a", "int").alias("a"), "body_raw").collect()
    assert [tuple(r) for r in got] == [("2.5", 1, '{"a": 1}'), ("3", None, "oops")]
    d, p = files.taxonomy(spark, {"platforms": {"x": {"domain_patterns": ["x.com"], "page_types": {"post": {"url_patterns": ["/p/"]}}}}})
    assert d.count() == 1 and p.first()["url_pattern"] == "/p/"
    S.write_report_csv(spark.createDataFrame([(True, "a\nb")], "success boolean, t string"), f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).first()["t"] == "a b"


def test_malformed_html():
    p = Page("<div><p>open <b>bold<p>next</div></b></i><script>var a='<p>'")
    assert p.record(None)["body_words"] >= 3 and p.title is None
    assert Page("").record(None)["article_text"] is None


def test_envelope_schema(spark):
    assert len(spark.createDataFrame([], ENVELOPES).columns) == 27


def _plain_main_text(page):
    """The best container by its definition, every container looked at by itself."""
    def drop(e):
        e.kids = [k for k in e.kids if isinstance(k, str) or not k.is_noise()]
        for k in e.kids:
            if not isinstance(k, str):
                drop(k)

    def text(e):
        return " ".join(t.strip() for t in e.texts() if t.strip())

    def density(e, n):
        return min(1.0, sum(len(text(a)) for a in e.walk() if a.tag == "a" and a is not e) / n) if n else 1.0

    drop(page.root)
    every = list(page.root.walk())
    boxes = [e for e in every if e.tag == "article"] + [e for e in every if e.tag == "main"] + [e for e in every if e.tag in ("div", "section")] + [e for e in every if e.tag == "body"][:1]
    best, best_score = None, 0.0
    for box in boxes:
        blocks = [text(e) for e in box.walk() if e is not box and e.tag in {"p", "h1", "h2", "h3", "li", "blockquote"} and len(text(e)) > 30 and density(e, len(text(e))) <= 0.5]
        whole = "\n\n".join(blocks)
        share = density(box, len(whole))
        score = 0.0 if share > 0.5 else len(whole) * (1 - share) * (1 + 0.02 * whole.count("\n\n"))
        if score > best_score:
            best, best_score = whole, score
    out = clean(best)
    return out[:20_000] if out and len(out) >= 200 else None


def test_main_text_against_its_definition(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()][:80]
    rng = random.Random(7)
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(4, 30)):
            tag = rng.choice(["div", "section", "article", "p", "li", "nav", "a", "span", "h2", "main", "blockquote"])
            words = " ".join(rng.choices(["alpha", "beta", "gamma", "delta, epsilon"], k=rng.randrange(20)))
            parts.append(rng.choice([f"<{tag}>{words}", f"<{tag}>{words}</{tag}>", f"</{tag}>", f'<{tag} class="sidebar">{words}</{tag}>', words]))
        pages.append("<body>" + "".join(parts))
    for html in pages:
        assert Page(html).main_text() == _plain_main_text(Page(html))


def test_link_density_and_words_against_patterns(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: r for r in catalog.queries()["link_density"](spark, SF).collect()}
    for r in rows:
        body = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<script.*?</script>|<style.*?</style>", "", r["html"].replace("<!DOCTYPE html>", ""))
        size = lambda part: sum(len(html_lib.unescape(t).strip()) for t in re.split(r"<[^>]+>", part))
        linked = sum(size(a) for a in re.findall(r"(?s)<a [^>]*>(.*?)</a>", body))
        assert got[r["page_id"]]["link_density"] == round(linked / size(body), 6)
        assert got[r["page_id"]]["body_words"] == sum(len(html_lib.unescape(t).split()) for t in re.split(r"<[^>]+>", body))


def test_entities_against_plain_code(spark):
    from larder.plans.text import _STOP

    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.queries()["entities"](spark, SF).collect():
        t, author = text[r["doc_id"]], "Ann Lee" if r["doc_id"] % 2 == 0 else None
        handles = ["@" + h for h in re.findall(r"@([A-Za-z0-9._]{2,30})", t)[:5]]
        people = [author, *[h for h in handles if h != author]] if author else handles
        found = []
        for x in re.findall(r"\b(?:[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){0,3})\b", t):
            if len(x.strip()) >= 3 and x.strip().lower() not in _STOP and x.strip() not in found:
                found.append(x.strip())
        found = found[:8]
        assert r["people"] == "|".join(people[:6])
        assert r["organizations"] == "|".join([x for x in found if " " not in x][:6])


def test_chunks_of_the_query(spark):
    """Ordinals are gapless; bodies hold every word of the text, in order, within their size."""
    from larder.plans.text import _chunked

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = collections.defaultdict(list)
    for r in _chunked(spark, SF).collect():
        by[r["doc_id"]].append((r["ordinal"], r["kind"], r["text"]))
    for doc, rows in by.items():
        rows.sort()
        assert [o for o, _, _ in rows] == list(range(len(rows)))
        words, at = docs[doc].split(), 0
        for _, kind, text in rows:
            if kind == "body":
                mine = text.split()
                start = next((k for k in range(at, max(-1, at - len(mine)) - 1, -1) if k >= 0 and words[k : k + len(mine)] == mine), None)
                assert start is not None and start <= at
                at = start + len(mine)
        assert not words or at == len(words)


def test_line_fold_against_plain_code(spark):
    from larder.functions import urls as U

    cases = [["a", "a b", "b", "c", "c"], [], ["x"], ["abc", "b", "abcd", "d"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, lines array<string>").select("i", M.fold_repeats(F.col("lines")).alias("out"))
    for r in df.collect():
        kept = []
        for x in cases[r["i"]]:
            if not kept or x not in kept[-1]:
                kept.append(x)
        assert r["out"] == kept
    rng = random.Random(1)
    heads = [0x2001, 0x2002, 0x2606, 0xFE80, 0xFC00, 0x3FFF, 0]
    hosts = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(300)]
    hosts += [str(ipaddress.IPv6Address(rng.choice(heads) << 112 | rng.getrandbits(rng.choice([40, 90, 112])))) for _ in range(300)]
    hosts += ["10.1.2.3", "169.254.169.254", "100.64.0.1", "192.0.2.1", "198.18.0.1", "::", "::1", "::ffff:127.0.0.1"]
    got = {r["h"]: r["p"] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", U.is_public_address(F.col("h")).alias("p")).collect()}
    for h in hosts:
        a = ipaddress.ip_address(h)
        a = getattr(a, "ipv4_mapped", None) or a
        if not a.is_global or a.is_multicast:
            assert not got[h], h
        elif a.version == 4:
            assert got[h], h
    urls = {"http://example.org/": True, "https://[::1]/": False, "ftp://example.org/": False, "http://127.0.0.1:8000/": False, "https://user@10.0.0.1/": False, "//example.org": False, "http://[2606:4700::1]:80/x": True}
    out = {r["u"]: r["p"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.is_public_url(F.col("u")).alias("p")).collect()}
    assert out == urls
