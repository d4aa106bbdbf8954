"""The library from pages to search, and again after a change."""

import json

import pytest
from pyspark.sql import functions as F

from larder.__main__ import main
from larder.engine import Library, default_tiers
from larder.operators.merge import Tier
from larder.options import Enricher, Options
from larder.service import BadRequest, NotFound, Service
from tests.conftest import SF


def _page(title: str, text: str) -> str:
    return f"<html><head><title>{title}</title></head><body><article>" + "".join(f"<p>{text} Sentence number {i} of this page.</p>" for i in range(8)) + "</article></body></html>"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    lib = Library(spark, f"file://{tmp_path_factory.mktemp('lib')}", Options(buckets=4))
    lib.add(spark.read.parquet(f"{SF}/pages.parquet").limit(25).select("url", "html"))
    lib.enrich()
    lib.index()
    return lib


def test_library(spark, library, capsys):
    lib, n = library, library.envelopes.read().count()
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(25).select("url", "html")
    assert 0 < n <= 25
    assert lib.add(pages, retry_degraded=False).count() == 0
    assert lib.enrichments.read().count() == n
    counts = lib.stats()
    assert counts["documents"] == n and counts["chunks"] >= n and counts["vectors"] == counts["chunks"]
    again = lib.index()
    assert (again.indexed, again.skipped, again.vectors) == (0, n, 0) and lib.stats() == counts
    word = lib.documents.read().first()["body"].split()[5]
    hits = lib.search(word).collect()
    assert hits and hits[0]["position"] == 1 and hits[0]["excerpt"]
    assert lib.search(word, mode="keyword", platform="youtube").count() == 0
    tag = lib.tags(1).first()["tag"]
    assert lib.search(word, tag=tag).count() >= 1
    assert lib.compare(word, 3).count() == 3
    assert lib.summary().filter("facet = 'total'").first()["items"] == n
    tried = {r["tier"]: r for r in lib.tiers_report().collect()}
    assert tried["open_graph"]["ran"] >= n - 1 and tried["client_payload"]["ran"] == 0
    assert lib.cost().first()["items"] == n
    url = lib.envelopes.read().filter("NOT degraded").first()["canonical_url"]
    assert lib.item(url).count() == 1
    at = ["--library", lib.path]
    assert main([*at, "forget", url], spark) == 0
    assert lib.item(url).count() == 0 and lib.items().count() == n - 1
    assert lib.tag_rows.read().join(lib.envelopes.read(), "url_hash", "left_anti").count() == 0
    for command in (["canonical", "m.example.org/a?utm_x=1"], ["stats"], ["counts"], ["budget", "60", "gemini-2.5-flash"], ["query", word], ["degraded"], ["preview"], ["providers"], ["tiers"], ["jobs"], ["clean"]):
        assert main([*at, *command], spark) == 0
    assert "https://example.org/a" in capsys.readouterr().out


def test_a_changed_page_is_found_by_its_new_text(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib", Options(buckets=3))
    urls = [f"https://example.org/{i}" for i in range(6)]
    lib.add(spark.createDataFrame([(u, _page(f"Page {i}", f"Plain words about subject{i}.")) for i, u in enumerate(urls)], "url string, html string"))
    lib.enrich()
    lib.index()
    before = lib.vectors.read().count()
    lib.add(spark.createDataFrame([(urls[2], _page("Volcanoes", "Lava flows from volcanoes near Hekla."))], "url string, html string"), force=True)
    lib.enrich()
    report = lib.index()
    assert report.indexed == 1 and report.skipped == 5 and report.vectors == report.chunks > 0
    got = lib.answer("lava volcanoes hekla", mode="vector", limit=1)
    assert got.vector_available and got.notes == []
    hit = got.hits.first()
    assert hit["title"] == "Volcanoes" and "olcanoes" in hit["excerpt"]
    assert lib.search("subject2", mode="keyword").count() == 0
    stored = lib.vectors.read().join(lib.chunks.read(), ["url_hash", "ordinal"], "full")
    assert stored.filter("text IS NULL OR embedding IS NULL").count() == 0 and lib.vectors.read().count() <= before + 4


def test_notes_of_a_search(spark, library):
    other = Library(spark, library.path, Options(model="another", dim=32, buckets=4))
    got = other.answer("word", mode="vector")
    assert got.hits.count() == 0 and not got.vector_available
    assert got.notes[0].startswith("no vectors for another@32; index contains hashed-words@64 (")
    assert "keyword-only" in other.answer("word").notes[0]
    empty = library.answer("   ")
    assert empty.notes == ["empty query"] and empty.hits.count() == 0
    with pytest.raises(ValueError):
        library.answer("x", mode="psychic")


def test_cascade_of_the_library(spark, tmp_path):
    def broken(df):
        raise RuntimeError("no such scraper")

    tiers = (Tier("client_payload", default_tiers()[0].extract, default_tiers()[0].applies), Tier("yt_dlp", broken), Tier("managed_api", broken, available=False, reason="not configured"), default_tiers()[3])
    lib = Library(spark, f"file://{tmp_path}/lib", Options(buckets=2, tiers=tiers))
    said = json.dumps({"caption": "My pasta recipe with tomatoes and a lot of basil, step by step", "likes": 7})
    rows = [
        ("https://www.instagram.com/reel/abc/", said, None),
        ("https://example.org/a", json.dumps({"text": "short"}), _page("A page", "It says a good deal about gardens.")),
        ("https://example.org/none", None, None),
        ("https://example.org/wall", None, "<title>Just a moment...</title><p>wait"),
    ]
    lib.add(spark.createDataFrame(rows, "url string, payload string, html string"))
    got = {r["original_url"]: r for r in lib.envelopes.read().collect()}
    reel, page, none, wall = (got[u] for u, _, _ in rows)
    assert (reel["tier"], reel["signal"], reel["degraded"], reel["like_count"]) == ("client_payload", "weak", False, 7)
    assert (page["tier"], page["title"], page["caption"]) == ("open_graph", "A page", "short") and not page["degraded"]
    assert none["degraded"] and none["tier"] == "degraded" and "retained for reprocessing" in none["extractor_note"]
    assert wall["degraded"] and wall["title"] is None
    tried = {(r["url_hash"], r["tier"]): r for r in lib.attempts.read().collect()}
    assert len(tried) == 16
    assert tried[reel["url_hash"], "client_payload"]["error"].startswith("partial: client metadata")
    assert "no such scraper" in tried[page["url_hash"], "yt_dlp"]["error"] and not tried[page["url_hash"], "yt_dlp"]["skipped"]
    assert tried[page["url_hash"], "managed_api"]["error"] == "not configured" and tried[page["url_hash"], "managed_api"]["skipped"]
    assert tried[none["url_hash"], "open_graph"]["error"] == "not applicable to this target"
    assert tried[wall["url_hash"], "open_graph"]["error"] == "no usable content"
    more = lib.add(spark.createDataFrame([(u, None, None) for u, _, _ in rows], "url string, payload string, html string"))
    assert {r["original_url"] for r in more.collect()} == {rows[2][0], rows[3][0]}


def test_enrichers_in_order(spark, tmp_path):
    answer = json.dumps({"summary": "Seen and told.", "tags": ["Lava"], "category": "science", "content_type": "explainer"})

    def first(rows):
        return rows.filter("canonical_url LIKE '%1'").select("url_hash", F.lit(answer).alias("answer"), F.lit("gemini-2.5-flash").alias("model"), F.lit(1000).alias("input_tokens"), F.lit(100).alias("output_tokens"))

    def broken(rows):
        raise RuntimeError("quota")

    options = Options(buckets=2, enrichers=(Enricher("off", first, available=False, reason="no key"), Enricher("bad", broken), Enricher("good", first)))
    lib = Library(spark, f"file://{tmp_path}/lib", options)
    lib.add(spark.createDataFrame([(f"https://example.org/{i}", _page(f"Page {i}", "About rivers and lakes.")) for i in (1, 2)], "url string, html string"))
    assert lib.preview().count() == 2
    lib.enrich()
    got = {r["provider"]: r for r in lib.enrichments.read().collect()}
    assert got["good"]["summary"] == "Seen and told." and got["good"]["cost_usd"] > 0 and not got["good"]["degraded"]
    assert "off unavailable (no key)" in got["heuristic"]["note"] and "bad metadata failed" in got["heuristic"]["note"]
    assert lib.enrich().count() == 0
    assert lib.backfill(5).count() == 1  # the degraded one is tried again
    assert {r["tag"] for r in lib.tag_rows.read().filter(F.col("url_hash") == got["good"]["url_hash"]).collect()} == {"lava"}


def test_service(spark, tmp_path):
    s = Service(Library(spark, f"file://{tmp_path}/lib", Options(buckets=2)))
    with pytest.raises(BadRequest):
        s.add_item("ramen")
    with pytest.raises(BadRequest):
        s.search("x", limit=0)
    job = s.add_item("https://example.org/soup")
    assert job["status"] == "queued" and len(s.jobs()["active"]) == 1
    pages = spark.createDataFrame([("https://example.org/soup", _page("Soup", "A soup of leeks and cream."))], "url string, html string")
    assert [r["status"] for r in s.library.run_jobs(pages).collect()] == ["ready"]
    assert s.search("leeks")["hits"][0]["title"] == "Soup" and s.stats()["documents"] == 1
    assert s.item("https://example.org/soup")["tier"] == "open_graph"
    assert s.deepen_item("https://example.org/soup") == 0
    with pytest.raises(NotFound):
        s.item("https://example.org/stew")
    out = s.analyze("https://example.org/stew", html=_page("Stew", "A stew of lamb."))
    assert out["title"] == "Stew" and len(out["vectors"][0]) == 64
    s.add_item("https://example.org/later")
    assert s.library.restart() is not None and s.jobs()["active"] == []
    assert s.clear_jobs() == {"cleared": 2} and s.jobs()["recent"] == []
    s.delete_item("https://example.org/soup")
    assert len(s.items()) == 1
    assert s.embed(["a b", "c"])["dim"] == 64


def test_one_bad_item_does_not_stop_the_index(spark, tmp_path):
    from larder.operators.embedding import hashed_words

    def provider(texts):
        if any("volcanoes" in t for t in texts):
            raise RuntimeError("refused")
        return hashed_words(texts, 64)

    lib = Library(spark, f"file://{tmp_path}/lib", Options(buckets=2, embedder=provider))
    lib.add(spark.createDataFrame([(f"https://example.org/{i}", _page(f"Page {i}", t)) for i, t in enumerate(["Plain words about bread.", "Lava flows from volcanoes."])], "url string, html string"))
    lib.enrich()
    report = lib.index()
    assert report.indexed == 2 and report.failed == 1 and report.notes == ["1 items have no vectors: their embedding failed"]
    assert lib.vectors.read().select("url_hash").distinct().count() == 1 and lib.search("volcanoes", mode="keyword").count() == 1
    again = Library(spark, lib.path, Options(buckets=2)).index()
    assert again.failed == 0 and again.indexed == 0 and lib.vectors.read().select("url_hash").distinct().count() == 2


def test_addresses_of_one_page_are_merged_whatever_their_order(spark):
    from larder.engine import _one_a_page

    rows = [("h", "https://a.org/?utm_source=b", None, "two"), ("h", "https://a.org/", "one", None), ("h", "https://a.org/?utm_source=a", "three", "four"), ("g", "https://b.org", None, None)]
    df = spark.createDataFrame(rows, "url_hash string, url string, html string, payload string")
    for n in (1, 2, 3):
        got = {tuple(r) for r in _one_a_page(df.repartition(n, "payload")).collect()}
        assert got == {("h", "https://a.org/", "one", "four"), ("g", "https://b.org", None, None)}
