"""Queries against their SQL on small tables of odd rows."""

from pyspark.sql import functions as F

from larder.functions.text import ONE_UPPER
from larder.operators import html as HT
from larder.plans import catalog
from larder.sources import payloads as P
from larder.sources import web as W
from tests.oracle import connection, same


def _same_as_sql(spark, folder, query, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    q = next(q for q in catalog.ALL if q.name == query)
    same(q.run(spark, str(folder)), connection(str(folder)), q.sql)


def _pages(*titles, body="<article><p>" + "A sentence of the page's main text. " * 9 + "</p></article>"):
    return [(i, f"https://a.example.com/{i}", f"<html><head><title>{t}</title><script>if (a && b) x = '&amp';</script></head><body>{body}</body></html>") for i, t in enumerate(titles)]


PAGE = "page_id long, url string, html string"
#: Titles that a cut ends inside a reference or right before its semicolon, and whole ones.
TITLES = ["a &amp; b &amp", "a &am", "x &lt", "&quot;q&quot;&quo", "it&#x27;s &amp;lt; &#x27", "R&D &ampx; c", "&", "&amp;"]


def test_title_that_ends_in_a_stump_of_a_reference(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "html_title", "pages", _pages(*TITLES), PAGE)


def test_web_record_of_a_title_that_ends_in_a_stump(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "web_record", "pages", _pages(*TITLES), PAGE)


def test_stream_ingest_of_titles_that_end_in_a_stump(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "stream_ingest", "pages", _pages(*TITLES), PAGE)


def test_replace_chunks_with_letters_of_long_upper_case(spark, tmp_path):
    texts = ["Straße\nweiß", "ß", "", "\n", "ßß a", "ﬁn ŉ ΐ ᾳ", "été 𐐨 ĳ", "".join(ONE_UPPER), None, "a\nb"]
    rows = [(i, t, "fr" if i % 10 < 9 else "de") for i, t in enumerate(texts)]
    _same_as_sql(spark, tmp_path, "replace_chunks", "documents", rows, "doc_id long, text string, lang string")


def test_client_shapes_of_pages_with_a_short_article(spark, tmp_path):
    rows = _pages(*TITLES, body="<article><h1>Few words.</h1><p>Few words that are no two hundred letters.<br></article>")
    _same_as_sql(spark, tmp_path, "client_shapes", "pages", rows, PAGE)


def test_kind_of_pages_that_mark_up_no_article(spark):
    long = "<p>" + "A sentence of the page's main text. " * 9 + "</p>"
    bodies = ["<article>Short.</article>", "<article> <p> </p></article>", "<p>Short.</p>", "<article><script>x</script></article>", long]
    pages = spark.createDataFrame([(i, f"https://a.example.com/{i}", "web", f"<title>t</title>{b}") for i, b in enumerate(bodies)], "k long, canonical_url string, platform string, html string")
    want = ["article", "unknown", "unknown", "unknown", "article"]
    assert [r["media_kind"] for r in W.web_records(pages, "k").orderBy("k").collect()] == want
    client = pages.select("k", "canonical_url", "platform", F.to_json(F.struct("html")).alias("payload"))
    got = P.client_records(client, "k", "payload").orderBy("k").collect()
    assert [r["media_kind"] for r in got] == want and got[0]["article_text"] is None and got[4]["article_text"]


def test_references_as_html_reads_them_or_whole_ones_only():
    html = "<title>a &amp</title><script type='application/ld+json'>{\"headline\": \"b &amp\"}</script><a href='?a=1&b=2'>&eacute; &eacute &#65; &#65 &no; <!-- & --></a>"
    text = lambda page: "".join(page.root.texts())
    assert text(HT.Page(html)) == "a &é é A A &no; " and text(HT.Page(html, True)) == "a &ampé &eacute A &#65 &no; "
    for page in (HT.Page(html), HT.Page(html, True)):
        assert page.linked_data("headline") == "b &amp" and [e.attrs["href"] for e in page.root.walk() if e.tag == "a"] == ["?a=1&b=2"]
