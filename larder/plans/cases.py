"""Rules with many cases, asked of whole tables: each row of a table becomes one of the cases, with its own id in it.

A case is a pair of texts, what goes in and what must come out, in which ``{id}`` stands for the row's id; the row's id
says which case it is.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import models as MD
from larder.functions import tags as TG
from larder.functions import text as X
from larder.functions import urls as U
from larder.operators import retrieval as R
from larder.plans.common import Query, quoted, read, texts
from larder.sources import payloads as P

Case = str | None


def templated(key: str, cases: list[Case], of: str | None = None) -> Column:
    """The case of a row, its id put in.  of: the column that says which case it is, if not the id."""
    n, out = len(cases), F.lit(None).cast("string")
    for i, case in enumerate(cases):
        parts = [] if case is None else case.split("{id}")
        joined = [c for k, p in enumerate(parts) for c in ([F.col(key).cast("string")] if k else []) + [F.lit(p)]]
        out = F.when(F.pmod(F.col(of or key), F.lit(n)) == i, F.concat(*joined) if joined else F.lit(None).cast("string")).otherwise(out)
    return out


def templated_sql(key: str, cases: list[Case], kind: str = "VARCHAR") -> str:
    one = lambda c: "NULL" if c is None else "concat(" + f", {key}, ".join("'" + p.replace("'", "''") + "'" for p in c.split("{id}")) + ")"
    return f"(CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN {one(c)}" for i, c in enumerate(cases)) + f" END)::{kind}"


def _halves(cases) -> tuple[list[Case], ...]:
    return tuple(list(x) for x in zip(*cases))


# -- addresses -------------------------------------------------------------------------

URLS = _halves([
    ("https://www.instagram.com/reels/AbC_{id}/?igsh=x", "https://instagram.com/reel/AbC_{id}/"),
    ("https://m.youtube.com/watch?v=dQw4w9_{id}&feature=share&t=10", "https://youtube.com/watch?v=dQw4w9_{id}"),
    ("https://youtube.com/shorts/abcdef{id}", "https://youtube.com/watch?v=abcdef{id}"),
    ("https://youtu.be/dQw4w9_{id}?si=z", "https://youtube.com/watch?v=dQw4w9_{id}"),
    ("https://twitter.com/Jack/statuses/{id}?s=20", "https://x.com/jack/status/{id}"),
    ("https://www.tiktok.com/@User{id}/video/123?is_from_webapp=1", "https://tiktok.com/@user{id}/video/123"),
    ("https://old.reddit.com/r/swift/comments/166p{id}/x/?context=3", "https://reddit.com/r/swift/comments/166p{id}/"),
    ("example.com/a{id}/?utm_source=x&b=2&a=1#frag", "https://example.com/a{id}?a=1&b=2"),
    ("https://www.google.com/url?sa=t&url=https%3A%2F%2Fwww.youtube.com%2Fwatch%3Fv%3Dabc{id}", "https://youtube.com/watch?v=abc{id}"),
    ("https://blog.tiontion.example.com/en/{id}/", "https://blog.tiontion.example.com/en/{id}"),
    ("ramen{id}", None), ("http://127.0.0.1/{id}", None), ("ftp://a{id}.com", None), ("", None), (None, None),
])
HOSTS = _halves([
    ("gaming.youtube.com", "youtube", "false"), ("www.instagram.com", "instagram", "false"), ("vm.tiktok.com", "tiktok", "true"), ("x.com", "twitter", "false"),
    ("old.reddit.com", "reddit", "false"), ("de.linkedin.com", "linkedin", "false"), ("notyoutube.com", "web", "false"), ("host{id}.example.org", "web", "false"),
])
ADDRESSES = _halves([
    ("::1", "false"), ("fe80::1", "false"), ("fc00::1", "false"), ("::ffff:10.0.0.1", "false"), ("::ffff:8.8.8.8", "true"), ("[2606:4700::1111]", "true"), ("2001:db8::1", "false"), ("0x7f000001", "false"),
    ("2130706433", "false"), ("8.8.8.8", "true"), ("10.0.0.1", "false"), ("127.0.0.1", "false"), ("169.254.1.1", "false"), ("172.16.0.1", "false"), ("172.32.0.1", "true"), ("192.168.1.1", "false"),
    ("224.0.0.1", "false"), ("h{id}.example.org", "true"), ("localhost", "false"), ("300.1.1.1", "false"),
])


def url_cases(spark, d):
    """Every page's address as one of the forms that addresses of posts come in."""
    pages = read(spark, d, "pages").select("page_id", templated("page_id", URLS[0]).alias("url"))
    return U.with_canonical(pages).select("page_id", "url", "canonical_url")


def url_platform(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.concat(F.lit("https://"), templated("page_id", HOSTS[0]), F.lit("/a")).alias("url"))
    return pages.select("page_id", U.platform(F.col("url")).alias("platform"), U.is_shortener(F.col("url")).alias("short"))


def public_addresses(spark, d):
    """Every page's host as one of the ways to write an address: may a server ask it?"""
    pages = read(spark, d, "pages").select("page_id", templated("page_id", ADDRESSES[0]).alias("host"))
    return pages.select("page_id", U.is_public_address(F.col("host")).alias("public"))


def media_gate(spark, d):
    pages = read(spark, d, "pages").select("page_id", templated("page_id", MEDIA[0]).alias("url"), templated("page_id", MEDIA[1]).alias("media_url"))
    return pages.select("page_id", MD.media_is_fetchable(F.col("url"), F.col("media_url")).alias("fetchable"), MD.youtube_uri(F.col("url")).alias("uri"))


_WATCH = "https://www.youtube.com/watch?v="
MEDIA = _halves([
    ("https://youtube.com/watch?v=a{id}", None, "true", _WATCH + "a{id}"), ("https://x.com/{id}", "", "false", _WATCH + "{id}"), ("https://x.com/{id}", "https://m/{id}.mp4", "true", _WATCH + "{id}"), (None, None, "false", None),
])


# -- values ----------------------------------------------------------------------------

SPANS = _halves([("PT1M{id}S", "60 + {id}"), ("PT0S", None), ("{id}1", "{id}1"), ("PT{id}1H", "{id}1 * 3600"), ("x{id}", None), ("PT2H{id}1M", "7200 + {id}1 * 60"), ("", None)])
NUMBERS = _halves([("{id}.9", "{id}"), ("{id}e3", "{id}000"), ("nan", None), ("", None), ("x{id}", None), ("-{id}.7", "-{id}"), (None, None)])
HEADERS = _halves([("{id}", "least(greatest({id}, 1), 120)"), ("0", "1"), ("5", "5"), ("9{id}99", "120"), ("soon{id}", None), ("", None), (None, None)])
KEYS = _halves([("key=AIzaSyA1234567890abc{id}&x", "key=AIza...REDACTED&x"), ("secret-key-1 used {id} times", "...REDACTED used {id} times"), ("AIza{id}", "AIza{id}"), ("AQ.abcdefghij{id} and secret-key-12", "AIza...REDACTED and ...REDACTED2"), (None, None)])


def _number_sql(cases: list[Case], kind: str) -> str:
    """The case's expression, the id put in as a number."""
    whens = " ".join(f"WHEN {i} THEN {'NULL' if c is None else _in_sql(c)}" for i, c in enumerate(cases))
    return f"(CASE event_id % {len(cases)} {whens} END)::{kind}"


def _in_sql(case: str) -> str:
    import re

    return re.sub(r"\{id\}(\d*)", lambda m: f"(event_id::VARCHAR || '{m[1]}')::BIGINT" if m[1] else "event_id", case)


def duration_cases(spark, d):
    return read(spark, d, "events").select("event_id", X.iso_duration(templated("event_id", SPANS[0])).alias("seconds"))


def number_cases(spark, d):
    return read(spark, d, "events").select("event_id", X.to_long(templated("event_id", NUMBERS[0])).alias("whole"))


def retry_times(spark, d):
    return read(spark, d, "events").select("event_id", MD.retry_after(templated("event_id", HEADERS[0])).alias("seconds"))


def redacted_keys(spark, d):
    return read(spark, d, "events").select("event_id", MD.redact_keys(templated("event_id", KEYS[0]), "secret-key-1").alias("clean"))


#: Forms that dates come in, in Spark's letters, and how much of a time each keeps.
DATES = [("yyyyMMdd", "day"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "second"), ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "second"), (None, "second"), ("yyyy-MM-dd", "day"), ("dd/MM/yyyy", "day"), ("MMM dd, yyyy", "day"), ("yyyy-MM-dd HH:mm:ss", "second"), ("'bogus 'MM", None), ("''''", None)]


def date_cases(spark, d):
    """Every event's time written in one of the forms that dates come in (one of them seconds of the epoch), and read."""
    raw, ts = F.lit(None).cast("string"), F.col("ts").cast("timestamp_ntz")
    for i, (form, _) in enumerate(DATES):
        text = F.date_format(ts, form) if form else F.unix_timestamp(ts.cast("timestamp")).cast("string")
        raw = F.when(F.col("event_id") % len(DATES) == i, text).otherwise(raw)
    return read(spark, d, "events").select("event_id", F.date_format(X.to_timestamp(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


# -- tags and categories ---------------------------------------------------------------

SLUGS = _halves([
    ("#Cooking", "cooking"), ("JS", "javascript"), ("Recipes", "recipe"), ("cookies", "cookie"), ("categories", "category"), ("physics", "physics"),
    ("tomatoes", "tomato"), ("classes", "class"), ("Machine Learning", "machine-learning"), ("postgres", "postgresql"), ("vector databases", "vector-database"),
    ("C++", "c++"), ("3d", "3d"), ("ab", None), ("fyp", None), ("{id}", None), ("news", None), ("boxes", "box"), ("movies", "movie"), ("gas", "gas"), ("", None), ("word{id}x", "word{id}x"), (None, None),
])
CATEGORIES = _halves([("Food Cooking", "how to", "food-cooking", "other"), ("foodcooking", "Case Study", "food-cooking", "case-study"), ("AI ML", "casestudy", "ai-ml", "case-study"), ("nonsense {id}", "Memes", "other", "meme"), (None, None, "other", "other")])


def tag_slugs(spark, d):
    return read(spark, d, "documents").select("doc_id", TG.slug(templated("doc_id", SLUGS[0])).alias("slug"))


def tag_normalize(spark, d):
    """Tags of every document: aliases, plurals, repeats and noise, and its own source."""
    own = F.array(F.lit("#JS"), F.lit("javascript"), F.lit("Recipes"), F.lit("fyp"), F.concat(F.lit("tag"), F.col("doc_id"), F.lit("x")), F.lit("recipe"), F.lit("3D"))
    raw = F.when(F.col("doc_id") % 3 == 0, own).when(F.col("doc_id") % 3 == 1, F.array(F.lit("viral"))).otherwise(F.array().cast("array<string>"))
    return read(spark, d, "documents").select("doc_id", F.array_join(TG.normalize(raw), ",").alias("tags"))


def category_coerce(spark, d):
    a, b = (templated("doc_id", CATEGORIES[k]) for k in (0, 1))
    return read(spark, d, "documents").select("doc_id", TG.category(a).alias("category"), TG.content_type(b).alias("content_type"))


def query_terms(spark, d):
    """Every document's text, and what readers may type, compiled as keyword queries."""
    q = F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" wha"))).when(F.col("doc_id") % 4 == 2, F.lit("how to ")).otherwise(templated("doc_id", ["how do i rem{id}", "p"], "n_chars"))
    return R.compile_queries(texts(spark, d).select("doc_id", q.alias("q")), "doc_id", "q")


# -- payloads --------------------------------------------------------------------------

_VTT = "WEBVTT\nKind: captions\n\n1\n00:00.000 --> 00:02.000\nhello <b>there</b> friends{id}\nhello there\n\n2\n00:02.000 --> 00:03.000\nhow are you\nhow are you\n"
_event = lambda t: {"segs": [{"utf8": t}]}
_JSON3 = json.dumps({"events": [_event("one two three "), _event("two"), _event("and then\nfour five six{id}")]})
SUBTITLES = _halves([(_VTT, "vtt", "hello there friends{id} how are you"), (_JSON3, "json3", "one two three and then four five six{id}"), ("short", "vtt", None)])
TRACKS = [[("de", "vtt", "a"), ("en-GB", "ttml", "b"), ("en-GB", "vtt", "c"), ("en-X", "json3", "d")], [("fr", "srt", "e"), ("fr", "vtt", "f")]]
_N = '"@id@"'


def _json(value) -> str:
    """JSON in which a number @id@ is the row's id."""
    return json.dumps(value).replace(_N, "{id}")


CLIENT = [
    _json({"username": "@ann{id}", "profile_url": "https://i.org/ann", "caption": "Pasta #Git #git", "thumbnail": "https://i.org/t.jpg", "video_url": "https://i.org/v.mp4", "duration": 31.5, "taken_at": 1748102400, "likes": "@id@", "comments": 3, "views": 0}),
    '{"Content": "long read {id}", "timestamp": "bogus", "tags": ["X", "y"]}',
]
OEMBED = [json.dumps({"title": "A{id}", "author_name": "Ann", "html": '<blockquote class="q"><p>Hi <b>you{id}</b></p></blockquote><script></script>'}), json.dumps({"title": " B{id} ", "html": "<blockquote>no</blockquote>"})]
REDDIT = [
    _json([
        {"data": {"children": [{"data": {"title": "Q{id}", "author": "bo", "selftext": "body text", "subreddit": "Swift", "link_flair_text": "Help me", "ups": "@id@", "num_comments": 2, "created_utc": 1748102400.0, "thumbnail": "self", "is_video": False}}]}},
        {"data": {"children": [{"kind": "t1", "data": {"body": "first{id}"}}, {"kind": "t1", "data": {"body": "[deleted]"}}, {"kind": "more", "data": {"body": "x"}}]}},
    ]), "[]",
]
_EMBED = {"gql_data": {"shortcode_media": {"owner": {"username": "ann{id}"}, "is_video": True, "video_url": "https://i/v.mp4", "edge_media_to_caption": {"edges": [{"node": {"text": "Ship it #git #devops"}}]}, "edge_liked_by": {"count": "@id@"}, "video_view_count": 9}}}
EMBEDS = ['<script>s.handle({"contextJSON":' + json.dumps(_json(_EMBED)) + "})</script>", '"contextJSON":"{broken', "x"]
_RSS = """<rss><channel><item><title><![CDATA[Other]]></title><link>https://m.org/@a/other-0011aabb</link><guid>https://m.org/p/0011aabb</guid></item>
<item><title>My post {id} &amp; more</title><dc:creator>Ann</dc:creator><link>https://m.org/@a/my-great-post-deadbeef99</link><guid>https://m.org/p/deadbeef99</guid><pubDate>Mon, 31 Aug 2026 10:42:27 GMT</pubDate><category>AI</category><category>ML</category></item></channel></rss>"""
POSTS = ["https://m.org/@a/my-great-post-deadbeef99", "https://m.org/@a/my-great-post-0123456789", "https://m.org/@a/none-cccccccc"]
_format = lambda u, h, v="avc", a="aac", e="mp4", p="https": {"url": u, "height": h, "vcodec": v, "acodec": a, "ext": e, "protocol": p}
VIDEOS = [
    _json({"title": "V{id}", "uploader": "bo", "webpage_url": "https://p", "duration": 12.0, "view_count": 3, "formats": [_format("https://p", 540), _format("a{id}", 1080), _format("b{id}", 480), _format("c", 540, a="none"), _format("d", 540, p="m3u8"), _format("e", 540, v="none")]}),
    _json({"title": "C{id}", "entries": [{"title": "first", "url": "https://x/i{id}.jpg", "like_count": "@id@"}]}),
]
_PART = lambda t: {"parts": t}
ANSWERS = _halves([
    ('{"summary": " a  b{id} ", "details": ["x  y{id}", " "], "tags": ["JS", "fyp"], "category": "AI ML", "content_type": "how", "people": ["P1","P2","P3","P4","P5","P6","P7","P8","P9"], "language": ""}', "a b{id}", "x y{id}", "javascript,recipe", "ai-ml", "other", "8"),
    ("no json {id}", None, None, None, None, None, None),
])
RESPONSES = _halves([
    (json.dumps({"candidates": [{"content": _PART([{"text": "a{id}"}, {"thought": 1}, {"text": "b "}]), "finishReason": "STOP"}]}), "a{id}b", "STOP"),
    ('{"promptFeedback": {"blockReason": "SAFETY"}}', "", "blocked: SAFETY"), ("{}", "", "no candidates"), ('{"candidates": [{}]}', "", "unknown"),
])


def _pages(spark, d, cases: list[Case], name: str, **more: list[Case]):
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), "page_id").select("id", templated("id", cases).alias(name), *[templated("id", c).alias(k) for k, c in more.items()])


def subtitle_flatten(spark, d):
    """Every page with a subtitle file of one of the kinds, as plain text."""
    return _pages(spark, d, SUBTITLES[0], "body", ext=SUBTITLES[1]).select("id", P.subtitle_text(F.col("body"), F.col("ext")).alias("text"))


def subtitle_choice(spark, d):
    """Every page with some subtitle tracks: the one to take."""
    tracks = lambda ts: F.array(*[F.struct(F.lit(i).alias("position"), F.lit(a).alias("language"), F.lit(e).alias("ext"), F.concat(F.lit(u), F.col("page_id")).alias("url")) for i, (a, e, u) in enumerate(ts)])
    rows = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.inline(F.when(F.col("page_id") % 2 == 0, tracks(TRACKS[0])).otherwise(tracks(TRACKS[1]))))
    return P.subtitle_choice(rows, "id").select("id", "language", "ext", "url")


def client_payload(spark, d):
    out = P.client_payload(_pages(spark, d, CLIENT, "body", platform=["instagram", "web"]), "id", "body")
    return out.select("id", "author", "caption", "media_url", "article_text", "duration_s", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "like_count", "view_count", F.array_join("platform_tags", ",").alias("tags"), "media_kind")


def oembed(spark, d):
    return P.oembed(_pages(spark, d, OEMBED, "body", platform=["twitter", "youtube"]), "id", "body").select("id", "title", "author", "caption")


def reddit_post(spark, d):
    out = P.reddit(_pages(spark, d, REDDIT, "body"), "id", "body")
    return out.select("id", "title", "author", "author_url", "article_text", "thumbnail_url", "like_count", "comment_count", F.array_join("platform_tags", ",").alias("tags"), "media_kind")


def instagram_embed(spark, d):
    out = P.instagram_embed(_pages(spark, d, EMBEDS, "html"), "id", "html")
    return out.select("id", "title", "caption", "author", "media_url", F.array_join("platform_tags", ",").alias("tags"), "like_count", "view_count", "media_kind")


def feed_match(spark, d):
    """Every page as a post with the feed of its site: the post's entry, by its address or its words."""
    items = P.rss_items(_pages(spark, d, [_RSS], "xml"), "id", "xml")
    out = P.match_feed(_pages(spark, d, POSTS, "url"), items, "id", "url")
    return out.select("id", "title", "author", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.array_join("platform_tags", ",").alias("tags"))


def video_metadata(spark, d):
    out = P.video_metadata(_pages(spark, d, VIDEOS, "body"), "id", "body")
    return out.select("id", "title", "author", "media_url", "duration_s", "like_count", "media_kind")


def model_answers(spark, d):
    """A model's answer to every document, checked and cut to its limits."""
    rows = read(spark, d, "documents").select("doc_id", MD.answer(templated("doc_id", ANSWERS[0]), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Recipes"), F.lit("js")))).alias("a"))
    return rows.select("doc_id", "a.summary", F.array_join("a.details", "|").alias("details"), F.array_join("a.tags", ",").alias("tags"), "a.category", "a.content_type", F.size("a.entities.people").alias("people"), "a.language")


def model_responses(spark, d):
    body = templated("event_id", RESPONSES[0])
    return read(spark, d, "events").select("event_id", F.coalesce(MD.answer_text(body), F.lit("")).alias("text"), MD.finish_reason(body).alias("reason"))


_t = templated_sql
_STOP = quoted(R.QUERY_STOPWORDS)

QUERIES = [
    Query("url_cases", url_cases, f"SELECT page_id, {_t('page_id', URLS[0])} AS url, {_t('page_id', URLS[1])} AS canonical_url FROM pages"),
    Query("url_platform", url_platform, f"SELECT page_id, {_t('page_id', HOSTS[1])} AS platform, {_t('page_id', HOSTS[2], 'BOOLEAN')} AS short FROM pages"),
    Query("public_addresses", public_addresses, f"SELECT page_id, {_t('page_id', ADDRESSES[1], 'BOOLEAN')} AS public FROM pages"),
    Query("media_gate", media_gate, f"SELECT page_id, {_t('page_id', MEDIA[2], 'BOOLEAN')} AS fetchable, {_t('page_id', MEDIA[3])} AS uri FROM pages"),
    Query("duration_cases", duration_cases, f"SELECT event_id, {_number_sql(SPANS[1], 'DOUBLE')} AS seconds FROM events"),
    Query("number_cases", number_cases, f"SELECT event_id, {_number_sql(NUMBERS[1], 'BIGINT')} AS whole FROM events"),
    Query("retry_times", retry_times, f"SELECT event_id, {_number_sql(HEADERS[1], 'DOUBLE')} AS seconds FROM events"),
    Query("redacted_keys", redacted_keys, f"SELECT event_id, {_t('event_id', KEYS[1])} AS clean FROM events"),
    Query("date_cases", date_cases, f"SELECT event_id, strftime(CASE event_id % {len(DATES)} {' '.join(f'WHEN {i} THEN ' + (f'''date_trunc('{k}', ts)::TIMESTAMP''' if k else 'NULL') for i, (_, k) in enumerate(DATES))} END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events"),
    Query("tag_slugs", tag_slugs, f"SELECT doc_id, {_t('doc_id', SLUGS[1])} AS slug FROM documents"),
    Query("tag_normalize", tag_normalize, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'javascript,recipe,tag' || doc_id || 'x,3d' ELSE '' END AS tags FROM documents"),
    Query("category_coerce", category_coerce, f"SELECT doc_id, {_t('doc_id', CATEGORIES[2])} AS category, {_t('doc_id', CATEGORIES[3])} AS content_type FROM documents"),
    Query("query_terms", query_terms, rf"""
        WITH q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' wha' WHEN 2 THEN 'how to ' ELSE CASE WHEN n_chars % 2 = 0 THEN 'how do i rem' || doc_id ELSE 'p' END END AS q FROM documents),
        f AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(q), '[^\p{{L}}\p{{M}}\p{{N}}_]+') IF x <> ''] AS f, regexp_matches(q, '[\p{{L}}\p{{M}}\p{{N}}_]\z') AS typing FROM q),
        w AS (SELECT doc_id, typing, f[-1] AS part, [x FOR x IN CASE WHEN typing THEN f[:-2] ELSE f END IF length(x) > 1] AS whole FROM f),
        t AS (SELECT *, [x FOR x IN whole IF x NOT IN ({_STOP})] AS kept FROM w),
        l AS (SELECT doc_id, len(kept) AS n, list_concat(CASE WHEN len(kept) = 0 AND NOT typing THEN whole ELSE kept END, CASE WHEN typing AND (length(part) > 1 OR len(kept) = 0) THEN [part] ELSE [] END) AS terms, typing AND (length(part) > 1 OR len(kept) = 0) AS last FROM t),
        r AS (SELECT doc_id, unnest(range(len(terms))) AS ordinal, unnest(terms) AS term, len(terms) AS n, last FROM l)
        SELECT doc_id, ordinal::INTEGER AS ordinal, term, last AND ordinal = n - 1 AS is_prefix FROM r"""),
    Query("subtitle_flatten", subtitle_flatten, f"SELECT page_id AS id, {_t('page_id', SUBTITLES[2])} AS text FROM pages"),
    Query("subtitle_choice", subtitle_choice, "SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'en-GB' ELSE 'fr' END AS language, 'vtt' AS ext, CASE WHEN page_id % 2 = 0 THEN 'c' ELSE 'f' END || page_id AS url FROM pages"),
    Query("client_payload", client_payload, """
        SELECT page_id AS id, CASE WHEN e THEN '@ann' || page_id END AS author, CASE WHEN e THEN 'Pasta #Git #git' END AS caption, CASE WHEN e THEN 'https://i.org/v.mp4' END AS media_url, CASE WHEN NOT e THEN 'long read ' || page_id END AS article_text,
               CASE WHEN e THEN 31.5::DOUBLE END AS duration_s, CASE WHEN e THEN '2025-05-24 16:00:00' END AS published_at, CASE WHEN e THEN page_id END AS like_count, CASE WHEN e THEN 0 END AS view_count, CASE WHEN e THEN 'git' ELSE 'x,y' END AS tags,
               CASE WHEN e THEN 'video' ELSE 'article' END AS media_kind FROM (SELECT page_id, page_id % 2 = 0 AS e FROM pages)"""),
    Query("oembed", oembed, "SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'A' ELSE 'B' END || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'Ann' END AS author, CASE WHEN page_id % 2 = 0 THEN 'Hi you' || page_id END AS caption FROM pages"),
    Query("reddit_post", reddit_post, """
        SELECT page_id AS id, CASE WHEN e THEN 'Q' || page_id END AS title, CASE WHEN e THEN 'bo' END AS author, CASE WHEN e THEN 'https://www.reddit.com/user/bo' END AS author_url, CASE WHEN e THEN 'body text' || chr(10) || chr(10) || 'Top comments:' || chr(10) || '- first' || page_id END AS article_text,
               NULL AS thumbnail_url, CASE WHEN e THEN page_id END AS like_count, CASE WHEN e THEN 2 END AS comment_count, CASE WHEN e THEN 'swift,help,me' ELSE '' END AS tags, 'text' AS media_kind FROM (SELECT page_id, page_id % 2 = 0 AS e FROM pages)"""),
    Query("instagram_embed", instagram_embed, "SELECT page_id AS id, 'ann' || page_id || ' on Instagram' AS title, 'Ship it #git #devops' AS caption, 'ann' || page_id AS author, 'https://i/v.mp4' AS media_url, 'git,devops' AS tags, page_id AS like_count, 9 AS view_count, 'video' AS media_kind FROM pages WHERE page_id % 3 = 0"),
    Query("feed_match", feed_match, "SELECT page_id AS id, 'My post ' || page_id || ' & more' AS title, 'Ann' AS author, '2026-08-31 10:42:27' AS published_at, 'ai,ml' AS tags FROM pages WHERE page_id % 3 < 2"),
    Query("video_metadata", video_metadata, """
        SELECT page_id AS id, CASE WHEN e THEN 'V' ELSE 'C' END || page_id AS title, CASE WHEN e THEN 'bo' END AS author, CASE WHEN e THEN 'b' || page_id ELSE 'https://x/i' || page_id || '.jpg' END AS media_url, CASE WHEN e THEN 12.0::DOUBLE END AS duration_s,
               CASE WHEN NOT e THEN page_id END AS like_count, CASE WHEN e THEN 'video' ELSE 'image' END AS media_kind FROM (SELECT page_id, page_id % 2 = 0 AS e FROM pages)"""),
    Query("model_answers", model_answers, f"SELECT doc_id, {', '.join(f'{_t('doc_id', ANSWERS[k + 1], 'INTEGER' if n == 'people' else 'VARCHAR')} AS {n}' for k, n in enumerate(('summary', 'details', 'tags', 'category', 'content_type', 'people')))}, NULL AS language FROM documents"),
    Query("model_responses", model_responses, f"SELECT event_id, {_t('event_id', RESPONSES[1])} AS text, {_t('event_id', RESPONSES[2])} AS reason FROM events"),
]
