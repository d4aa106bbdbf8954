"""URL, text, tag, enrichment and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import tags as TG
from larder.functions import text as X
from larder.functions import urls as U
from larder.operators import chunking as C
from larder.operators import heuristics as H
from larder.plans.common import Query, quoted, read, texts

# -- URLs ------------------------------------------------------------------------------


def _canonical(spark, d):
    return U.with_canonical(read(spark, d, "pages").select("page_id", "url"))


def url_canonical(spark, d):
    return _canonical(spark, d).select("page_id", "canonical_url", "url_hash", "platform")


def url_host_counts(spark, d):
    return _canonical(spark, d).groupBy(U.plain_host(U.netloc(F.col("url"))).alias("host")).agg(F.count("*").alias("pages"))


def url_dedup(spark, d):
    """Pages by their identity: how many share it, and the first."""
    return _canonical(spark, d).groupBy("url_hash").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


def _values(rows) -> str:
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


def url_redirects(spark, d):
    """Two shortened addresses of every page: one that a table of redirects knows (with a second target), one that none knows."""
    pages = read(spark, d, "pages")
    short = lambda host: F.concat(F.lit(f"https://{host}/"), F.col("page_id").cast("string"))
    asked = pages.select("page_id", F.explode(F.array(short("t.ly"), short("t.co"))).alias("url"))
    known = pages.select(short("t.ly").alias("short"), F.explode(F.array("url", F.concat("url", F.lit("#later")))).alias("target"))
    return U.resolve_redirects(asked, known)


_PAGE_PARTS = f"""h AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', ''), '^m\\.', '') AS host,
        regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, [x FOR x IN string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') IF regexp_matches(x, '^[^=]*=.+') AND NOT (lower(split_part(x, '=', 1)) IN ({quoted(U.TRACKING)}) OR regexp_matches(x, '^({"|".join(U.TRACKING_PREFIXES)})'))] AS q FROM pages),
    c AS (SELECT page_id, url, host, 'https://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS canonical_url FROM h)"""

# -- Text ------------------------------------------------------------------------------


def content_hash_dedup(spark, d):
    h = read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash"))
    return h.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def word_stats(spark, d):
    return read(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), X.token_estimate(F.col("text")).alias("tokens"), X.mostly_ascii(F.col("text")).alias("mostly_ascii"))


def _envelopes(spark, d):
    from larder.functions import envelope as E

    t = F.col("text")
    e = read(spark, d, "documents").select(
        "doc_id", F.split(t, "\n").getItem(0).alias("title"), F.lit("ann").alias("author"), F.when(F.col("doc_id") % 2 == 0, t).alias("caption"),
        F.array(F.lit("a"), F.lit("b")).alias("platform_tags"), F.when(F.col("doc_id") % 5 == 0, "seen").alias("visual_description"), F.lit(None).cast("string").alias("ocr_text"),
        F.when(F.col("doc_id") % 3 == 0, t).alias("transcript"), F.when(F.col("doc_id") % 4 == 0, t).alias("article_text"),
        F.when(F.col("doc_id") % 3 == 0, "video").otherwise("article").alias("media_kind"), F.lit(None).cast("string").alias("thumbnail_url"), F.when(F.col("doc_id") % 7 == 0, "https://x/v.mp4").alias("media_url"),
    )
    return e, E


def signal_gate(spark, d):
    e, E = _envelopes(spark, d)
    out = e.withColumn("signal", E.signal()).withColumns({"words": E.prose_words(), "needs_media": E.needs_media(), "usable": E.is_usable()})
    return out.select("doc_id", "signal", "words", F.coalesce("needs_media", F.lit(False)).alias("needs_media"), "usable")


_ENVELOPES = """e AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 2 = 0 THEN text END AS caption, CASE WHEN doc_id % 5 = 0 THEN 'seen' END AS visual,
        CASE WHEN doc_id % 3 = 0 THEN text END AS transcript, CASE WHEN doc_id % 4 = 0 THEN text END AS article, CASE WHEN doc_id % 3 = 0 THEN 'video' ELSE 'article' END AS kind, doc_id % 7 = 0 AS media FROM documents)"""
_COUNT = "len([x FOR x IN regexp_split_to_array(regexp_replace(coalesce({0}, ''), '#[\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '\\s+') IF x <> ''])"


def coverage_label(spark, d):
    e, E = _envelopes(spark, d)
    return e.select("doc_id", E.coverage().alias("coverage"), E.can_deepen().alias("can_deepen"))


def present_items(spark, d):
    joined = F.concat_ws(" , ", F.lit(""), "lang", F.lit(" "), "source")
    return read(spark, d, "documents").select("doc_id", F.array_join(X.present_items(joined), "|").alias("items"))


def excerpt(spark, d):
    return read(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


def clip(spark, d):
    return read(spark, d, "documents").select("doc_id", X.clip(F.col("text"), 140).alias("clip"))


def trim_document(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(X.trim_document(F.col("text"), 1500), 256).alias("trimmed"))


def clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce(X.clean_text(F.col("text")), F.lit("")), 256).alias("cleaned"))


def line_fold(spark, d):
    """Lines that the last kept line contains are dropped."""
    from larder.operators.merge import fold_repeats

    return read(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines"), F.size(fold_repeats(F.split("text", "\n"))).alias("kept"))


def redact(spark, d):
    return read(spark, d, "pages").select("page_id", X.redact_query(F.col("url")).alias("url"))


def hashtags(spark, d):
    df = read(spark, d, "documents").select("doc_id", F.concat(F.lit("#Git #git #x "), F.regexp_replace("text", r" (\w{5})", " #$1")).alias("t"))
    return df.select("doc_id", F.size(X.hashtags(F.col("t"))).alias("tags"), F.sha2(F.array_join(F.array_sort(X.hashtags(F.col("t"))), ","), 256).alias("tag_hash"))


# -- Tags ------------------------------------------------------------------------------


# -- Heuristics ------------------------------------------------------------------------

_STOP = H.stopwords(["die", "der", "und", "les", "que"])
_CUES = sorted({c for names in H.CATEGORY_CUES.values() for c in names})
_PAIRS = [f"{a} {b}" for names in H.TYPE_CUES.values() for a, b in zip(names, names[1:])]


def _at(words: list[str], place) -> F.Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(place, F.lit(len(words))) + 1).cast("int"))


def _cued(spark, d):
    """The corpus is invented words; each text gets cue words of the real tables, some of them twice."""
    cue = lambda n: _at(_CUES, F.col("doc_id") * n)
    text = F.concat_ws(" ", "text", cue(1), cue(1), cue(7), cue(7), cue(11))
    typed = F.concat_ws(" ", "text", _at(_PAIRS, F.col("doc_id")))
    return texts(spark, d).select("doc_id", text.alias("text"), F.when(F.col("doc_id") % 3 != 0, typed).otherwise(F.col("text")).alias("typed"), F.split("text", "\n").getItem(0).alias("title"))


def term_scores(spark, d):
    return H.top_terms(_cued(spark, d), "doc_id", "text", {"title": 4}, "text", _STOP, 5)


def bigrams(spark, d):
    return H.bigrams(texts(spark, d), "doc_id", "text", _STOP, 2)


def category_vote(spark, d):
    return _cued(spark, d).select("doc_id", H.category_vote(H.tokens(F.col("text"), _STOP)).alias("category"))


def content_type_vote(spark, d):
    return _cued(spark, d).select("doc_id", H.type_vote(F.lower("typed"), F.col("doc_id") % 2 == 0).alias("content_type"))


def heuristic_summary(spark, d):
    t = F.col("text")
    none = F.lit(None).cast("string")
    return texts(spark, d).select("doc_id", H.summary(F.split(t, "\n").getItem(0), t, none, none, F.lit("text")).alias("summary"), F.sha2(H.description(t, t), 256).alias("description"))


def entities(spark, d):
    e = H.entities(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit("Ann Lee")), _STOP)
    return texts(spark, d).select("doc_id", e.alias("e")).select("doc_id", F.array_join("e.people", "|").alias("people"), F.array_join("e.organizations", "|").alias("organizations"), F.array_join("e.products", "|").alias("products"))


def sentence_dedup(spark, d):
    twice = texts(spark, d).select("doc_id", F.concat("text", F.lit(" "), "text").alias("text"))
    return H.without_repeated_sentences(twice, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("kept"))


# -- Chunks ----------------------------------------------------------------------------


def keyword_fields(spark, d):
    docs = read(spark, d, "documents").select(
        "doc_id", "lang", F.split("text", "\n").getItem(0).alias("title"), F.lit("sum").alias("summary"), F.lit("").alias("description"), F.array("lang", "source").alias("tags"), F.array(F.lit("p")).alias("platform_tags"),
        F.struct(F.array(F.lit("A")).alias("people"), F.array(F.lit("B"), F.lit("A")).alias("organizations"), F.array().cast("array<string>").alias("places"), F.array(F.lit("C")).alias("products")).alias("entities"),
        F.array(F.lit("d1"), F.lit("d2")).alias("details"), F.lit("me").alias("author"), F.lit("cap").alias("caption"), F.lit(None).cast("string").alias("article_text"), F.lit("").alias("transcript"), F.lit(None).cast("string").alias("ocr_text"), F.lit("vis").alias("visual_description"),
    )
    f = C.keyword_fields(F.col("lang") != "en")
    return docs.select("doc_id", *[c.alias(k) for k, c in f.items()])


def _chunked(spark, d):
    docs = texts(spark, d).select("doc_id", F.concat(F.lit("source: "), "source").alias("digest"), F.array(F.lit("one detail"), F.lit("x"), "lang").alias("details"), "text")
    return C.chunks(docs, "doc_id", "digest", "details", "text", 2000, 300)


def chunk_split(spark, d):
    """All chunks: their ordinals, kinds and lengths."""
    return _chunked(spark, d).select("doc_id", "ordinal", "kind", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))


def chunk_counts(spark, d):
    c = _chunked(spark, d)
    return c.filter("kind <> 'body'").groupBy("doc_id", "kind").agg(F.count("*").alias("chunks"), F.max("ordinal").alias("last"))


def chunk_digest(spark, d):
    none = F.lit(None).cast("string")
    out = C.digest(F.split("text", "\n").getItem(0), F.when(F.col("doc_id") % 2 == 0, F.lit("sum")), none, F.array("lang", "source"), F.array().cast("array<string>"), F.lit("other; type: other"), none, F.lit("web"), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.sha2(out, 256).alias("digest"))


def source_fingerprint(spark, d):
    return read(spark, d, "documents").select("doc_id", C.fingerprint(F.lit("model@64"), F.col("text"), F.col("lang"), F.col("source"), F.lit(None)).alias("source_hash"))


_SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_CLIP = lambda t, n: f"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(CASE WHEN {n} - strpos(reverse(left({t}, {n})), ' ') > {n} * 0.6 AND strpos(reverse(left({t}, {n})), ' ') > 0 THEN left({t}, {n} - strpos(reverse(left({t}, {n})), ' ')) ELSE left({t}, {n}) END) || '...' END"
_TOKS = lambda c: f"[x FOR x IN regexp_extract_all(lower({c}), '[a-z][a-z0-9''\\-]{{1,30}}') IF length(x) > 2 AND x NOT IN ({quoted(_STOP)})]"
_CUED = f"""c AS (
    SELECT doc_id, text || ' ' || {' || chr(32) || '.join(f'[{quoted(_CUES)}][(doc_id * {n}) % {len(_CUES)} + 1]' for n in (1, 1, 7, 7, 11))} AS text,
           CASE WHEN doc_id % 3 <> 0 THEN text || ' ' || [{quoted(_PAIRS)}][doc_id % {len(_PAIRS)} + 1] ELSE text END AS typed, string_split(text, chr(10))[1] AS title FROM documents)"""
_SENTENCES = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"

QUERIES = [
    Query("url_canonical", url_canonical, f"WITH {_PAGE_PARTS} SELECT page_id, canonical_url, sha256(canonical_url) AS url_hash, 'web' AS platform FROM c"),
    Query("url_host_counts", url_host_counts, f"WITH {_PAGE_PARTS} SELECT host, count(*) AS pages FROM c GROUP BY host"),
    Query("url_dedup", url_dedup, f"WITH {_PAGE_PARTS} SELECT sha256(canonical_url) AS url_hash, count(*) AS pages, min(page_id) AS first_page FROM c GROUP BY 1"),
    Query("url_redirects", url_redirects, "SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'https://t.co/' || page_id FROM pages"),
    Query("content_hash_dedup", content_hash_dedup, "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1"),
    Query("word_stats", word_stats, "SELECT doc_id, len([x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''])::BIGINT AS words, greatest(1, length(text) // 4)::BIGINT AS tokens, CASE WHEN length(text) = 0 THEN true ELSE length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) > 0.9 END AS mostly_ascii FROM documents"),
    Query("signal_gate", signal_gate, f"""
        WITH {_ENVELOPES}, w AS (SELECT *, ({' + '.join(_COUNT.format(c) for c in ('title', 'caption', 'visual', 'transcript', 'article'))} + 1)::BIGINT AS words, (coalesce(transcript, '') <> '' OR coalesce(article, '') <> '' OR visual IS NOT NULL) AS body, kind = 'video' AND coalesce(transcript, '') = '' AND visual IS NULL AS unseen FROM e),
        s AS (SELECT *, CASE WHEN NOT unseen AND ((body AND words >= 40) OR words >= 60) THEN 'strong' WHEN (body AND words >= 8) OR words >= 5 THEN 'weak' ELSE 'none' END AS signal FROM w)
        SELECT doc_id, signal, words, signal <> 'strong' AND (media OR kind = 'video') AS needs_media, true AS usable FROM s"""),
    Query("coverage_label", coverage_label, f"WITH {_ENVELOPES} SELECT doc_id, CASE WHEN kind <> 'video' THEN 'text' WHEN coalesce(transcript, '') <> '' AND visual IS NOT NULL THEN 'video + audio' WHEN visual IS NOT NULL THEN 'video' WHEN coalesce(transcript, '') <> '' THEN 'transcript only' ELSE 'caption only' END AS coverage, kind = 'video' AND visual IS NULL AS can_deepen FROM e"),
    Query("present_items", present_items, "SELECT doc_id, lang || '|' || source AS items FROM documents"),
    Query("excerpt", excerpt, f"SELECT doc_id, CASE WHEN length({_SQUEEZED}) <= 220 THEN {_SQUEEZED} ELSE rtrim(left({_SQUEEZED}, 217)) || '...' END AS excerpt FROM documents"),
    Query("clip", clip, f"SELECT doc_id, {_CLIP(_SQUEEZED, 140)} AS clip FROM documents"),
    Query("trim_document", trim_document, """
        WITH h AS (SELECT doc_id, text, left(text, 1500) AS w, reverse(left(text, 1500)) AS r FROM documents),
        c AS (SELECT *, CASE WHEN strpos(r, chr(10) || chr(10)) > 0 THEN length(w) - strpos(r, chr(10) || chr(10)) - 1 ELSE -1 END AS c1, CASE WHEN strpos(r, ' .') > 0 THEN length(w) - strpos(r, ' .') - 1 ELSE -1 END AS c2,
                     CASE WHEN strpos(r, chr(10)) > 0 THEN length(w) - strpos(r, chr(10)) ELSE -1 END AS c3, CASE WHEN strpos(r, ' ') > 0 THEN length(w) - strpos(r, ' ') ELSE -1 END AS c4 FROM h)
        SELECT doc_id, sha256(CASE WHEN length(text) <= 1500 THEN text ELSE rtrim(CASE WHEN c1 > 900 THEN left(w, c1) WHEN c2 > 900 THEN left(w, c2) WHEN c3 > 900 THEN left(w, c3) WHEN c4 > 900 THEN left(w, c4) ELSE w END, ' ' || chr(10) || chr(9)) || chr(10) || '[...truncated]' END) AS trimmed FROM c"""),
    Query("clean_text", clean_text, "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{00A0}]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned FROM documents"),
    Query("line_fold", line_fold),
    Query("redact", redact, "SELECT page_id, left(regexp_replace(url, '([?&][^=\\s&]+)=([^&\\s]+)', '\\1=<redacted>', 'g'), 500) AS url FROM pages"),
    Query("hashtags", hashtags, r"""
        WITH t AS (SELECT doc_id, list_sort(list_distinct([lower(x) FOR x IN regexp_extract_all('#Git #git #x ' || regexp_replace(text, ' (\w{5})', ' #\1', 'g'), '#([A-Za-z0-9_]{2,60})', 1)])) AS l FROM documents)
        SELECT doc_id, len(l)::INTEGER AS tags, sha256(array_to_string(l, ',')) AS tag_hash FROM t"""),
    Query("term_scores", term_scores, f"""
        WITH {_CUED}, s AS (SELECT doc_id, {_TOKS('text')} AS t, {_TOKS('title')} AS h FROM c),
        b AS (SELECT doc_id, unnest([t[i] || '-' || t[i + 1] FOR i IN range(1, len(t)) IF t[i] <> t[i + 1]]) AS term, unnest([i FOR i IN range(1, len(t)) IF t[i] <> t[i + 1]]) AS pos FROM s),
        r AS (SELECT doc_id, unnest(t) AS term, 1 AS w, unnest(range(len(t))) AS pos FROM s UNION ALL SELECT doc_id, unnest(h), 4, 1000000 + unnest(range(len(h))) FROM s
              UNION ALL SELECT doc_id, term, count(*) * 3, 2000000 + min(pos) FROM b GROUP BY 1, 2 HAVING count(*) >= 2),
        g AS (SELECT doc_id, term, sum(w)::BIGINT AS score, min(pos) AS pos FROM r GROUP BY 1, 2)
        SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS position FROM g QUALIFY position <= 5"""),
    Query("bigrams", bigrams, f"""
        WITH s AS (SELECT doc_id, {_TOKS('text')} AS t FROM documents), b AS (SELECT doc_id, unnest([t[i] || '-' || t[i + 1] FOR i IN range(1, len(t)) IF t[i] <> t[i + 1]]) AS bigram FROM s)
        SELECT doc_id, bigram, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 2"""),
    Query("category_vote", category_vote, f"""
        WITH {_CUED}, s AS (SELECT doc_id, {_TOKS('text')} AS t FROM c), v AS (SELECT doc_id, [{', '.join(f"len([x FOR x IN t IF x IN ({quoted(c)})])" for c in H.CATEGORY_CUES.values())}] AS n FROM s)
        SELECT doc_id, CASE WHEN list_max(n) < 2 THEN 'other' ELSE [{quoted(H.CATEGORY_CUES)}][list_position(n, list_max(n))] END AS category FROM v"""),
    Query("content_type_vote", content_type_vote, f"""
        WITH {_CUED}, l AS (SELECT doc_id, lower(typed) AS t FROM c)
        SELECT doc_id, CASE {' '.join(f"WHEN {' + '.join(f'contains(t, {quoted([w])})::INT' for w in words)} >= 2 THEN '{name}'" for name, words in H.TYPE_CUES.items())}
               WHEN doc_id % 2 = 0 THEN 'article' ELSE 'other' END AS content_type FROM l"""),
    Query("heuristic_summary", heuristic_summary, f"""
        WITH a AS (SELECT doc_id, text, trim({_SENTENCES.format("trim(string_split(text, chr(10))[1], ' ' || chr(10))")}[1]) AS h, regexp_replace({_SENTENCES.format("regexp_replace(text, '^\\s+|\\s+$', '', 'g')")}[1], '\\s+$', '') AS f,
                          [x FOR x IN [regexp_replace(y, '^\\s+|\\s+$', '', 'g') FOR y IN {_SENTENCES.format('text')}] IF length(x) > 20] AS long FROM documents),
        b AS (SELECT doc_id, trim(regexp_replace(h, '\\s+', ' ', 'g')) AS h1, length(h) AS hn, trim(regexp_replace(f, '\\s+', ' ', 'g')) AS f1, length(f) AS fn, {_SQUEEZED} AS raw, len(long) AS n, trim(regexp_replace(array_to_string(long[1:3], ' '), '\\s+', ' ', 'g')) AS l1 FROM a)
        SELECT doc_id, CASE WHEN hn > 12 THEN {_CLIP('h1', 140)} WHEN fn > 12 THEN {_CLIP('f1', 140)} ELSE 'No description available' END AS summary, sha256(CASE WHEN n > 0 THEN {_CLIP('l1', 400)} ELSE {_CLIP('raw', 300)} END) AS description FROM b"""),
    Query("entities", entities),
    Query("sentence_dedup", sentence_dedup, f"""
        WITH l AS (SELECT doc_id, {_SENTENCES.format("(text || ' ' || text)")} AS l FROM documents), s AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS s FROM l),
        n AS (SELECT *, lower(regexp_replace(regexp_replace(s, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS n FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN length(n) >= 25 THEN n ELSE '#' || pos END ORDER BY pos) AS r FROM n)
        SELECT doc_id, sha256(string_agg(s, ' ' ORDER BY pos)) AS kept FROM r WHERE r = 1 GROUP BY doc_id"""),
    Query("keyword_fields", keyword_fields, """
        SELECT doc_id, string_split(text, chr(10))[1] AS title, CASE WHEN lang <> 'en' THEN 'sum' ELSE '' END AS summary, '' AS description, CASE WHEN lang <> 'en' THEN lang || ' ' || source ELSE 'p' END AS tags,
               CASE WHEN lang <> 'en' THEN 'A B C me' ELSE 'me' END AS entities, CASE WHEN lang <> 'en' THEN 'd1; d2 cap vis' ELSE 'cap vis' END AS body FROM documents"""),
    Query("chunk_split", chunk_split),
    Query("chunk_counts", chunk_counts, "SELECT doc_id, 'digest' AS kind, 1 AS chunks, 0 AS last FROM documents UNION ALL SELECT doc_id, 'detail', 1, 1 FROM documents"),
    Query("chunk_digest", chunk_digest, """
        SELECT doc_id, sha256(CASE WHEN string_split(text, chr(10))[1] <> '' THEN 'title: ' || string_split(text, chr(10))[1] || chr(10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'summary: sum' || chr(10) ELSE '' END || 'tags: ' || lang || ', ' || source || chr(10) || 'category: other; type: other' || chr(10) || 'source: web'
            || CASE WHEN doc_id % 2 = 1 AND text <> '' THEN chr(10) || 'caption: ' || left(text, 500) ELSE '' END) AS digest FROM documents"""),
    Query("source_fingerprint", source_fingerprint, "SELECT doc_id, sha256('model@64' || chr(9247) || text || chr(9247) || lang || chr(9247) || source || chr(9247)) AS source_hash FROM documents"),
]
