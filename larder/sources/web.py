"""The web source: what several free sources say of one address, merged into one record.

A row has an address and whatever bodies there are for it: a listing's JSON, a feed, an oEmbed answer, an embed
page, the page itself.  Fetching is not done here.  Of each column the first source that fills it counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.envelope import is_usable
from larder.functions.text import hashtags, iso_duration, to_timestamp
from larder.operators import html as HT
from larder.operators.merge import first_filled
from larder.sources import payloads as P

#: The bodies that a row may have, each a text column.
BODIES = ["reddit_json", "feed_xml", "oembed_json", "embed_html", "html"]
COLUMNS = [
    "title", "author", "author_url", "caption", "thumbnail_url", "media_url", "media_kind", "duration_s", "published_at",
    "platform_tags", "like_count", "view_count", "comment_count", "article_text",
]


def with_bodies(pages: DataFrame) -> DataFrame:
    """pages with a null column for every kind of body that it lacks."""
    return pages.withColumns({c: F.lit(None).cast("string") for c in BODIES if c not in pages.columns})


def html_records(pages: DataFrame, key: str, url: str = "canonical_url", whole_references: bool = False) -> DataFrame:
    """Records of pages(key, url, html) that are no wall; tags are those of the caption and the title."""
    parsed = HT.parse_pages(pages, key, url, whole_references=whole_references)
    raw = pages.select(key, F.col("html").alias("_html"))
    open_pages = parsed.join(raw, key).filter(~HT.is_block_page(F.col("title"), F.col("_html"))).drop("_html")
    tags = F.array_distinct(F.concat(hashtags(F.col("caption")), hashtags(F.col("title"))))
    return open_pages.withColumns({"duration_s": iso_duration(F.col("duration")), "published_at": to_timestamp(F.col("published")), "platform_tags": tags})


def feed_records(pages: DataFrame, key: str, url: str = "canonical_url") -> DataFrame:
    """Records of posts that their feed (feed_xml) still has; the text is the post's own body, a fragment without a frame."""
    items = P.rss_items(pages.select(key, "feed_xml"), key, "feed_xml")
    posts = P.match_feed(pages.select(key, url), items, key, url)
    image = F.nullif(F.regexp_extract("html", r"(?i)<img[^>]+src=[\"']([^\"']+)", 1), F.lit(""))
    posts = posts.withColumn("thumbnail_url", image)
    text = HT.parse_fragments(posts, key, "html")
    return posts.drop("html").join(text, key, "left")


def media_kind(marked: Column | None = None) -> Column:
    """What the filled columns and the site say an item is; marked: whether its page marks up an article, however short."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    moving = some("media_url") | (F.coalesce("duration_s", F.lit(0.0)) != 0) | F.col("platform").isin("instagram", "tiktok", "youtube")
    return F.when(moving, "video").when(some("article_text") | (F.lit(False) if marked is None else marked), "article").when(some("thumbnail_url"), "image").otherwise("unknown")


def web_records(pages: DataFrame, key: str = "url_hash", whole_references: bool = False) -> DataFrame:
    """key, the record's columns and extractor_note of rows (key, canonical_url, platform and any of BODIES) that say something.

    Sources in the order of their word: listing, feed, oEmbed, embed page, page.  One shuffle puts them together.
    whole_references: as in html.parse_pages.
    """
    rows = with_bodies(pages)
    some = lambda c: rows.filter(F.coalesce(F.col(c), F.lit("")) != "")
    frames = [
        ("reddit .json", P.reddit(some("reddit_json").filter("platform = 'reddit'"), key, "reddit_json").filter("title IS NOT NULL OR article_text IS NOT NULL")),
        ("medium rss", feed_records(some("feed_xml"), key)),
        ("oembed", P.oembed(some("oembed_json"), key, "oembed_json").filter(F.coalesce("title", "author", "author_url", "thumbnail_url", "caption").isNotNull())),
        ("instagram embed", P.instagram_embed(some("embed_html").filter("platform = 'instagram'"), key, "embed_html")),
        ("og/html", html_records(some("html"), key, whole_references=whole_references)),
    ]
    out = first_filled(frames, key, [*COLUMNS, "marked_article"], {"media_kind": "unknown"}).join(rows.select(key, "platform"), key)
    for c in ("visual_description", "ocr_text", "transcript"):
        out = out.withColumn(c, F.lit(None).cast("string"))
    out = out.filter(is_usable()).withColumn("media_kind", F.coalesce("media_kind", media_kind(F.coalesce("marked_article", F.lit(False)))))
    return out.select(key, *COLUMNS, F.col("notes").alias("extractor_note"))
