"""Derived columns of an envelope: text parts, word counts, signal, coverage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import strip, word_count

#: Label of each part of the searchable text, and the column it comes from.
PARTS = [("title", "title"), ("author", "author"), ("caption", "caption"), ("tags", "platform_tags"), ("visual", "visual_description"), ("onscreen", "ocr_text"), ("transcript", "transcript"), ("article", "article_text")]


def text_parts() -> Column:
    """array<struct<label, value>> of the filled parts, in order."""
    value = lambda c: F.coalesce(F.array_join(c, " ") if c == "platform_tags" else F.col(c), F.lit(""))
    parts = F.array(*[F.struct(F.lit(label).alias("label"), strip(value(c)).alias("value")) for label, c in PARTS])
    return F.filter(parts, lambda p: p["value"] != "")


def search_document() -> Column:
    """The parts as labelled lines."""
    return F.array_join(F.transform(text_parts(), lambda p: F.concat(p["label"], F.lit(": "), p["value"])), "\n")


def words_in_parts() -> Column:
    return F.aggregate(F.transform(text_parts(), lambda p: word_count(p["value"])), F.lit(0).cast("bigint"), lambda a, b: a + b)


def prose_words() -> Column:
    """Words outside the tags, hash tags not counted."""
    prose = F.filter(text_parts(), lambda p: p["label"] != "tags")
    counts = F.transform(prose, lambda p: word_count(F.regexp_replace(p["value"], r"(?U)#\w+", " ")))
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _has(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def has_audio() -> Column:
    return _has("transcript")


def has_visual() -> Column:
    return _has("visual_description") | _has("ocr_text")


def signal() -> Column:
    """strong, weak or none: how much the text of an item says."""
    words = prose_words()
    body = _has("transcript") | _has("article_text") | has_visual()
    unseen = (F.col("media_kind") == "video") & ~(has_audio() | has_visual())
    strong = ~unseen & ((body & (words >= 40)) | (words >= 60))
    return F.when(strong, F.lit("strong")).when((body & (words >= 8)) | (words >= 5), F.lit("weak")).otherwise(F.lit("none"))


def needs_media() -> Column:
    return (F.col("signal") != "strong") & (_has("media_url") | (F.col("media_kind") == "video"))


def is_usable() -> Column:
    return (F.size(text_parts()) > 0) | _has("thumbnail_url") | _has("media_url")


def coverage() -> Column:
    """What of an item was examined, in words."""
    return (
        F.when(F.col("media_kind") != "video", F.lit("text"))
        .when(has_audio() & has_visual(), F.lit("video + audio"))
        .when(has_visual(), F.lit("video"))
        .when(has_audio(), F.lit("transcript only"))
        .otherwise(F.lit("caption only"))
    )


def can_deepen() -> Column:
    return (F.col("media_kind") == "video") & ~has_visual()


def found_by(keyword_rank: Column, vector_rank: Column) -> Column:
    return F.when(keyword_rank.isNotNull() & vector_rank.isNotNull(), F.lit("both")).when(keyword_rank.isNotNull(), F.lit("keyword")).when(vector_rank.isNotNull(), F.lit("vector")).otherwise(F.lit("none"))


def media_kind_of(video: Column, image: Column, declared: Column) -> Column:
    """A declared kind that is known, else what the filled addresses say."""
    d = F.lower(F.coalesce(declared, F.lit("")))
    return F.when(d.isin("video", "image", "article", "carousel", "audio"), d).when(F.coalesce(video, F.lit("")) != "", F.lit("video")).when(F.coalesce(image, F.lit("")) != "", F.lit("image")).otherwise(F.lit("unknown"))
