"""Around model calls: prompts, answers, payload gates, addresses, redaction, retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import pricing, tags
from larder.functions.text import filled, squeeze

ANSWER = "struct<summary:string,description:string,details:array<string>,tags:array<string>,category:string,content_type:string,people:array<string>,organizations:array<string>,places:array<string>,products:array<string>,language:string>"


def answer(body: Column, platform_tags: Column) -> Column:
    """A model's JSON answer as an enrichment struct, capped; null where it is no JSON object."""
    a = F.from_json(body, ANSWER)
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    details = F.slice(F.filter(F.transform(some(a["details"]), squeeze), lambda d: d != ""), 1, 30)
    people = F.struct(*[F.slice(some(a[k]), 1, n).alias(k) for k, n in (("people", 8), ("organizations", 8), ("places", 8), ("products", 10))])
    whole = F.coalesce(F.get_json_object(body, "$").startswith("{"), F.lit(False))
    return F.when(whole, F.struct(
        squeeze(F.coalesce(a["summary"], F.lit(""))).alias("summary"), squeeze(F.coalesce(a["description"], F.lit(""))).alias("description"), details.alias("details"),
        tags.normalize(F.concat(some(a["tags"]), some(platform_tags)), 15).alias("tags"), tags.category(a["category"]).alias("category"), tags.content_type(a["content_type"]).alias("content_type"),
        people.alias("entities"), filled(a["language"]).alias("language"),
    ))


def answer_text(response: Column) -> Column:
    """All text parts of a response's first candidate, joined."""
    parts = F.from_json(F.get_json_object(response, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    return F.trim(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))


def finish_reason(response: Column) -> Column:
    at = lambda p: F.get_json_object(response, p)
    some = at("$.candidates[0]").isNotNull()
    return F.when(some, F.coalesce(filled(at("$.candidates[0].finishReason")), F.lit("unknown"))).otherwise(F.coalesce(F.concat(F.lit("blocked: "), filled(at("$.promptFeedback.blockReason"))), F.lit("no candidates")))


def text_prompt(document: Column, platform: Column, url: Column) -> Column:
    """A request to index a link from its text."""
    return F.format_string("Index this saved link.\n\nPlatform: %s\nURL: %s\n\nContent at hand:\n----\n%s\n----\n\nAnswer with the JSON object.", platform, url, document)


def media_prompt(document: Column, platform: Column, url: Column, duration_s: Column) -> Column:
    """A request to index a link whose media is attached, with its length and whatever text there is."""
    length = F.when(F.coalesce(duration_s, F.lit(0.0)) != 0, F.format_string("%.0f seconds", duration_s)).otherwise(F.lit("unknown length"))
    text = F.when(F.trim(document) != "", F.format_string("Text at hand (it may be incomplete):\n----\n%s\n----\n\n", document)).otherwise(F.lit("There is no text for this item.\n\n"))
    return F.format_string("Index this saved link. Its media is attached.\n\nPlatform: %s\nURL: %s\nLength: %s\n\n%sDescribe all that is seen and heard, then answer with the JSON object.", platform, url, length, text)


def analyzed_seconds(duration_s: Column, limit: float) -> Column:
    """Seconds of a video that are sent: an unknown length counts as the limit, no limit (0) as all."""
    d = F.coalesce(duration_s, F.lit(0.0))
    return F.when(d <= 0, F.lit(max(limit, 0.0))).otherwise(F.least(d, F.lit(limit)) if limit > 0 else d)


def clip_end(duration_s: Column, limit: float) -> Column:
    """Where to cut a video, null where all of it fits."""
    d = F.coalesce(duration_s, F.lit(0.0))
    return F.when(F.lit(limit > 0) & ~((d > 0) & (d <= limit)), F.lit(int(limit)))


def preflight_cost(duration_s: Column, limit: float, model: str, fallback: str | None = None, high: bool = False) -> Column:
    """Predicted dollars of a media call over what is sent; an unpriced model is priced as its fallback."""
    name = F.when(pricing.is_priced(F.lit(model)), F.lit(model)).otherwise(F.lit(fallback or model))
    return pricing.video_cost(analyzed_seconds(duration_s, limit), name, high)


def media_is_fetchable(url: Column, media_url: Column) -> Column:
    """Whether a model can see the item: a file's address, or a site that the model reads itself."""
    return F.lower(F.coalesce(url, F.lit(""))).rlike("youtube[.]com|youtu[.]be") | (F.coalesce(media_url, F.lit("")) != "")


def youtube_uri(url: Column) -> Column:
    """The documented watch address of a video."""
    q = F.regexp_extract(url, r"[?&]v=([^&#]+)", 1)
    last = F.element_at(F.split(F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", ""), "/"), -1)
    video = F.when(q != "", q).otherwise(last)
    return F.when(video != "", F.concat(F.lit("https://www.youtube.com/watch?v="), video)).otherwise(url)


def has_substance(*fields: Column) -> Column:
    """Whether a client sent content and not just a label: any of the fields has text."""
    out = F.lit(False)
    for f in fields:
        out = out | (F.trim(F.coalesce(f, F.lit(""))) != "")
    return out


def redact_keys(text: Column, key: str | None = None) -> Column:
    """Text without what looks like an API key, and without the given key."""
    out = F.regexp_replace(text, r"\b(?:AIza[0-9A-Za-z_\-]{10,}|AQ\.[0-9A-Za-z_\-]{10,})", "AIza...REDACTED")
    return F.replace(out, F.lit(key), F.lit("...REDACTED")) if key and len(key) > 6 else out


def retry_after(header: Column) -> Column:
    """Seconds that a server asks for, between 1 and 120; null where it is no number."""
    n = F.nullif(header, F.lit("")).try_cast("double")
    return F.when(n.isNotNull(), F.greatest(F.lit(1.0), F.least(n, F.lit(120.0))))


def quota_violation(body: Column) -> Column:
    """What a refused call's body says of the quota that it broke: a message that names the period, else quota and limit."""
    at = lambda p: F.get_json_object(body, p)
    message = at("$.error.message")
    named = F.when(message.contains("per-min") | message.contains("per-day"), F.substring(message, 1, 120))
    kind = "array<struct<`@type`:string,violations:array<struct<quotaId:string,quotaMetric:string,quotaValue:string>>>>"
    details = F.filter(F.from_json(at("$.error.details"), kind), lambda x: F.coalesce(x["@type"], F.lit("")).contains("QuotaFailure"))
    broken = F.flatten(F.transform(details, lambda x: F.coalesce(x["violations"], F.array().cast("array<struct<quotaId:string,quotaMetric:string,quotaValue:string>>"))))
    limit = lambda v: F.when(F.coalesce(v["quotaValue"], F.lit("")) != "", F.concat(F.lit(" (limit "), v["quotaValue"], F.lit(")"))).otherwise("")
    told = F.transform(broken, lambda v: F.concat(F.coalesce(F.nullif(v["quotaId"], F.lit("")), F.nullif(v["quotaMetric"], F.lit(""))), limit(v)))
    return F.coalesce(named, F.get(F.filter(told, lambda t: t.isNotNull()), F.lit(0)))
