"""Payload sources: JSON and feed bodies as columns, read into candidate records.

Each function takes a table with a key and a body and gives key and the record's columns; all but the
nested flattening are expressions of the JVM.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import clean_text, echoes_title, filled, hashtags, iso_duration, to_double, to_long, to_str, to_tags, to_timestamp
from larder.operators.merge import fold_repeats

# Names that a flat payload may use for each field, in order of preference ----
ALIASES = {
    "title": "title name headline og_title public.plain-text".split(),
    "caption": "caption description text body snippet summary og_description public.text sharedtext message".split(),
    "author": "author username handle owner creator channel uploader".split(),
    "author_url": "author_url profile_url channel_url uploader_url".split(),
    "thumbnail_url": "thumbnail_url thumbnail image poster preview cover".split(),
    "media_url": "media_url video_url videourl url_media stream_url".split(),
    "transcript": "transcript captions subtitles speech audio_text".split(),
    "ocr_text": "ocr_text ocr onscreen_text screen_text visiontext".split(),
    "article_text": "article_text content article readable_text maintext".split(),
    "visual_description": "visual_description visual scene_description".split(),
    "duration_s": "duration_s duration length".split(),
    "published_at": "published_at timestamp taken_at created_at date".split(),
    "like_count": "like_count likes favorite_count".split(),
    "view_count": "view_count views play_count".split(),
    "comment_count": "comment_count comments".split(),
    "platform_tags": "platform_tags tags hashtags keywords".split(),
}
#: The page itself, as a client rendered it.
HTML_NAMES = "html dom document outerhtml".split()
#: Names that a scraping service may use, in order of preference.
MANAGED_ALIASES = {
    "title": "title name headline".split(),
    "caption": "caption description text edge_media_to_caption post_text".split(),
    "author": "author username owner_username uploader channel user_name".split(),
    "author_url": "author_url profile_url user_url channel_url".split(),
    "thumbnail_url": "thumbnail_url thumbnail display_url image_url cover cover_url".split(),
    "media_url": "media_url video_url play_url download_url src url".split(),
    "transcript": "transcript captions_text subtitles_text audio_transcript".split(),
    "ocr_text": "ocr_text ocr text_in_image onscreen_text".split(),
    "article_text": "article_text content body main_text markdown".split(),
    "like_count": "like_count likes likes_count edge_liked_by".split(),
    "view_count": "view_count views play_count video_view_count".split(),
    "comment_count": "comment_count comments comments_count".split(),
    "duration_s": "duration_s duration video_duration length".split(),
    "published_at": "published_at taken_at_timestamp timestamp created_at date".split(),
    "platform_tags": "platform_tags hashtags tags keywords".split(),
}
SUBTITLE_LANGUAGES = ["en", "en-US", "en-GB", "en-orig"]
SUBTITLE_FORMATS = ["json3", "vtt", "srv1", "ttml"]
MANIFESTS = ["m3u8", "m3u8_native", "http_dash_segments"]
# -----------------------------------------------------------------------------------------


def pick(payload: Column, *names: str) -> Column:
    """First non-empty value among names of a map<string,string>, whatever the case of its keys."""
    def find(name):
        same = F.filter(F.map_entries(payload), lambda e: (F.lower(e["key"]) == name.lower()) & ~F.coalesce(e["value"], F.lit("")).isin("", "[]", "{}"))
        return F.get(same, F.lit(0))["value"]

    return F.coalesce(*[find(n) for n in names])


def client_payload(df: DataFrame, key: str, payload: str, platform: str = "platform") -> DataFrame:
    """Flat client payloads, JSON text in any of the known spellings, as records."""
    m = F.from_json(F.col(payload), "map<string,string>")
    out = df.select(key, platform, m.alias("_m"))
    text = {f: to_str(pick(F.col("_m"), *ALIASES[f])) for f in ("title", "caption", "author", "author_url", "thumbnail_url", "media_url", "transcript", "ocr_text", "article_text", "visual_description")}
    out = out.withColumns({
        **text, "duration_s": F.nullif(to_double(pick(F.col("_m"), *ALIASES["duration_s"])), F.lit(0.0)), "published_at": to_timestamp(pick(F.col("_m"), *ALIASES["published_at"])),
        **{c: to_long(pick(F.col("_m"), *ALIASES[c])) for c in ("like_count", "view_count", "comment_count")},
        "_tags": F.regexp_replace(pick(F.col("_m"), *ALIASES["platform_tags"]), r'[\[\]"]', " "),
    })
    out = out.withColumn("platform_tags", F.array_distinct(F.concat(to_tags(F.col("_tags")), hashtags(F.col("caption")))))
    return out.withColumn("media_kind", kind_of_client(F.col(platform))).drop("_m", "_tags")


def client_records(df: DataFrame, key: str, payload: str, platform: str = "platform", url: str = "canonical_url") -> DataFrame:
    """Records of client payloads in any shape: a full envelope, the rendered page, flat fields.

    A full envelope is taken as it is; of the other two the flat fields win over what the page says.  The identity of a
    row is never the client's.
    """
    from larder.operators import html as HT

    own = df.select(key, platform, url, payload)
    flat = client_payload(own, key, payload, platform).drop(platform)
    names = [c for c in flat.columns if c not in (key, "media_kind")]
    m = F.from_json(F.col(payload), "map<string,string>")
    dom = own.select(key, url, to_str(pick(m, *HTML_NAMES)).alias("html")).filter("html IS NOT NULL")
    parsed = HT.parse_pages(dom, key, url).withColumns({"duration_s": iso_duration(F.col("duration")), "published_at": to_timestamp(F.col("published"))})
    from_page = ["title", "caption", "author", "thumbnail_url", "media_url", "duration_s", "published_at", "article_text"]
    parsed = parsed.select(key, *[F.col(c).alias(f"_page_{c}") for c in from_page], "marked_article", F.lit(True).alias("_page"))
    kinds = dict(flat.dtypes)
    envelope = F.from_json(F.get_json_object(payload, "$.envelope"), ", ".join(f"{c} {kinds[c]}" for c in [*names, "media_kind"]))
    out = own.join(flat, key).join(parsed, key, "left").withColumn("_e", envelope)
    whole = F.col("_e").isNotNull()
    merged = {c: F.coalesce(F.col(c), F.col(f"_page_{c}")) if c in from_page else F.col(c) for c in names}
    merged["platform_tags"] = F.array_distinct(F.concat(F.coalesce("platform_tags", F.array()), hashtags(F.coalesce("caption", "_page_caption"))))
    out = out.withColumns({f"_new_{c}": F.when(whole, F.col(f"_e.{c}")).otherwise(v) for c, v in merged.items()})
    out = out.select(key, platform, whole.alias("_whole"), F.col("_e.media_kind").alias("_kind"), "_page", "marked_article", *[F.col(f"_new_{c}").alias(c) for c in names])
    note = F.when(F.col("_whole"), "client-supplied envelope").otherwise(F.concat(F.lit("client payload"), F.when(F.col("_page"), " + parsed DOM").otherwise("")))
    kind = F.when(F.col("_whole"), F.coalesce("_kind", F.lit("unknown"))).otherwise(kind_of_client(F.col(platform), F.coalesce("marked_article", F.lit(False))))
    return out.withColumns({"media_kind": kind, "extractor_note": note}).drop("_whole", "_kind", "_page", "marked_article", platform)


def managed_records(df: DataFrame, key: str, body: str, platform: str = "platform") -> DataFrame:
    """Records of a scraping service's nested answers, flattened and read by the names such services use."""
    flat = df.select(key, platform).join(flatten_json(df, key, body), key).filter(F.size("flat") > 0)
    get = lambda f: pick(F.col("flat"), *MANAGED_ALIASES[f])
    texts = ["title", "caption", "author", "author_url", "thumbnail_url", "media_url", "transcript", "ocr_text", "article_text"]
    out = flat.withColumns({
        **{c: clean_text(to_str(get(c))) for c in texts}, **{c: to_long(get(c)) for c in ("like_count", "view_count", "comment_count")},
        "duration_s": F.nullif(to_double(get("duration_s")), F.lit(0.0)), "published_at": to_timestamp(get("published_at")), "_tags": F.regexp_replace(get("platform_tags"), r'[\[\]"]', " "),
    })
    tags = F.array_distinct(F.concat(to_tags(F.col("_tags")), hashtags(F.col("caption"))))
    kind = F.when(F.col(platform).isin("instagram", "tiktok", "youtube"), "video").otherwise("unknown")
    return out.withColumns({"platform_tags": tags, "media_kind": kind, "extractor_note": F.lit("managed api")}).drop("flat", "_tags", platform)


def kind_of_client(platform: Column, marked: Column | None = None) -> Column:
    """What the filled columns and the site say an item is; marked: whether its page marks up an article, however short."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.when(some("media_url") | some("transcript") | platform.isin("instagram", "tiktok", "youtube"), "video").when(some("article_text") | (F.lit(False) if marked is None else marked), "article").when(some("thumbnail_url"), "image").otherwise("unknown")


def _at(body: Column, path: str) -> Column:
    return filled(F.get_json_object(body, path))


def oembed(df: DataFrame, key: str, body: str, platform: str = "platform") -> DataFrame:
    """oEmbed answers; for X and Reddit the caption is the text of the quoted block."""
    b = F.col(body)
    quote = F.regexp_extract(F.get_json_object(b, "$.html"), r"(?is)<blockquote[^>]*>(.*?)</blockquote>", 1)
    text = clean_text(F.regexp_replace(F.regexp_replace(quote, "<[^>]+>", " "), r"\s+", " "))
    return df.select(key, clean_text(_at(b, "$.title")).alias("title"), _at(b, "$.author_name").alias("author"), _at(b, "$.author_url").alias("author_url"), _at(b, "$.thumbnail_url").alias("thumbnail_url"), F.when(F.col(platform).isin("twitter", "reddit"), text).alias("caption"))


def reddit(df: DataFrame, key: str, body: str, comments: int = 5) -> DataFrame:
    """A post's listing and its comments' listing; the text is the post's and its first comments'."""
    b, post = F.col(body), "$[0].data.children[0].data"
    at = lambda name: _at(b, f"{post}.{name}")
    listed = F.from_json(F.get_json_object(b, "$[1].data.children"), "array<struct<kind:string,data:struct<body:string>>>")
    said = F.filter(F.transform(F.filter(listed, lambda c: c["kind"] == "t1"), lambda c: clean_text(c["data"]["body"])), lambda t: t.isNotNull() & ~t.isin("[deleted]", "[removed]"))
    said = F.transform(F.slice(said, 1, comments), lambda t: F.concat(F.lit("- "), F.substring(t, 1, 600)))
    own = clean_text(at("selftext"))
    talk = F.when(F.size(said) > 0, F.concat(F.lit("Top comments:\n"), F.array_join(said, "\n")))
    video = F.coalesce(at("is_video") == "true", F.lit(False))
    thumb = F.when(~at("thumbnail").isin("self", "default", "nsfw", "spoiler", "image"), at("thumbnail"))
    return df.select(
        key, clean_text(at("title")).alias("title"), at("author").alias("author"), F.concat(F.lit("https://www.reddit.com/user/"), at("author")).alias("author_url"),
        F.substring(own, 1, 500).alias("caption"), filled(F.concat_ws("\n\n", own, talk)).alias("article_text"), F.coalesce(thumb, at("preview.images[0].source.url")).alias("thumbnail_url"),
        F.timestamp_seconds(F.floor(to_double(at("created_utc")))).alias("published_at"), to_long(at("ups")).alias("like_count"), to_long(at("num_comments")).alias("comment_count"),
        F.array_distinct(F.concat(to_tags(at("subreddit")), to_tags(at("link_flair_text")))).alias("platform_tags"), F.when(video, "video").otherwise("text").alias("media_kind"),
        F.coalesce(F.when(video, at("media.reddit_video.fallback_url")), at("url_overridden_by_dest")).alias("media_url"), F.when(video, to_double(at("media.reddit_video.duration"))).alias("duration_s"),
    )


def instagram_embed(df: DataFrame, key: str, html: str) -> DataFrame:
    """The record in an embed page's script: JSON in a JSON string."""
    literal = F.regexp_extract(F.col(html), r'"contextJSON"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    inner = F.get(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), F.lit(0))
    out = df.select(key, inner.alias("_j")).withColumn("_m", F.get_json_object("_j", "$.gql_data.shortcode_media")).filter("_m IS NOT NULL")
    at = lambda path: _at(F.col("_m"), f"$.{path}")
    caption, user = clean_text(at("edge_media_to_caption.edges[0].node.text")), at("owner.username")
    return out.select(
        key, F.concat(user, F.lit(" on Instagram")).alias("title"), caption.alias("caption"), user.alias("author"), F.concat(F.lit("https://www.instagram.com/"), user, F.lit("/")).alias("author_url"),
        F.coalesce(at("display_url"), at("thumbnail_src")).alias("thumbnail_url"), at("video_url").alias("media_url"), to_double(at("video_duration")).alias("duration_s"), hashtags(caption).alias("platform_tags"),
        to_long(at("edge_liked_by.count")).alias("like_count"), to_long(at("video_view_count")).alias("view_count"), to_long(at("edge_media_to_comment.count")).alias("comment_count"),
        F.when(at("is_video") == "true", "video").otherwise("image").alias("media_kind"),
    )


def rss_items(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, item, guid, link, title, author, published_at, html, platform_tags) of each feed's items."""
    # plain pattern matching: a feed's prefixes are fixed, and a malformed item costs that item alone
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    out = df.select(key, F.posexplode(items).alias("item", "_x"))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"), "&amp;", "&")
    tag = lambda t: filled(bare(F.regexp_extract("_x", rf"(?s)<{t}(?:\s[^>]*)?>(.*?)</{t}>", 1)))
    labels = F.transform(F.regexp_extract_all("_x", F.lit(r"(?s)<category[^>]*>(.*?)</category>"), F.lit(1)), lambda c: F.lower(bare(c)))
    return out.select(key, "item", tag("guid").alias("guid"), tag("link").alias("link"), clean_text(tag("title")).alias("title"), tag("dc:creator").alias("author"), to_timestamp(tag("pubDate")).alias("published_at"), tag("content:encoded").alias("html"), F.array_distinct(labels).alias("platform_tags"))


def match_feed(posts: DataFrame, items: DataFrame, key: str, url: str) -> DataFrame:
    """The first item of its feed that is the post: by id, by path, or by its name without the id."""
    path = F.lower(F.regexp_replace(F.regexp_extract(F.col(url), r"^[^:]+://[^/]*([^?#]*)", 1), "/+$", ""))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "-[0-9a-f]{6,20}$", "")
    asked = posts.select(key, path.alias("_path"), F.regexp_extract(path, "-([0-9a-f]{8,14})$", 1).alias("_id"), name.alias("_name"))
    met = asked.join(items, key)
    hit = F.lit(False)
    for c in ("guid", "link"):
        v = F.lower(F.coalesce(F.col(c), F.lit("")))
        own = F.regexp_replace(F.regexp_extract(v, r"^[^:]+://[^/]*([^?#]*)", 1), "/+$", "")
        hit = hit | ((F.col("_id") != "") & v.contains(F.col("_id"))) | ((F.col("_path") != "") & (own == F.col("_path"))) | ((F.length("_name") > 5) & v.contains(F.col("_name")))
    met = met.filter(hit)
    return met.groupBy(key).agg(F.min_by(F.struct(*[c for c in items.columns if c != key]), "item").alias("r")).select(key, "r.*")


VIDEO = "struct<title:string,uploader:string,description:string,thumbnail:string,webpage_url:string,url:string,duration:double,fps:double,vcodec:string,upload_date:string,like_count:bigint,view_count:bigint,comment_count:bigint,tags:array<string>,formats:array<struct<url:string,protocol:string,vcodec:string,acodec:string,height:bigint,ext:string>>"
VIDEO_WITH_ENTRIES = f"{VIDEO},entries:array<{VIDEO}>>>"


def best_format(entry: Column) -> Column:
    """The playable file nearest to 540 lines, with sound if there is one, mp4 before others; never a page or a manifest."""
    page = F.coalesce(entry["webpage_url"], F.lit(""))
    some = F.coalesce(entry["formats"], F.array().cast("array<struct<url:string,protocol:string,vcodec:string,acodec:string,height:bigint,ext:string>>"))
    indexed = F.transform(some, lambda f, i: F.struct(
        (F.lit(10_000) - F.abs(F.coalesce(f["height"], F.lit(0)) - 540) + F.when(F.coalesce(f["acodec"], F.lit("none")) != "none", 20_000).otherwise(0) + F.when(F.coalesce(f["ext"], F.lit("")) == "mp4", 1_000).otherwise(0)).alias("score"),
        (-i).alias("o"), f["url"].alias("url"), (~F.coalesce(f["protocol"], F.lit("")).isin(MANIFESTS) & (F.coalesce(f["vcodec"], F.lit("none")) != "none") & (F.coalesce(f["url"], F.lit("")) != "") & (f["url"] != page)).alias("ok"),
    ))
    best = F.array_max(F.filter(indexed, lambda f: f["ok"]))["url"]
    return F.coalesce(best, F.when((entry["url"] != page) & entry["url"].contains("://"), entry["url"]))


def video_metadata(df: DataFrame, key: str, body: str) -> DataFrame:
    """Structured video metadata; of a carousel, the first entry under the filled values of the whole."""
    whole = F.from_json(F.col(body), VIDEO_WITH_ENTRIES)
    out = df.select(key, whole.alias("w")).withColumn("e", F.get(F.col("w.entries"), F.lit(0)))
    use = lambda f: F.coalesce(F.col(f"w.{f}"), F.col(f"e.{f}"))
    entry = F.struct(*[use(f).alias(f) for f in ("webpage_url", "url", "formats")])
    moving = (F.coalesce(use("duration"), F.lit(0.0)) != 0) | (F.coalesce(use("fps"), F.lit(0.0)) != 0) | (F.coalesce(use("vcodec"), F.lit("none")) != "none")
    out = out.withColumn("_f", entry)
    title, caption = clean_text(filled(use("title"))), clean_text(use("description"))
    own = F.when(F.coalesce(echoes_title(caption, title), F.lit(False)), F.lit(None)).otherwise(title)  # a title that is the caption cut off is none
    tags = F.array_distinct(F.concat(F.coalesce(F.transform(use("tags"), F.lower), F.array().cast("array<string>")), hashtags(caption), hashtags(title)))
    return out.select(
        key, own.alias("title"), filled(use("uploader")).alias("author"), caption.alias("caption"), use("thumbnail").alias("thumbnail_url"), best_format(F.col("_f")).alias("media_url"),
        use("duration").alias("duration_s"), to_timestamp(use("upload_date")).alias("published_at"), use("like_count").alias("like_count"), use("view_count").alias("view_count"),
        use("comment_count").alias("comment_count"), tags.alias("platform_tags"), F.when(moving, "video").otherwise("image").alias("media_kind"),
    )


def subtitle_choice(tracks: DataFrame, key: str) -> DataFrame:
    """tracks(key, position, language, ext, url): the one track to read, by language, then format, then order."""
    place = lambda names, c: F.when(F.array_position(F.lit(names), F.col(c)) > 0, F.array_position(F.lit(names), F.col(c)))
    language = F.coalesce(place(SUBTITLE_LANGUAGES, "language"), F.when(F.col("language").startswith("en"), F.lit(50)), F.lit(99))
    order = F.struct(language, F.col("language_position"), F.coalesce(place(SUBTITLE_FORMATS, "ext"), F.lit(99)), F.col("position"))
    usable = tracks.filter(F.col("ext").isin(SUBTITLE_FORMATS) | (F.coalesce("url", F.lit("")) != ""))
    firsts = usable.groupBy(key, "language").agg(F.min("position").alias("language_position"))
    best = usable.join(firsts, [key, "language"])
    return best.groupBy(key).agg(F.min_by(F.struct("language", "ext", "url"), order).alias("t")).select(key, "t.*")


def subtitle_text(body: Column, ext: Column) -> Column:
    """The words of a json3, VTT or SRT track, without marks, numbers and repeated lines; null up to 20 characters."""
    events = F.from_json(F.get_json_object(body, "$.events"), "array<struct<segs:array<struct<utf8:string>>>>")
    said = F.transform(events, lambda e: F.trim(F.regexp_replace(F.array_join(F.transform(e["segs"], lambda s: s["utf8"]), ""), "\n", " ")))
    lines = F.transform(F.split(body, "\r?\n"), lambda x: F.trim(x))  # a bare F.trim would take the place as its second argument
    skip = lambda x: (x == "") | (x == "WEBVTT") | x.rlike(r"^\d+$") | x.contains("-->") | x.rlike(r"^(NOTE|Kind:|Language:|STYLE)")
    plain = F.transform(F.filter(lines, lambda x: ~skip(x)), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    chosen = F.when((ext == "json3") | F.ltrim(body).startswith("{"), said).otherwise(plain)
    text = clean_text(F.array_join(fold_repeats(F.filter(chosen, lambda x: x != "")), " "))
    return F.when(F.length(text) > 20, text)


def flatten_value(value, depth: int = 6, most: int = 5) -> dict[str, str]:
    """Lower-case key -> first scalar or list of strings anywhere in a nested value, in the order they stand."""
    if depth < 0:
        return {}
    out: dict[str, str] = {}
    if isinstance(value, list):
        for item in value[:most]:
            out = {**flatten_value(item, depth - 1, most), **out}
        return out
    for k, v in value.items() if isinstance(value, dict) else ():
        texts = isinstance(v, list) and v and all(isinstance(x, str) for x in v)
        if texts or (isinstance(v, (str, int, float)) and v != ""):
            out.setdefault(str(k).lower(), json.dumps(v) if texts else str(v))
        else:
            for name, inner in flatten_value(v, depth - 1, most).items():
                out.setdefault(name, inner)
    return out


def flatten_json(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, flat map<string,string>) of nested provider answers; Arrow batches, no shuffle."""
    import pyarrow as pa

    kind = pa.map_(pa.string(), pa.string())

    def one(text):
        try:
            return list(flatten_value(json.loads(text or "null")).items())
        except ValueError:
            return []

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t) for t in batch.column(1).to_pylist()], kind)], names=["k", "flat"])

    return df.select(key, body).mapInArrow(run, f"k {dict(df.dtypes)[key]}, flat map<string,string>").withColumnRenamed("k", key)
