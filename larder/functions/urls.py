"""URL functions as Column expressions: hosts, platforms, canonical form, identity.

Everything stays in the JVM; a URL is split by patterns rather than ``parse_url``, which
raises on the malformed addresses that people save.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import let

# Fixed values -----------------------------------------------------------------------
TRACKING = """
    fbclid gclid dclid msclkid twclid ttclid yclid mc_cid mc_eid _ga _gl icid ncid cmpid campaign_id spm scm trk
    trkinfo li_fat_id guccounter igsh igshid ig_rid img_index epik is_from_webapp sender_device sender_web_id web_id
    _r _d checksum share_app_id share_item_id share_link_id tt_from source enter_from referer_url referer_video_id s t
    ref_src ref_url refsrc __twitter_impression feature ab_channel pp themerefresh embeds_referring_euri si kw app
    share_id utm_name rdt correlation_id post_fullname context chainedposts originalsubdomain trackingid lipi licu ref
    ref_source referrer share_source from hl gi""".split()
TRACKING_PREFIXES = ["utm_", "pk_", "at_", "ito_", "_hs"]
SHORTENERS = """
    bit.ly t.co tinyurl.com goo.gl ow.ly buff.ly is.gd cutt.ly rb.gy s.id shorturl.at dlvr.it trib.al lnkd.in redd.it
    vm.tiktok.com vt.tiktok.com instagr.am ig.me fb.watch amzn.to spoti.fi wa.me t.ly shrtco.de youtu.be""".split()
PLATFORM_HOSTS = {
    "instagram.com": "instagram", "instagr.am": "instagram", "youtube.com": "youtube", "youtu.be": "youtube",
    "tiktok.com": "tiktok", "twitter.com": "twitter", "x.com": "twitter", "reddit.com": "reddit", "redd.it": "reddit",
    "linkedin.com": "linkedin", "lnkd.in": "linkedin",
}
NOISE_SUBDOMAINS = ["www.", "m.", "mobile.", "amp.", "old."]
HOSTNAME = r"^(?=.{1,253}$)(?!-)[A-Za-z0-9-]{1,63}(?<!-)(?:\.(?!-)[A-Za-z0-9-]{1,63}(?<!-))*\.[A-Za-z]{2,63}$"
# ------------------------------------------------------------------------------------

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def hostname(url: Column) -> Column:
    """The host without user and port, lower-cased."""
    return F.lower(F.regexp_extract(netloc(url), r"^(?:[^@]*@)?([^:]*)", 1))


def plain_host(host: Column) -> Column:
    """A host without the noise subdomains, each taken off once, in order."""
    out = F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")
    for prefix in NOISE_SUBDOMAINS:
        out = F.regexp_replace(out, "^" + prefix.replace(".", r"\."), "")
    return out


def on_host(host: Column, *names: str) -> Column:
    """The host is one of names, or below one."""
    pattern = "|".join(n.replace(".", r"\.") for n in names)
    return host.rlike(rf"(^|\.)({pattern})$")


def platform_of_host(host: Column) -> Column:
    out = F.lit("web")
    for name in dict.fromkeys(PLATFORM_HOSTS.values()):
        out = F.when(on_host(host, *(h for h, p in PLATFORM_HOSTS.items() if p == name)), F.lit(name)).otherwise(out)
    return out


def platform(url: Column) -> Column:
    return platform_of_host(plain_host(netloc(url)))


def is_shortener(url: Column) -> Column:
    return plain_host(netloc(url)).isin(SHORTENERS) | F.lower(netloc(url)).isin(SHORTENERS)


def looks_like_url(text: Column) -> Column:
    """A plausible web address: no white space, http or https, a host name with a top-level domain."""

    def full(t):
        return F.when(F.instr(t, "://") > 0, t).otherwise(F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", "")))

    def named(host):
        return (host == "localhost") | (host.rlike(HOSTNAME) & ~host.rlike(r"^\d+\.\d+\.\d+\.\d+$"))

    def plausible(t):
        return (t != "") & ~t.rlike(r"(?U)\s") & let(full(t), lambda u: scheme(u).isin("http", "https") & let(hostname(u), named))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), plausible)


def _pairs(q: Column) -> Column:
    """The parts of a query with a name and a value."""
    return F.filter(F.split(q, "&"), lambda p: p.rlike("^[^=]*=.+"))


def _decoded(text: Column) -> Column:
    """Percent-decoding that leaves what it cannot read."""
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    """Form encoding as browsers' libraries write it: the tilde stays, the asterisk does not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def parameter(q: Column, name: str) -> Column:
    """The last non-empty value of a parameter, decoded; null if there is none."""
    found = F.filter(_pairs(q), lambda p: _decoded(F.regexp_extract(p, "^([^=]*)=", 1)) == name)
    return F.when(F.size(found) > 0, _decoded(F.regexp_replace(F.element_at(found, -1), "^[^=]*=", "")))


def clean_query(q: Column) -> Column:
    """A query without tracking parameters and empty values, sorted by name and value."""
    decoded = F.transform(_pairs(q), lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    prefixes = "|".join(TRACKING_PREFIXES)
    kept = F.filter(decoded, lambda p: ~(F.lower(p["k"]).isin(TRACKING) | F.lower(p["k"]).rlike(f"^({prefixes})")))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def unwrap(url: Column) -> Column:
    """A redirect wrapper's destination, where its query carries a plausible absolute address."""

    def target(u):
        host, p, q = u["host"], u["path"], u["query"]
        return (
            F.when(((host == "google.com") | host.startswith("google.")) & p.startswith("/url"), F.coalesce(parameter(q, "url"), parameter(q, "q")))
            .when(on_host(host, "youtube.com") & p.startswith("/redirect"), parameter(q, "q"))
            .when(on_host(host, "facebook.com", "messenger.com") & p.startswith("/l."), parameter(q, "u"))
            .when(host == "out.reddit.com", parameter(q, "url"))
        )

    found = let(parts(url), target)
    return let(found, lambda t: F.when((F.instr(t, "://") > 0) & looks_like_url(t), t).otherwise(url))


def parts(url: Column) -> Column:
    """struct<host, path, query> of a URL."""
    return F.struct(plain_host(netloc(url)).alias("host"), path(url).alias("path"), query(url).alias("query"))


def absolute(text: Column) -> Column:
    """Trimmed text with a scheme; null unless it looks like an address."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(looks_like_url(t), F.when(F.instr(t, "://") > 0, t).otherwise(F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", ""))))


def resolve(url: Column, follow: bool = True) -> Column:
    """A short video link as the full one; other shorteners are resolved by joining a table of redirects."""
    video = F.regexp_extract(path(url), "^/*([^/]+)", 1)
    short = F.lit(follow) & (plain_host(netloc(url)) == "youtu.be") & (video != "")
    return F.when(short, F.concat(F.lit("https://www.youtube.com/watch?v="), video)).otherwise(url)


def canonical(url: Column) -> Column:
    """The canonical form of an absolute, unwrapped and resolved URL: a function of its parts."""
    ig, tt, tw, rd = r"^/(?:[^/]+/)?(reels?|p|tv)/([A-Za-z0-9_-]+)", r"^/@([^/]+)/video/(\d+)", r"^/([^/]+)/status(?:es)?/(\d+)", r"^/r/([^/]+)/comments/([A-Za-z0-9]+)"
    clip, embed = r"^/shorts/([A-Za-z0-9_-]{6,})", r"^/(?:embed|v|live)/([A-Za-z0-9_-]{6,})"
    fixed_host = {"youtube": "youtube.com", "tiktok": "tiktok.com", "twitter": "x.com", "reddit": "reddit.com"}
    text = lambda *cs: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cs])

    def with_kind(u):
        p = F.when(u["path"] == "", F.lit("/")).otherwise(u["path"])
        kind = platform_of_host(u["host"])
        take = lambda pattern, i: F.nullif(F.regexp_extract(p, pattern, i), F.lit(""))
        video = F.when(kind == "youtube", F.coalesce(take(clip, 1), take(embed, 1), F.when(p.rlike("^/watch/*$"), parameter(u["query"], "v"))))
        item = (
            F.when((kind == "instagram") & p.rlike(ig), text("/", F.when(take(ig, 1).startswith("reel"), "reel").otherwise(take(ig, 1)), "/", take(ig, 2), "/"))
            .when((kind == "tiktok") & p.rlike(tt), text("/@", F.lower(take(tt, 1)), "/video/", take(tt, 2)))
            .when((kind == "twitter") & p.rlike(tw), text("/", F.lower(take(tw, 1)), "/status/", take(tw, 2)))
            .when((kind == "reddit") & p.rlike(rd), text("/r/", take(rd, 1), "/comments/", take(rd, 2), "/"))
        )
        return F.struct(u["host"].alias("host"), p.alias("path"), u["query"].alias("query"), kind.alias("kind"), video.alias("video"), item.alias("item"))

    def put_together(u):
        kind, item, video = u["kind"], u["item"], u["video"]
        host = F.when((kind == "instagram") & item.isNotNull(), F.lit("instagram.com"))
        for name, value in fixed_host.items():
            host = host.when(kind == name, F.lit(value))
        p = F.coalesce(item, F.when(video.isNotNull(), F.lit("/watch")), u["path"])
        cut = F.when(kind.isin("instagram", "reddit") | (p == "/"), p).otherwise(F.regexp_replace(p, "/+$", ""))
        q = F.when(item.isNotNull() | (kind == "instagram"), F.lit("")).when(video.isNotNull(), text("v=", _encoded(video))).otherwise(clean_query(u["query"]))
        return F.struct(text("https://", F.coalesce(host, u["host"]), F.when(cut == "", "/").otherwise(cut)).alias("front"), q.alias("query"))

    whole = let(let(let(parts(url), with_kind), put_together), lambda x: text(x["front"], F.when(x["query"] != "", text("?", x["query"])).otherwise("")))
    return F.when(url.isNotNull(), whole)


def _step(df, name: str, value: Column):
    """df with a column made by a generator: the optimizer neither copies it into later steps nor
    pushes a filter on it below, so that it is computed once a row."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def with_canonical(df, column: str = "url", follow: bool = True):
    """df with canonical_url, url_hash and platform; all null where the column holds no address."""
    out = _step(df, "_u0", absolute(F.col(column)))
    for i in range(3):
        out = _step(out, f"_u{i + 1}", unwrap(F.col(f"_u{i}")))
    out = _step(out, "canonical_url", canonical(resolve(F.col("_u3"), follow)))
    out = out.withColumns({"url_hash": F.sha2("canonical_url", 256), "platform": F.when(F.col("canonical_url").isNotNull(), platform(F.col("canonical_url")))})
    return out.drop("_u0", "_u1", "_u2", "_u3")


def resolve_redirects(df, redirects, column: str = "url"):
    """df with short addresses replaced by their targets in redirects(short, target); others stay.  Of several targets the first in text order."""
    known = redirects.groupBy(F.col("short").alias("_short")).agg(F.min("target").alias("_target"))
    joined = df.join(known, F.col(column) == F.col("_short"), "left")
    return joined.withColumn(column, F.coalesce("_target", column)).drop("_short", "_target")


def is_public_address(host: Column) -> Column:
    """An IPv4 or IPv6 address outside the private, loopback, link-local, reserved and multicast ranges; names other than localhost pass.

    A name says nothing of what it resolves to: whoever fetches checks the resolved address too.  What looks like a number
    and is no address (decimal, octal or hex forms) is not public.
    """
    bare = F.lower(F.regexp_replace(F.trim(host), r"^\[|\](:\d+)?$|%.*$", ""))

    def public(h):
        mapped = F.regexp_extract(h, r"^(?:::ffff:(?:0:)?|64:ff9b::)(\d{1,3}(?:\.\d{1,3}){3})$", 1)
        v4 = F.when(mapped != "", mapped).otherwise(h)
        octets = [F.try_element_at(F.split(v4, r"\."), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
        a, b, c = octets[:3]
        closed = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
        closed = closed | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
        # Of IPv6 only 2000::/3 is public, and of that not the ranges for documents, benchmarks, tunnels and 6to4.
        v6 = h.rlike(r"^[23][0-9a-f]{3}:") & ~h.rlike(r"^(2001:0?db8:|2001:(0{0,3}[0-9a-f]|0{0,2}[0-9a-f]{2}|0?[01][0-9a-f]{2})?:|2002:|3fff:0?[0-9a-f]{0,3}:)")
        name = (h != "") & (h != "localhost") & ~h.endswith(".localhost") & ~h.rlike(r"^(0x[0-9a-f]+|\d+)(\.(0x[0-9a-f]+|\d+))*\.?$")
        return F.when(v4.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ~closed & (F.greatest(*octets) <= 255) & ~v4.rlike(r"(^|\.)0\d")).when(h.contains(":"), v6).otherwise(name)

    return F.coalesce(let(bare, public), F.lit(False))


def is_public_url(url: Column) -> Column:
    """A web address (http or https) whose host may be fetched on a caller's behalf."""
    host = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.coalesce(url.rlike(r"(?i)^https?://") & (host != "") & is_public_address(host), F.lit(False))
