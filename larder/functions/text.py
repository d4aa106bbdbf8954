"""Text functions as Column expressions: coercion, cleaning, clipping, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_E = ""


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, stripped."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def _one_upper(c: str) -> str:
    """The single upper-case letter of a letter whose full one is several."""
    return "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c


#: Letters whose upper case is several letters (sharp s, ligatures, some Greek; none is beyond these code points), and the single one of each.
ONE_UPPER = {c: _one_upper(c) for c in map(chr, range(0x10000)) if len(c.upper()) > 1}


def upper_letterwise(text: Column) -> Column:
    """Upper case of one letter for each (Unicode's simple mapping), so that a text keeps its length.

    The letters that ``upper`` makes several of stand alone in the split and are looked up.
    """
    some, single = "".join(ONE_UPPER), "".join(ONE_UPPER.values())
    parts = F.split(text, f"(?<=[{some}])|(?=[{some}])")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^[{some}]$"), F.translate(p, some, single)).otherwise(F.upper(p))), "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("bigint")


def filled(text: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def to_str(value: Column) -> Column:
    return filled(value)


def to_double(value: Column) -> Column:
    return F.nullif(value, F.lit("")).try_cast("double")


def to_long(value: Column) -> Column:
    """The integer part; text like 1e3 counts, what is no number is null."""
    number = to_double(value)
    return F.when(~F.isnan(number), number.try_cast("bigint"))


def to_tags(value: Column) -> Column:
    """Distinct lower-case tags of a blob that hash signs, commas and white space divide."""
    raw = F.split(F.regexp_replace(F.coalesce(value, F.lit("")), "[#,]", " "), r"(?U)\s+")
    return F.array_distinct(F.filter(F.transform(raw, F.lower), lambda t: t != ""))


def to_timestamp(value: Column) -> Column:
    """Epoch seconds, YYYYMMDD, ISO-8601, three common patterns or RFC 822; what is none is null. UTC unless it says otherwise."""
    t = F.nullif(strip(value.cast("string")), F.lit(""))
    number = t.rlike(r"^\d+$")
    day = number & (F.length(t) == 8)
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UT|UTC|Z)$", " +0000")
    iso = F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t))
    out = F.coalesce(iso, *(F.try_to_timestamp(F.when(t.rlike(p), t), F.lit(f)) for p, f in ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"))), F.try_to_timestamp(F.when(mail.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} "), mail), F.lit("d MMM yyyy HH:mm:ss xx")))
    epoch = F.when(t.try_cast("bigint") > 0, F.timestamp_seconds(t.try_cast("bigint")))
    return F.when(day, F.try_to_timestamp(t, F.lit("yyyyMMdd"))).when(number, epoch).otherwise(out)


def iso_duration(value: Column) -> Column:
    """Seconds of a number, a numeric text or an ISO-8601 time span; zero and nonsense are null."""
    t = strip(value.cast("string"))
    part = lambda unit: F.coalesce(F.regexp_extract(t, rf"^PT.*?(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    span = F.when(t.rlike(r"^PT(\d+(?:\.\d+)?H)?(\d+(?:\.\d+)?M)?(\d+(?:\.\d+)?S)?$"), part("H") * 3600 + part("M") * 60 + part("S"))
    return F.nullif(F.coalesce(t.try_cast("double"), span), F.lit(0.0))


def clean_text(text: Column) -> Column:
    """LF line ends, single spaces, stripped lines, one blank line at most; null when empty."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t ]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)^ +| +$", ""), "\n{3,}", "\n\n")
    return filled(out)


def hashtags(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("#([A-Za-z0-9_]{2,60})"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def redact_query(text: Column, limit: int = 500) -> Column:
    """Values of query parameters hidden, at most ``limit`` characters."""
    return F.substring(F.regexp_replace(text, r"([?&][^=\s&]+)=([^&\s]+)", "$1=<redacted>"), 1, limit)


def last_index(text: Column, char: str) -> Column:
    """Zero-based position of the last such character, -1 where there is none."""
    back = F.instr(F.reverse(text), char)
    return F.when(back > 0, F.length(text) - back).otherwise(F.lit(-1))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters of squeezed text, cut at a word if one ends beyond three fifths, and dots."""
    t = squeeze(text)
    head = F.substring(t, 1, limit)
    cut = last_index(head, " ")
    kept = F.when(cut > limit * 0.6, F.left(head, cut)).otherwise(head)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(kept, r"(?U)\s+$", ""), F.lit("...")))


def excerpt(text: Column, limit: int = 220) -> Column:
    """Squeezed text; a longer one loses its end to three dots."""
    t = squeeze(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def trim_document(text: Column, limit: int, mark: str = "\n[...truncated]") -> Column:
    """A document's first ``limit`` characters and a mark.

    The cut is at the last paragraph, else sentence, else line, else word end beyond three fifths.
    """
    head = F.substring(text, 1, limit)
    kept = None
    for end in ("\n\n", ". ", "\n", " "):
        back = F.instr(F.reverse(head), end[::-1])
        cut = F.when(back > 0, F.length(head) - back - (len(end) - 1)).otherwise(F.lit(-1))
        far = cut > limit * 0.6
        kept = F.when(far, F.left(head, cut)) if kept is None else kept.when(far, F.left(head, cut))
    trimmed = F.regexp_replace(kept.otherwise(head), r"(?U)\s+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(trimmed, F.lit(mark)))


def mostly_ascii(text: Column) -> Column:
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(True)).otherwise(plain / F.length(text) > 0.9)


def sentences(text: Column) -> Column:
    """Split behind sentence ends that white space follows."""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def echoes_title(caption: Column, title: Column, ratio: float = 0.8) -> Column:
    """The title is only the caption's beginning: cut off visibly, or most of the caption."""
    bare = F.regexp_replace(F.regexp_replace(title, "[. ]+$", ""), "\u2026+$", "")
    most = F.length(bare) >= F.length(caption) * ratio
    return (bare != "") & caption.startswith(bare) & (title.rlike("(\u2026|[.]{3})$") | most)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def present_items(joined: Column) -> Column:
    """The parts of a comma-joined text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(joined, ","), strip), lambda x: x != "")


def fold(text: Column) -> Column:
    """Lower case without diacritics, as the index tokenizer sees it (Latin letters)."""
    accents = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
    plain = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
    return F.translate(F.lower(text), accents, plain)


def index_tokens(text: Column) -> Column:
    """Letter and digit runs of folded text."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")
