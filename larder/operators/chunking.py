"""Document assembly and overlapping chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import strip
from larder.operators.batches import slices

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_BLANK_LINE = re.compile(r"\n\s*\n")


def keyword_fields(enriched: Column) -> dict[str, Column]:
    """The six weighted fields of the keyword index; ``enriched`` says whether there is an enrichment."""
    some = lambda *cols: F.array_join(F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in cols]), lambda x: x != ""), " ")
    only = lambda c: F.when(enriched, F.coalesce(c, F.lit(""))).otherwise(F.lit(""))
    people = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(f"entities.{k}"), F.array()) for k in ("people", "organizations", "places", "products")])))
    return {
        "title": F.coalesce(F.col("title"), F.lit("")),
        "summary": only(F.col("summary")),
        "description": only(F.col("description")),
        "tags": F.array_join(F.when(enriched, F.coalesce(F.col("tags"), F.array())).otherwise(F.coalesce(F.col("platform_tags"), F.array())), " "),
        "entities": some(only(F.array_join(people, " ")), F.col("author")),
        "body": some(only(F.array_join(F.col("details"), "; ")), F.col("caption"), F.col("article_text"), F.col("transcript"), F.col("ocr_text"), F.col("visual_description")),
    }


def _lines(*pairs: tuple[str, Column], joiner: str = "\n") -> Column:
    """Labelled lines of the filled values."""
    made = F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), v)) for label, v in pairs])
    return F.array_join(F.array_compact(made), joiner)


def digest(title: Column, summary: Column, about: Column, tags: Column, mentions: Column, kind: Column, author: Column, source: Column, caption: Column) -> Column:
    """A short, dense description; the caption joins in only where there is neither summary nor description."""
    bare = (F.coalesce(summary, F.lit("")) == "") & (F.coalesce(about, F.lit("")) == "")
    return _lines(("title", title), ("summary", summary), ("about", about), ("tags", F.array_join(tags, ", ")), ("mentions", F.array_join(mentions, ", ")), ("category", kind), ("by", author), ("source", source), ("caption", F.when(bare, F.substring(caption, 1, 500))))


def body(caption: Column, visual: Column, onscreen: Column, transcript: Column, article: Column) -> Column:
    """Long-form text as labelled sections."""
    pairs = [("caption", caption), ("visual", visual), ("on-screen text", onscreen), ("transcript", transcript), ("article", article)]
    return _lines(*[(k, strip(v)) for k, v in pairs], joiner="\n\n")


def _packed(parts: list[str], size: int, gap: str) -> list[str]:
    """Parts joined greedily up to a size; a longer part stands alone."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(gap) + len(part) <= size:
            out[-1] += gap + part
        else:
            out.append(part)
    return out


def split_text(text: str, size: int = 2000, overlap: int = 300) -> list[str]:
    """Pieces of a text: whole paragraphs where they fit, else sentences, else words.

    A new piece begins with the end of the one before, from a word on; that may carry it beyond
    the size.
    """
    units: list[str] = []
    for block in filter(None, (b.strip() for b in _BLANK_LINE.split(text))):
        if len(block) <= size:
            units.append(block)
            continue
        run: list[str] = []
        for sentence in _SENTENCE_END.split(block):
            if len(sentence) <= size:
                run.append(sentence)
            else:
                units += _packed(run, size, " ") + _packed(sentence.split(), size, " ")
                run = []
        units += _packed(run, size, " ")
    pieces: list[str] = []
    for unit in units:
        if pieces and len(pieces[-1]) + 2 + len(unit) <= size:
            pieces[-1] += "\n\n" + unit
        else:
            pieces.append((_end_of(pieces[-1], overlap) if pieces else "") + unit)
    return pieces


def _end_of(piece: str, overlap: int) -> str:
    if not 0 < overlap < len(piece):
        return ""
    end = piece[-overlap:]
    space = end.find(" ")
    return (end[space + 1 :] if space > 0 else end).strip() + "\n\n"


def chunks(docs: DataFrame, key: str, digest_col: str, details_col: str, body_col: str, size: int = 2000, overlap: int = 300) -> DataFrame:
    """(key, ordinal, kind, text): a digest, a chunk of each detail of three characters or more, and the body's pieces.

    A task works through some megabytes of bodies at a time, whatever the size of Spark's batches.
    """

    def run(batches):
        for batch in slices(batches, 3):
            rows: list[tuple] = []
            for k, head, details, text in zip(*(c.to_pylist() for c in batch.columns)):
                mine = [("digest", head or "")]
                mine += [("detail", d.strip()) for d in details or [] if d and len(d.strip()) >= 3]
                text = text or ""
                mine += [("body", p) for p in ([text] if len(text) <= size else split_text(text, size, overlap)) if p]
                rows += [(k, i, kind, t) for i, (kind, t) in enumerate(mine)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["k", "ordinal", "kind", "text"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, digest_col, details_col, body_col).mapInArrow(run, f"k {kind}, ordinal int, kind string, text string").withColumnRenamed("k", key)


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts, joined by a sign that no text has; a null part is empty."""
    return F.sha2(F.concat_ws("␟", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
