"""What the registered queries share: table reading and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from larder.session import shared_folder, spread  # noqa: F401  the queries find it here


@dataclass(frozen=True)
class Query:
    """A registered query and, where SQL can say the same, its SQL."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are to be worked through, on all cores."""
    return spread(read(spark, sf_dir, name))


def quoted(words) -> str:
    """A SQL list of text literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


TOKENS = r"[x FOR x IN regexp_split_to_array(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+') IF x <> '']"


def bm25_sql(source: str, key: str, fields: dict[str, tuple[str, float]], terms: list[tuple[str, bool]]) -> str:
    """Common table expressions up to scored(key, score): the published weighted formula in plain SQL."""
    toks = ", ".join(f"{TOKENS.format(f'coalesce({e}, chr(32))')} AS t_{f}" for f, (e, _) in fields.items())
    test = lambda t, p: f"starts_with(x, '{t}')" if p else f"x = '{t}'"
    freq = ", ".join(" + ".join(f"{w} * len([x FOR x IN t_{f} IF {test(t, p)}])" for f, (_, w) in fields.items()) + f" AS f{i}" for i, (t, p) in enumerate(terms))
    dl = " + ".join(f"len(t_{f})" for f in fields)
    score = " + ".join(f"(CASE WHEN f{i} > 0 THEN (CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END)" for i in range(len(terms)))
    df = ", ".join(f"count(*) FILTER (f{i} > 0)::DOUBLE AS d{i}" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""toks AS (SELECT {key}, {toks} FROM {source}),
        tf AS (SELECT {key}, ({dl})::DOUBLE AS dl, {freq} FROM toks),
        st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM tf),
        scored AS (SELECT {key}, {score} AS score FROM tf, st WHERE {some})"""
