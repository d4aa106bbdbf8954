"""Name -> query, and name -> SQL, of everything but the optional operators."""

from __future__ import annotations

from larder.plans import cases, extract, retrieval, service, store, telemetry, text

ALL = [q for module in (retrieval, telemetry, text, store, extract, service, cases) for q in module.QUERIES]


def queries() -> dict:
    return {q.name: q.run for q in ALL}


def oracle_sql() -> dict:
    return {q.name: q.sql for q in ALL if q.sql}
