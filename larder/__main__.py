"""Command line: python -m larder --library FOLDER COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from larder.engine import Library
from larder.functions import pricing
from larder.functions import urls as U
from larder.operators.store import write_report_csv
from larder.session import session

COMMANDS = {
    "canonical": ["url"], "extract": ["pages"], "add": ["pages"], "enrich": [], "preview": [], "backfill": [], "providers": [], "deepen": ["url"], "index": [],
    "query": ["text"], "compare": ["text"], "forget": ["url"], "item": ["url"], "items": [], "degraded": [], "stats": [], "counts": [], "tiers": [], "tags": [],
    "cost": [], "budget": ["seconds", "model"], "submit": ["url"], "run-jobs": [], "jobs": [], "clear-jobs": [], "export": ["path"], "clean": [],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larder")
    p.add_argument("--library", default="larder-library")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in COMMANDS.items():
        s = sub.add_parser(name)
        for w in words:
            s.add_argument(w)
        s.add_argument("--limit", type=int, default=10)
        s.add_argument("--force", action="store_true")
        s.add_argument("--mode", choices=["hybrid", "keyword", "vector", "media", "metadata"])
        for option in ("tier", "tag", "platform", "category", "content-type", "by"):
            s.add_argument(f"--{option}")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    spark = spark or session()
    lib = Library(spark, a.library)
    show = lambda df: df.show(a.limit, truncate=80)
    one = lambda: spark.createDataFrame([(a.url,)], "url string")

    def extract() -> None:
        """The records of one tier (the last by default), stored nowhere."""
        tier = next((t for t in lib.tiers if t.name == a.tier), lib.tiers[-1])
        pages = U.with_canonical(spark.read.parquet(a.pages)).filter("url_hash IS NOT NULL")
        show(tier.extract(pages))

    def query() -> None:
        got = lib.answer(a.text, None, a.mode or "hybrid", a.limit, a.tag, platform=a.platform, category=a.category, content_type=a.content_type)
        for note in got.notes:
            print("note:", note)
        show(got.hits)

    def budget() -> None:
        s, m = F.lit(float(a.seconds)), F.lit(a.model)
        show(spark.range(1).select(pricing.video_tokens(s).alias("tokens"), pricing.video_cost(s, m).alias("cost_usd"), pricing.is_priced(m).alias("priced")))

    run = {
        "canonical": lambda: show(U.with_canonical(one())),
        "extract": extract,
        "add": lambda: show(lib.add(spark.read.parquet(a.pages), a.force).select("canonical_url", "title", "tier", "signal")),
        "enrich": lambda: show(lib.enrich(a.force, mode=a.mode).select("url_hash", "provider", "summary", "category")),
        "preview": lambda: show(lib.preview(a.force)),
        "backfill": lambda: show(lib.backfill(a.limit).select("url_hash", "provider", "summary", "category")),
        "providers": lambda: print("\n".join([*(f"{e.name}: {'ready' if e.available else e.reason}" for e in lib.options.enrichers), "heuristic: ready"])),
        "deepen": lambda: show(lib.deepen(a.url).select("url_hash", "provider", "mode", "summary")),
        "index": lambda: print(lib.index(a.force)),
        "query": query,
        "compare": lambda: show(lib.compare(a.text, a.limit)),
        "forget": lambda: lib.forget(one()),
        "item": lambda: show(lib.item(a.url)),
        "items": lambda: show(lib.items(a.limit)),
        "degraded": lambda: show(lib.degraded(a.limit)),
        "stats": lambda: show(lib.summary()),
        "counts": lambda: print(lib.stats()),
        "tiers": lambda: show(lib.tiers_report()),
        "tags": lambda: show(lib.tags(a.limit)),
        "cost": lambda: show(lib.cost(a.by)),
        "budget": budget,
        "submit": lambda: show(lib.submit(one())),
        "run-jobs": lambda: show(lib.run_jobs()),
        "jobs": lambda: show(lib.recent_jobs(a.limit)),
        "clear-jobs": lambda: print(lib.clear_jobs()),
        "export": lambda: write_report_csv(lib.envelopes.read().select("canonical_url", "title", "tier", "signal", (~F.col("degraded")).alias("success")), a.path),
        "clean": lib.clean,
    }
    run[a.command]()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
