"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "rrf_hybrid", "bm25_topk", "bm25_weighted_columns", "bm25_phrase", "postings_stats", "vector_topk", "vector_max_over_chunks", "mode_compare",
    "url_canonical", "url_dedup", "content_hash_dedup", "signal_gate", "tier_stats", "library_summary", "cost_by_model", "top_tags", "bench_p95",
    "quota_window", "rate_limit", "backoff_runs", "upsert_latest", "replace_chunks", "change_detect", "cascade_merge", "term_scores", "bigrams",
    "category_vote", "sentence_dedup", "chunk_split", "html_article", "web_record", "json_flatten", "embed_batch", "stream_window",
]


def stored_index(spark, sf_dir: str, folder: str) -> dict[str, float]:
    """Seconds to build the keyword index as a table, and to search it: the way searches run after indexing."""
    from larder.operators import retrieval as R
    from larder.plans.common import read

    docs, began = read(spark, sf_dir, "documents").withColumnRenamed("text", "body"), time.time()
    words, lengths = R.build_index(docs, "doc_id", {"body": 1.0})
    words.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{folder}/postings")
    lengths.write.parquet(f"{folder}/lengths")
    built = time.time()
    index = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths")
    R.bm25_from_index(index, "doc_id", R.compile_query("erst that tion "), {"body": 1.0}, 10).write.format("noop").mode("overwrite").save()
    return {"index_build": round(built - began, 3), "bm25_stored_index": round(time.time() - built, 3)}


def main() -> None:
    from larder.plans import catalog
    from larder.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as shared:  # one machine: its own folder is shared by all tasks
        conf = {
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": f"file://{shared}",
        }
        spark = session("bench", f"local[{cpus}]", **conf)
        spark.sparkContext.setLogLevel("ERROR")
        queries = catalog.queries()
        names = list(HEADLINES)
        try:
            from larder.llm import queries as llm
        except ModuleNotFoundError:
            pass
        else:
            queries = queries | llm.QUERIES
            names += sorted(llm.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
        spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # the session is warm from here
        took = {}
        for name in names:
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        took |= stored_index(spark, sf_dir, f"file://{shared}/index")
        total = round(sum(took.values()), 3)
        print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
        spark.stop()


if __name__ == "__main__":
    main()
