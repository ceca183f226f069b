"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "golden_top_k_count",
    "golden_group_sum",
    "catalog_nested",
    "docs_unit_content",
    "docs_token_count",
    "embed_documents",
    "graph_bfs",
    "search_vector",
    "search_vector_ann",
    "search_keyword",
    "search_rrf",
    "search_retrieve",
    "fingerprint_schema",
    "drift_changes",
    "ingest_decision",
    "store_replace",
    "audit_score",
    "audit_rollup",
    "attempt_resolve",
    "drift_stream",
]


def main() -> None:
    import workload
    from catalink.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    keys = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registered = workload.all_queries()
    seconds: dict[str, float] = {}
    if "search_retrieve" in keys:
        # What the stores hold before the first question is asked: units and questions with their vectors.
        from workload import search_queries

        started = time.time()
        search_queries.fleet_units(spark, sf_dir)
        search_queries.asked_questions(spark, sf_dir)
        search_queries.corpus_index(spark, sf_dir)
        seconds["stored_inputs"] = round(time.time() - started, 3)
    for key in keys:
        started = time.time()
        registered[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - started, 3)
        print(f"{key} {seconds[key]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
