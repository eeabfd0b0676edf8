"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line. Results go to the noop sink."""

from __future__ import annotations

import json
import os
import time

from quern.plans import catalog
from quern.session import build_session

HEADLINE = [
    "rrf_vector_keyword", "vector_topk", "bm25_topk", "parent_expand", "capability_recall", "threshold_sweep", "matcher_exact",
    "fixed_chunks", "parent_child_chunks", "sentence_split", "merge_units", "html_clean_title", "qa_pairs", "history_budget",
    "usage_by_channel", "latency_percentiles", "cost_ledger", "running_balance", "visibility_union", "interval_overlap",
    "exact_dedup", "split_leakage", "benchmark_contamination", "row_eligibility", "lineage_closure", "gate_checks",
]


def main() -> None:
    where = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus, "bench", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{where}/documents.parquet").selectExpr("max(length(text))").collect()  # JVM and reader warm-up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(where.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
