"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from sourcegrain.plans.registry import all_queries
from sourcegrain.session import build_session

HEADLINE = ["scan_corpus_files", "rule_scan_code", "rule_scan_documents", "line_window_passages", "verify_citations", "finding_lifecycle",
            "similar_document_pairs", "function_clusters", "js_symbols", "import_edges", "bm25_candidates", "merge_claims", "redact_documents",
            "parse_test_logs", "latest_runs", "event_rate_windows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    known = all_queries()
    spark.range(1000).write.format("noop").mode("overwrite").save()  # start the JVM workers before timing
    seconds = {}
    for name in wanted:
        started = time.time()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
