"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores; arguments, if any, name the queries to run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
HEADLINE = (
    "segment_spend", "normalize_mapping", "coerce_to_schema", "import_errors", "import_first_bad_batch",
    "import_summary", "header_report", "row_hash", "upsert_classify", "upsert_result", "report_missing_related",
    "report_duplicate_keys", "relationship_join", "load_ids", "load_all_or_nothing", "export_manifest",
    "scan_row_numbers", "import_workbooks", "landing_import", "snapshot_diff", "preview_status", "sql_filter",
    "sql_join_inner", "sql_join_full", "sql_join_semi", "sql_join_range", "sql_lateral", "sql_asof", "sql_group",
    "sql_distinct", "sql_cube", "sql_percentile", "sql_rank", "sql_frame_range", "sql_sort", "sql_topk",
    "sql_except", "sql_subquery", "sql_string", "sql_json", "sql_pivot")
RUNS = 2  # the better of two, so one-time code generation is not counted


def main() -> None:
    from sheetlake.plans import all_queries
    from sheetlake.session import build_session

    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in wanted:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            # Every row and column is computed; nothing is brought to the driver.
            queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
