"""Seconds per headline query: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.

Prints one JSON line. Each query runs once to warm up, then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402
from smelter.session import local_session  # noqa: E402

HEADLINE = [
    "profile_orders", "profile_lineitem", "confirm_keys_orders", "quality_checks", "pii_scan_documents",
    "samples_customer", "bronze_cast_lineitem", "norm_date_orders", "silver_dedupe_key", "silver_dedupe_all",
    "gold_orders_daily", "gold_lineitem_daily", "gold_events_daily", "reconcile_lineitem_exact", "version_diff",
    "metric_ratio", "metric_count_distinct", "rollup_month_ratio", "rollup_distinct_sketch", "query_filtered_topn",
    "dim_values", "route_questions", "kpi_panels", "breakdown_panels", "refresh_panels", "holdout_split",
    "gram_cells", "ridge_predictions", "lineage_roots", "quality_scoreboard", "stream_daily_fact",
    "read_csv_orders", "read_ndjson_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or "8"
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("smelter-bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else None)
    seconds = {}
    for name in names:
        taken = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt or runs == 0:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
