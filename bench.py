"""Bench: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query runs once to warm up, then three times; the median wall time is
reported.  Every run executes the whole plan (``noop`` sink: all rows are
produced, nothing is collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tally.plans.registry import all_checks  # noqa: E402
from tally.session import local_session  # noqa: E402

HEADLINE = [
    "b01_profile_lineitem",
    "c04_segment_revenue",
    "c06_rankings_two_dims",
    "c07_overview",
    "d01_row_chunks_orders",
    "a01_csv_read",
    "h03_display_rows",
    "d06_top_k_per_dataset",
    "d05_cosine_top_k",
    "d05_cosine_top_k_100",
    "q02_pricing_summary",
    "q03_join_region_revenue",
    "q03_lines_by_brand_and_nation",
    "q06_asof_last_event_before_error",
    "q09_monthly_windows",
    "f05_conversation_rollup",
    "h07_html_clean",
    "e04_routing_documents",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=max(cpus, 8), app="tally-bench")
    checks = all_checks()
    times = {}
    for name in HEADLINE:
        build = checks[name].build
        run(build(spark, sf_dir))  # warm-up
        samples = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run(build(spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_median_wall_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "shuffle_partitions": max(cpus, 8),
        "reps": reps,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
