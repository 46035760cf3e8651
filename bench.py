"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    runs per query, the median counts (default 3)

The derived inputs are written before the clock starts. Each run executes the whole
result into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from checks.views import Tables  # noqa: E402
from stowline.session import build_session  # noqa: E402

HEADLINE = [
    "usage_by_team",
    "old_usage_by_team",
    "old_paths_by_team",
    "old_path_lists",
    "usage_levels",
    "dir_sizes_depth_n",
    "all_dir_sizes",
    "listed_dir_sizes",
    "usage_pivot",
    "top_child_report",
    "old_dir_summary",
    "older_than",
    "date_dirs",
    "prefix_anti_small",
    "prefix_anti_large",
    "old_version_dirs",
    "find_old_local",
    "find_old_listing",
    "final_list",
    "quota_report",
    "tick_filter",
    "interval_pairs",
    "dedup_subset",
    "pack_windows_batches",
    "window_requests",
    "sym_batches",
    "allday_requests",
    "templated_requests",
    "live_dir_sizes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    begun = time.perf_counter()
    tables = Tables(spark, folder)
    for build in (
        tables.inventory, lambda: tables.inventory(raw=True), tables.deep_inventory, tables.exclusions,
        tables.many_exclusions, tables.version_dirs, tables.application_inventory, tables.size_lines,
        tables.listing_lines, tables.tick_rows, tables.windows, tables.interest_csv,
    ):
        build()
    prepared = time.perf_counter() - begun
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            begun = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(taken), 3)
        print(name, [round(one, 2) for one in taken], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
                "runs": runs,
                "prepare_seconds": round(prepared, 3),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
