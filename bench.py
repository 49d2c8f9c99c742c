"""Headline queries, timed; prints one JSON line.

Each query is run to completion into a sink that drops its rows, once to warm
up and then three times; the median counts.  The input is what the session
reads from $BENCH_SF_DIR on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "det1_natural_text",
    "det1_pattern_scan",
    "det2_entropy_scan",
    "det4_combined_scan",
    "det4_web_pages",
    "det5_commit_scan",
    "src8_added_lines",
    "agg1_summary",
    "agg4_group_by_file",
    "rem1_migration_plan",
    "rem7_rewrite_file",
    "str1_incremental_scan",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("veilscan-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from veilscan.plans.queries import QUERIES

    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        laps = []
        for _ in range(RUNS + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(laps[1:]), 3)
        print(name, [round(x, 2) for x in laps], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "runs": RUNS,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
