"""Times the headline reports once warm and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from opsdiff.checks.registry import CHECKS

HEADLINE = [
    "compare_report",     # R1: rows, findings, board, counts
    "window_diff",        # the rows alone
    "proc_report",        # R2
    "state_report",       # R3
    "trend_grid",         # T2 and T3
    "trend_overlay",      # J11
    "counter_rates",      # A2
    "consecutive_diff",   # W7
    "snapshot_asof_join", # J8
    "listing_facts",      # fact parsing
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for attempt in ("warm-up", "timed"):
            started = time.perf_counter()
            # The noop sink computes every row without bringing any to the driver.
            CHECKS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt == "timed":
                seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
