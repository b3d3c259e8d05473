"""Time the reports and print one JSON line.

Each query runs twice to warm up; ``spread`` is the widest ratio of a query's
slowest to its fastest timed run.

BENCH_SF_DIR   folder with the test tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after the warm-up (default 3, median)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks import registry
from dayzero import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

OPERATORS = ["k04_densify", "k08_transition_matrix", "k10_snapshot_as_of", "k11_first_event"]


def seconds(spark, build) -> float:
    start = time.perf_counter()
    build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    partitions = {
        "spark.sql.shuffle.partitions": CPUS,
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": CPUS,
        "spark.driver.memory": "20g",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("bench", f"local[{CPUS}]", **partitions)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = [*registry.REPORTS, *OPERATORS]
    for name in names * 2:
        seconds(spark, queries[name])
    runs = {name: [seconds(spark, queries[name]) for _ in range(RUNS)] for name in names}
    timed = {name: round(statistics.median(times), 4) for name, times in runs.items()}
    print(
        json.dumps(
            {
                "metric": f"sum of warm median seconds, {len(names)} queries",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "spread": round(max(max(times) / min(times) for times in runs.values()), 2),
                "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
