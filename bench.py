"""Headline queries on the tables in $BENCH_SF_DIR; prints one JSON line.

Each query is planned and executed anew on every run, from the files.  Two runs warm the JVM
(class loading, code generation); the reported time is the median of the following runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from stepwise.session import local_session
from workload.registry import QUERIES

HEADLINE = (
    "a8_step_filter",
    "b5_common_properties",
    "b7_property_inventory",
    "c3_funnel_by_user_property",
    "d1_first_only_168h",
    "d2_reentry_24h",
    "d6_unordered_24h",
    "d7_event_totals",
    "e3_stats_first_only",
    "e3_stats_reentry",
    "f1_cohorts",
    "f5_series_hourly",
    "f5_series_daily",
    "f9_strict_completion",
    "g2_dropoff_destinations",
    "g9_between_reentry",
    "g10_path_summary",
    "h2_journeys",
    "h3_activities",
    "h6_transitions",
    "h9_variants",
    "h15_cycles",
    "h18_statistics",
    "k2_event_statistics",
)
WARM_UPS = 2
RUNS = 5


def measure(spark, run, sf_dir: str) -> float:
    times = []
    for _ in range(WARM_UPS + RUNS):
        start = time.perf_counter()
        # The rows themselves are computed and dropped: the driver's fetch is not measured.
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return statistics.median(times[WARM_UPS:])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    measure(spark, QUERIES["d2_reentry_24h"][0], sf_dir)
    seconds = {name: round(measure(spark, QUERIES[name][0], sf_dir), 4) for name in chosen}
    print(
        json.dumps(
            {
                "metric": "headline query seconds, sum of medians, warm JVM",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
