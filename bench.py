"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the ``noop`` sink (every row computed,
nothing collected to the driver), four times, under the settings the library
ships (``SESSION_CONF``): the first run pays for generating and compiling the
query's code, which at this data size is most of the time; the other three are
the steady state. ``queries`` and ``value`` report the median of those,
``cold_queries`` and ``cold_value`` the first run. What a query wrote on the way
is removed after each run.
``BENCH_QUERIES`` (comma list) narrows the set.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cartcast.plans.registry import QUERIES  # noqa: E402
from cartcast.session import get_session, intermediates  # noqa: E402

HEADLINE = [
    "filter_log",
    "ui_counts",
    "ui_day_activity",
    "ui_features",
    "ui_features_truncated",
    "ui_features_720_cutoff",
    "ui_features_catalogue",
    "multi_split_features",
    "user_features",
    "item_features",
    "labels",
    "eval_metrics",
    "feature_join_labelled",
    "gbt_holdout",
    "rf_holdout",
]


def run(spark, name, sf_dir):
    with intermediates(spark):
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # Local mode runs every task inside the driver JVM, whose heap defaults to
    # 1 GB; give it room so a long bench is not dominated by garbage collection.
    memory = os.environ.get("BENCH_DRIVER_MEMORY", "16g")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus, **{"spark.driver.memory": memory})
    # Untimed: start the JVM's executors and Parquet reader on a trivial job, so
    # the first query's first run does not also carry session start-up.
    spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").selectExpr("count(*)").collect()
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(spark, name, sf_dir), 3)
        warm[name] = round(median(run(spark, name, sf_dir) for _ in range(3)), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold_value": round(sum(cold.values()), 3),
                "cold_queries": cold,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
