"""Headline queries, timed once each. Prints one JSON line.

Every query first runs untimed on the smallest tables next to the timed ones, if they are
there, so that start-up of the JVM and compilation are not part of the figures.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from ballast.queries import queries

HEADLINE = [
    "best_subset_max",
    "best_subset_min",
    "best_subset_brand_max",
    "best_subset_choices",
    "merge_incumbent_max",
    "expand_frontier",
    "rebalance_supplier",
    "rebalance_customer",
    "pick_to_move_supplier",
    "split_moved_supplier",
    "apportion_budget_600",
    "apportion_budget_5000",
    "iterate_halving",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = queries()

    def run(name: str, tables: str) -> float:
        start = time.perf_counter()
        found[name](spark, tables).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in HEADLINE:
            run(name, small)
    seconds = {name: run(name, folder) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
