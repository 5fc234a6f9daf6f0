"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from eventloom.plans.queries import QUERIES

HEADLINE = (
    "case_duration_by_segment",
    "case_duration_by_weekday",
    "act_sojourn",
    "edge_time",
    "time_between",
    "grid_segment_month",
    "activity_axis_grid",
    "activity_stats",
    "pair_stats",
    "sequence_variants",
    "log_profile",
    "variant_rank_filter",
    "partition_bins",
    "family_activity",
    "wip_series",
    "interleaving",
    "variant_clusters",
    # over a whole log: mining from its graph, replay, alignment of what does not fit
    "graph_tree",
    "behavioural_variants",
    "branch_traversals",
    "repaired_totals",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "4"), int(os.environ.get("BENCH_RUNS", "2"))
    conf = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + runs):  # the first warms up
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        took[name] = round(statistics.median(times[1:]), 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
