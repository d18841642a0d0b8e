"""Headline queries on one machine; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "object_gate_g1", "image_limits_and_ids_g3", "admissible_edges_j3", "condition_population_a2",
    "population_summary_a7", "cohort_flags_a12", "image_deltas_a17", "region_growth_test", "cluster_bootstrap_r1", "median_bootstrap_r2", "observation_permutation_r5", "optimal_matching_j3", "holm_r6", "focus_measures_h3",
    "file_name_parsing_f3", "duplicate_edges_j6", "overlap_edges_j7", "connected_regions_h12",
]
LONG_S = 40
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from checks.catalogue import QUERIES
    from replistat.session import build_session

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("replistat-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {}
    for name in HEADLINE:
        took = []
        for i in range(RUNS + 1):
            if i > 1 and took[0] > LONG_S:
                break       # long queries: one run after the warm-up
            t = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        times[name] = round(statistics.median(took[1:]), 3)     # the first run warms up
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
