"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query runs once to warm up and then three times; its time is the median. Results are computed in full by a
write to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from weft import registry

HEADLINE = ["scan_label", "range_filter", "one_hop", "two_hop", "optional_match", "optional_anti", "isomorphism", "comma_join", "tpch_like_revenue", "sum_int", "percentile_disc", "topk", "varlen_1_3", "neighbors_depth", "degree_out_in_both", "shortest_path_pattern", "temporal_parts", "string_fns"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = registry.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.time()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total median seconds of headline graph queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
