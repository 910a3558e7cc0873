"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the folder of the tables and ``BENCH_CPUS`` the number of local cores.  Each query runs once to
warm up and then three times; the median counts.  Results go to a sink that computes every row and column.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from gridspark.catalog import load_queries

NAMES = ("verification_table", "score_rmse", "score_iqd", "conditional_quantiles", "spatial_gradient",
         "power_spectrum", "coarsen_then_refine", "block_bootstrap", "feature_importance", "stream_normalize")
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or NAMES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("gridspark-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    found = load_queries()
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            found[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
