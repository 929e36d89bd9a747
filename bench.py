"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lodestar.plans import catalogue

HEADLINE = ["entity_diff", "exact_clones", "structural_clones", "clone_drift", "file_diff_renames", "symbol_changes", "component_rollup", "findings"]
REPEATS = int(os.environ.get("BENCH_REPEATS", "5"))


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm, spread = {}, {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(REPEATS + 1):
            start = time.time()
            catalogue.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(round(time.time() - start, 3))
        cold[name], warm[name], spread[name] = times[0], statistics.median(times[1:]), [min(times[1:]), max(times[1:])]
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "min_max": spread, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
