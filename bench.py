"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from loomlog.plans import catalogue

NAMES = list(catalogue.QUERIES)  # every query of the library

if __name__ == "__main__":
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        times = []
        for _ in range(2):
            began = time.time()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
