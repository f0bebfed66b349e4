"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from utilmine.catalog import queries
from utilmine.shipping import ship

HEADLINE = ("item_twu_brand", "pair_twu_brand", "fhm_brand", "efim_brand", "efim_events", "efim_closed_events", "haui_events", "tko_brand", "shuim_events", "up_growth_plus_events")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(64).repartition(int(cpus)).mapInArrow(lambda batches: batches, "id long").collect()  # start the Python workers, as in a session that is in use
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
