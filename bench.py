"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from wavemill.plans.queries import QUERIES

HEADLINE = ["s1_weekly_bars", "c9_validate_bars", "w1_resample_4h", "w2_index_bars", "m6_monowaves", "p3_impulse_chains", "p9_rank_patterns", "p10_scan_all_options", "p12_skip_ahead_all_options", "p14_scan_grid_all_options", "a1_score_distribution", "v1_validate_patterns", "b2_simulate_trades"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    home = tempfile.mkdtemp(prefix="/tmp/spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", home).config("spark.sql.warehouse.dir", f"{home}/warehouse").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's start is not a query's
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
