"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from wickwork.plans import QUERIES
from wickwork.sources.store import sweep

HEADLINE = ("swing_pivots", "sma_50_200", "fear_greed", "candidates_db", "candidates_cup", "detect_double_bottom", "detect_inverse_hs", "detect_wolfe", "scan_all_patterns", "market_series", "grid_rescore", "horizon_table",
            "month_block_bootstrap", "breakdown_grouping_sets", "walk_forward_first_seen")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars_scan_period"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        sweep(spark)
    bars = QUERIES["swing_pivots"].__globals__["bars"](spark, sf_dir).count()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "symbol_days": bars,
                      "replay_symbol_days_per_second": round(bars / took["scan_all_patterns"], 1)}))


if __name__ == "__main__":
    main()
