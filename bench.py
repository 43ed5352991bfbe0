"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import queries  # noqa: E402
from tradearea.sources.shipping import ship  # noqa: E402

HEADLINE = (
    "area_features", "trade_area_tuned_full", "trade_area_fixed", "trade_area_closed", "area_overlap_pairs", "forecast_vs_actual_open",
    "forecast_vs_actual_closed", "forecast_backtest", "closure_impact", "channel_weekly_first",
    "weekly_features_first", "closure_training", "closure_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tradearea-"))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    known, took = queries(), {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    stores = spark.read.parquet(f"{folder}/supplier.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "stores": stores}))


if __name__ == "__main__":
    main()
