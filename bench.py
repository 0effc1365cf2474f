"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], over loaded tables: median and spread of warm runs, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from quantloom.plans import catalogue

LOADED = ["bars", "bars_versions", "factor_long", "stock_info", "macro_data", "alternative_data", "news_sentiment"]
NAMES = [
    "bench_stock_history", "bench_cross_section", "bench_price_scan", "bench_stock_aggregation",
    "b4_pit_latest", "f6_ic_series", "c9_all_factors", "x16_combined_score",
]


def timed(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], dict[str, list[float]]]:
    """Median seconds of each query's warm runs over loaded tables, and the least and most."""
    tables = catalogue.Stored(spark, sf_dir, tempfile.mkdtemp(prefix="spark-"), LOADED)
    took, spread = {}, {}
    for name in NAMES:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "5"))):
            began = time.perf_counter()
            catalogue.MAKE[name](tables).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
        spread[name] = [round(min(runs[1:]), 3), round(max(runs[1:]), 3)]
    return took, spread


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, spread = timed(spark, sf_dir)
    smaller = Path(sf_dir).parent / "sf0.01"
    before = timed(spark, str(smaller))[0] if smaller.is_dir() and smaller != Path(sf_dir) else {}
    growth = {name: round(took[name] / before[name], 2) for name in before}  # times as long as on a tenth of the rows
    print(json.dumps({"metric": "headline queries, sum of medians of warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "least_and_most": spread, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "cpus": cpus, "queries_at_sf0.01": before, "growth_from_sf0.01": growth}))
    spark.stop()


if __name__ == "__main__":
    main()
