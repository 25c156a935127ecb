"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Each query is built and written to the ``noop`` sink, so every row and column
is computed; intermediate tables that a query writes are part of its time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from tidewatt.plans.catalogue import QUERIES  # noqa: E402

HEADLINE = [
    "hourly_series", "missing_hours_by_user", "null_report", "densify", "feature_table", "feature_table_by_user",
    "row_index", "chrono_split", "iqr_bounds", "load_heatmap", "last_168", "seasonal_naive_24", "extended_naive_168",
    "forecast_metrics", "detect_flags", "detect_by_user", "full_analysis", "forecast_ml_24", "detect_pca",
    "forecast_ml_168", "tune_forecaster",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begun = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begun, 3)

    run("hourly_series")  # starts the JVM's threads and reads the footer once
    times = {name: run(name) for name in HEADLINE}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
