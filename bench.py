"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

#: Calibration, paired tests, selective prediction, bootstrap, ranking over tied scores; intervals of 2,000 resamples, drawn apart and shared.
HEADLINE = ("calibration_table", "reliability_bins", "macro_f1_fixed", "paired_table", "mcnemar_worst_case", "auroc_by_score", "aurc_by_score", "auroc_tied_scores", "boot_exact_stream", "temperature_fit", "centroid_scorer", "stratified_split", "calibration_table_ci", "system_intervals", "paired_auroc_ci")


def main() -> None:
    from pyspark.sql import SparkSession

    from uqframe.plans import registry
    from uqframe.sources import surrogate

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    start = time.perf_counter()
    surrogate.predictions(spark, sf_dir)  # makes and keeps the frame that stands for files of predictions
    took["prediction_frame"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
