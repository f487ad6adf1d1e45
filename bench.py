"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from clicklog.plans import data, registry

HEADLINE = ["pbm_score", "evaluate_clicks", "dbn_cond", "dbn_uncond", "ubm_cond", "ubm_uncond", "mixture_cond", "pbm_em_step", "ubm_em_step", "dbn_grad_step", "simulate_dbn", "evaluate_ranking", "evaluate_clicks_binned", "pbm_feature_grad_step", "attention_attraction", "fit_pbm_qr"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["scan_sessions"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    began = time.perf_counter()
    data.impressions(spark, sf_dir).count()
    seconds = {"log_build": round(time.perf_counter() - began, 3)}  # once for all queries
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
