"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local threads. Every query is forced in full
through the ``noop`` sink, so no column is pruned away by a count.
"""
from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gapscope.catalog import load_registry

HEADLINE = (
    "capture_by_instrument", "history_report", "basis_backtest", "signal_sweep", "strategy_search", "event_quality", "stream_coverage", "knowledge_replay",
    "gap_risk_board", "intent_verdicts", "position_summary", "order_lifecycle_audit", "session_study", "guarded_gauntlet", "bootstrap_interval", "backtest_overfitting",
    "walk_forward", "asof_backward", "calibration_by_tier", "token_quality", "stream_continuity")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("gapscope-bench")
             .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) if cpus.isdigit() else 8))).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_registry()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg({"l_quantity": "sum"}).collect()  # start the executors
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
