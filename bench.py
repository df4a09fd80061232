"""Times the headline queries once warm: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from settleframe.registry import QUERIES

HEADLINE = (
    "win_rate_by_price", "mispricing_by_price", "maker_vs_taker_returns", "maker_returns_by_direction", "ev_yes_vs_no", "yes_vs_no_by_price", "trade_size_by_role", "win_rate_by_trade_size",
    "returns_by_hour", "vwap_by_hour", "volume_over_time", "longshot_volume_share", "meta_stats", "maker_taker_returns_by_category", "market_types", "chain_win_rate_by_price", "chain_volume_over_time",
    "chain_trades_per_block", "calibration_deviation_over_time", "position_moments",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
