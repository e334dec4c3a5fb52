"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a02_daily_sales", "a05_outlier_audit", "a24_family_months", "a36_frequency_encodings", "a53_hierarchy_totals",
    "j03_star_join", "w01_sales_lags", "w03_rolling_mean", "w06_rolling_median", "w08_ewma", "feature_store",
    "m14_leaderboard", "m06_linear_models", "a39_sku_horizon", "replenishment_plan", "t04_priority_queue", "a43_kpis", "i16_upload_items",
)


def main() -> None:
    from larder.registry import QUERIES
    from larder.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", cpus, **{"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up (class loading, first code generation) is not part of the figures.
    QUERIES["replenishment_plan"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}
        )
    )


if __name__ == "__main__":
    main()
