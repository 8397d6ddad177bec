"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from panelcast.catalog import QUERIES, everything
from panelcast.session import build_session

HEADLINE = [
    "panel_complete", "temporal_features", "ewm_feature", "coef_population", "spatial_lag", "climate_features", "design_matrix",
    "naive_baselines", "backtest_baselines", "fold_metrics", "kpi_measles", "case_expansion", "climate_weekly", "zonal_stats",
    "knn_weights", "river_distance", "alerts_percentile", "risk_synthesis", "correlations", "sequential_ids",
    "forecast_intervals", "blocked_cv", "backtest_model",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    everything()
    spark = build_session("panelcast-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    timings = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
