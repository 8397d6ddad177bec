"""Reports that reveal leakage, train/serve skew, drift and lost history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pearson, ratio
from .panel import area_window
from .quantiles import exact_quantiles


def collapse_report(cases: DataFrame) -> DataFrame:
    """Rows per (area, year, week) against rows when the year is ignored, per area."""
    yearly = cases.groupBy("health_area", "week_", "year").agg(F.sum("cases").alias("cases"))
    merged = yearly.groupBy("health_area", "week_").agg(F.count(F.lit(1)).alias("n"), F.sum("cases").alias("cases"))
    rows, kept = F.sum("n"), F.count(F.lit(1))
    return merged.groupBy("health_area").agg(rows.alias("rows_before"), kept.alias("rows_after"),
                                             (rows - kept).alias("rows_lost"), F.sum("cases").alias("cases"))


def leakage_reconstruction(panel: DataFrame, population: DataFrame, pop: str = "pop_totale") -> DataFrame:
    """How well leaking features rebuild the target: ``2 * ma2 - lag1`` and ``rate * pop / 10 000``."""
    y = F.col("cases").cast("double")
    lag = F.lag(y, 1).over(area_window())
    df = panel.join(population.select("health_area", F.col(pop).cast("double").alias("_pop")), "health_area", "left")
    df = df.select("health_area", y.alias("y"), lag.alias("_lag"), F.avg(y).over(area_window().rowsBetween(-1, 0)).alias("_ma"),
                   "_pop", ratio(y, "_pop", 10000).alias("_rate"))
    guesses = {"unshifted_mean": F.when(F.col("_lag").isNotNull(), 2 * F.col("_ma") - F.col("_lag")),
               "same_week_rate": F.col("_rate") * F.col("_pop") / 10000}
    rows = df.agg(*[F.struct(F.count(g).alias("n"), pearson(g, "y").alias("corr"),
                             F.max(F.abs(g - F.col("y"))).alias("max_abs_error")).alias(name) for name, g in guesses.items()])
    return rows.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("leak"), *[F.col(f"{name}.{k}").alias(k) for k in ("n", "corr", "max_abs_error")])
        for name in guesses])))


def _means(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    have = [c for c in columns if c in df.columns]
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(have)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"_{i}").alias(name))
                                          for i, c in enumerate(have)])))


def skew_report(train: DataFrame, served: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each feature at fit and at forecast time; flagged when absent or off by more than 50 %."""
    table = _means(train, columns, "train_mean").join(_means(served, columns, "forecast_mean"), "variable", "left")
    gap = F.abs(F.col("forecast_mean") - F.col("train_mean")) / F.greatest(F.abs("train_mean"), F.lit(1e-9))
    off = (F.abs("train_mean") > 1e-9) & (gap > 0.5)
    return table.withColumn("flagged", F.col("forecast_mean").isNull() | F.coalesce(off, F.lit(False)))


def recent_weeks(panel: DataFrame, n: int) -> DataFrame:
    """The last ``n`` weeks of each area."""
    newest = Window.partitionBy("health_area").orderBy(F.desc("week_index"))
    return panel.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def drift_report(panel: DataFrame, forecast: DataFrame, n_recent: int = 4) -> DataFrame:
    """Predicted against observed level: overall, and the spread of the per-area ratios."""
    recent = recent_weeks(panel, n_recent).groupBy("health_area").agg(F.avg("cases").alias("obs"))
    ahead = forecast.groupBy("health_area").agg(F.avg("predicted_cases").alias("pred"), F.sum("predicted_cases").alias("total"))
    ratios = ahead.join(recent, "health_area").withColumn("ratio", F.try_divide("pred", "obs"))
    low, mid, high = exact_quantiles(ratios, ["ratio"], [0.1, 0.5, 0.9])["ratio"]
    observed = panel.agg(F.avg("cases")).first()[0]
    counts = ahead.agg(F.count_if(F.col("total") == 0).alias("n_zero_areas"), F.count(F.lit(1)).alias("n_areas"))
    overall = forecast.agg(F.avg("predicted_cases").alias("predicted_mean"))
    joined = overall.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return joined.select(
        F.lit(observed).alias("observed_mean"), "predicted_mean", F.try_divide("predicted_mean", F.lit(observed)).alias("ratio"),
        *[F.lit(v).cast("double").alias(f"area_ratio_{n}") for n, v in (("p10", low), ("median", mid), ("p90", high))],
        "n_zero_areas", "n_areas")


def week_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Weeks present on both sides."""
    return train.select("week_index").intersect(test.select("week_index"))


def area_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("health_area").intersect(test.select("health_area"))
