"""Alerts, risk synthesis and forecast tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, settle
from .panel import area_window
from .quantiles import exact_quantile

# Labels of the risk synthesis.
STRONG_RISE, SLIGHT_RISE, STRONG_FALL, STABLE = "Forte hausse", "Légère hausse", "Forte baisse", "Stable/baisse"


def generate_alerts(forecast: DataFrame, threshold_percentile: float = 75) -> DataFrame:
    """Forecast rows strictly above the percentile of all predictions.

    The percentile is exact and computed without collecting the predictions.
    """
    threshold = exact_quantile(forecast, "predicted_cases", threshold_percentile / 100)
    if threshold is None:
        return forecast.limit(0)
    return forecast.where(F.col("predicted_cases") > F.lit(threshold))


def alert_totals(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("health_area").agg(F.sum("predicted_cases").alias("predicted_cases"),
                                             F.count(F.lit(1)).alias("n_alerts"))


def week_on_layer(layer: DataFrame, forecast: DataFrame, week_index: int) -> DataFrame:
    """Predictions of one week for every area of the layer; missing areas are 0."""
    week = forecast.where(F.col("week_index") == week_index).select("health_area", "predicted_cases")
    return layer.join(week, "health_area", "left").fillna(0.0, ["predicted_cases"])


def week_alerts(layer: DataFrame, forecast: DataFrame, week_index: int, threshold_percentile: float = 75) -> DataFrame:
    """One week on the layer with ``is_alert``: strictly above the percentile, zeros included."""
    table = week_on_layer(layer, forecast, week_index)
    threshold = exact_quantile(table, "predicted_cases", threshold_percentile / 100)
    return table.withColumn("is_alert", F.col("predicted_cases") > F.lit(threshold))


def forecast_cards(week: DataFrame) -> DataFrame:
    """Total, maximum and its area, mean, number and share of alerts of one week."""
    top = F.max(F.struct("predicted_cases", "health_area"))
    alerts, n = F.count_if("is_alert"), F.count(F.lit(1))
    return week.agg(F.sum("predicted_cases").alias("total"), top.alias("t"), F.avg("predicted_cases").alias("mean"),
                    alerts.alias("n_alerts"), ratio(alerts, n, 100).alias("pct_alerts")).select(
        "total", F.col("t.predicted_cases").alias("max_cases"), F.col("t.health_area").alias("max_area"), "mean",
        "n_alerts", "pct_alerts")


def prediction_table(week: DataFrame, population: str = "pop_totale") -> DataFrame:
    """Rate per 10 000 (two decimals) and the alert label."""
    return week.withColumns({
        "rate_10000": settle(ratio("predicted_cases", population, 10000), 2),
        "alert": F.when(F.col("is_alert"), "OUI").otherwise("Non")})


def fixed_threshold_alerts(totals: DataFrame, threshold: float, value: str = "cases") -> DataFrame:
    return totals.where(F.col(value) >= threshold)


def risk_synthesis(forecast: DataFrame, observed: DataFrame, n_weeks: int, rise: float = 20.0,
                   fall: float = 20.0) -> DataFrame:
    """Per area: predicted total, peak week, variation against the observed weekly mean, category.

    ``observed`` holds one row per area and week; pass a completed panel to count
    weeks without cases.
    """
    peak = F.max_by("period", F.struct(F.col("predicted_cases"), -F.col("week_index")))
    ahead = forecast.groupBy("health_area").agg(F.sum("predicted_cases").alias("predicted_total"), peak.alias("peak_week"))
    mean = observed.groupBy("health_area").agg(F.avg("cases").alias("observed_mean"))
    joined = ahead.join(mean, "health_area", "left").fillna(0.0, ["observed_mean"])
    change = (F.col("predicted_total") / n_weeks - F.col("observed_mean")) / (F.col("observed_mean") + 1) * 100
    category = (F.when(F.col("_v") >= rise, STRONG_RISE).when(F.col("_v") <= -fall, STRONG_FALL)
                .when(F.col("_v") > 0, SLIGHT_RISE).otherwise(STABLE))
    return joined.withColumn("_v", change).select(
        "health_area", settle("predicted_total", 1).alias("predicted_total"), settle("_v", 1).alias("variation_pct"),
        category.alias("category"), "peak_week")


def risk_counts(synthesis: DataFrame, n_weeks: int) -> DataFrame:
    total = F.sum("predicted_total")
    return synthesis.agg(
        *[F.count_if(F.col("category") == label).alias(name) for label, name in (
            (STRONG_RISE, "n_strong_rise"), (SLIGHT_RISE, "n_slight_rise"), (STRONG_FALL, "n_strong_fall"), (STABLE, "n_stable"))],
        total.alias("predicted_total"), (total / n_weeks).alias("weekly_mean"))


def risk_layer(layer: DataFrame, synthesis: DataFrame) -> DataFrame:
    """Risk per area of the layer; areas without a forecast are stable with 0."""
    return (layer.join(synthesis, "health_area", "left")
            .fillna(0.0, ["predicted_total", "variation_pct"]).fillna(STABLE, ["category"]))


def top_forecasts(forecast: DataFrame, n: int = 30) -> DataFrame:
    """Largest predictions with the interval and horizon as text."""
    top = forecast.orderBy(F.desc("predicted_cases"), "health_area", "week_index").limit(n)
    return top.withColumns({"interval": F.format_string("%.1f – %.1f", "q10", "q90"),
                            "horizon_label": F.format_string("h+%d", "horizon")})


def observed_and_predicted(observed: DataFrame, forecast: DataFrame) -> DataFrame:
    """Long series with ``type``: Observé / Prédit."""
    seen = observed.select("health_area", "period", F.col("cases").cast("double").alias("cases"), F.lit("Observé").alias("type"))
    ahead = forecast.select("health_area", "period", F.col("predicted_cases").cast("double").alias("cases"),
                            F.lit("Prédit").alias("type"))
    return seen.unionByName(ahead)


# ---------------------------------------------------------------------------
# rules described in the user manual
# ---------------------------------------------------------------------------
def local_thresholds(panel: DataFrame) -> DataFrame:
    """Per area and week: past mean + 2 deviations; red beyond twice that, yellow beyond it."""
    past = area_window().rowsBetween(Window.unboundedPreceding, -1)
    threshold = F.avg("cases").over(past) + 2 * F.stddev_samp("cases").over(past)
    level = (F.when(F.col("threshold").isNull(), F.lit(None).cast("string"))
             .when(F.col("cases") > 2 * F.col("threshold"), "rouge")
             .when(F.col("cases") > F.col("threshold"), "jaune").otherwise("normal"))
    return panel.withColumn("threshold", threshold).withColumn("level", level)


def outbreak_rules(panel: DataFrame, population: DataFrame, children: str = "pop_enfants_0_14", weekly: float = 5.0,
                   four_weeks: float = 50.0) -> DataFrame:
    """Weekly rate, two weeks running above it, and the four-week attack rate (per 10 000 children)."""
    joined = panel.join(population.select("health_area", F.col(children).alias("_kids")), "health_area", "left")
    rate = joined.withColumn("weekly_rate", ratio("cases", "_kids", 10000)).withColumn(
        "above", F.coalesce(F.col("weekly_rate") >= weekly, F.lit(False)))
    before = F.coalesce(F.lag("above").over(area_window()), F.lit(False))
    month = F.sum("weekly_rate").over(area_window().rowsBetween(-3, 0))
    marked = rate.withColumns({"two_weeks": F.col("above") & before, "attack_4w": month})
    return marked.withColumn("confirmed", F.col("two_weeks") | F.coalesce(F.col("attack_4w") > four_weeks, F.lit(False))).drop("_kids")
