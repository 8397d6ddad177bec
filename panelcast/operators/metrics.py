"""Forecast-quality measures as aggregate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.isoweek import Col, _c
from ..functions.scalars import settle, skill_score

METRICS = ("n", "mae", "rmse", "r2", "smape", "bias", "mae_pct_mean", "mean_observed",
           "total_observed", "total_predicted", "agg_ratio")


def metric_columns(truth: Col, prediction: Col) -> list[Column]:
    """Error measures of one group; usable in any ``agg``.  Rows without truth are ignored."""
    y = _c(truth).cast("double")
    p = F.when(y.isNotNull(), _c(prediction).cast("double"))
    error = p - y
    scale = F.abs(y) + F.abs(p)
    smape = F.when(scale > 1e-12, 2.0 * F.abs(error) / scale).when(scale.isNotNull(), 0.0)
    mae, mean = F.avg(F.abs(error)), F.avg(y)
    return [
        F.count(y).alias("n"), mae.alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(F.var_pop(y) > 1e-12, 1.0 - F.avg(error * error) / F.var_pop(y)).alias("r2"),
        (F.avg(smape) * 100).alias("smape"), F.avg(error).alias("bias"),
        F.when(mean > 1e-12, mae / mean * 100).alias("mae_pct_mean"), mean.alias("mean_observed"),
        F.sum(y).alias("total_observed"), F.sum(p).alias("total_predicted"),
        F.when(F.sum(y) > 1e-12, F.sum(p) / F.sum(y)).alias("agg_ratio")]


def metrics_summary(df: DataFrame, truth: Col = "observed", prediction: Col = "predicted",
                    by: Sequence[str] = ()) -> DataFrame:
    """All measures, for the whole table or per group."""
    return df.groupBy(*by).agg(*metric_columns(truth, prediction))


def extended_metrics(df: DataFrame, truth: Col = "observed", prediction: Col = "predicted",
                     lag_1: Col = "lag_1", by: Sequence[str] = ()) -> DataFrame:
    """CV(RMSE), MASE against last week's value and RMSE/MAE."""
    y, p = _c(truth), _c(prediction)
    error = p - y
    rmse, mae = F.sqrt(F.avg(error * error)), F.avg(F.abs(error))
    return df.groupBy(*by).agg(
        F.try_divide(rmse, F.avg(y)).alias("cv_rmse"),
        F.try_divide(mae, F.avg(F.abs(y - _c(lag_1)))).alias("mase"),
        F.try_divide(rmse, mae).alias("rmse_mae_ratio"))


def safe_r2(truth: Col, prediction: Col) -> Column:
    """R2, null when the truth hardly varies."""
    y, p = _c(truth), _c(prediction)
    return F.when(F.stddev_pop(y) >= 1e-6, 1.0 - F.avg((p - y) * (p - y)) / F.var_pop(y))


# ---------------------------------------------------------------------------
# peaks
# ---------------------------------------------------------------------------
def detect_peaks(value: Col, order: Window, window: int = 3, threshold_pct: float = 50) -> Column:
    """True where the value exceeds its centred moving mean by ``threshold_pct`` percent."""
    half = window // 2
    around = F.avg(_c(value)).over(order.rowsBetween(-half, window - 1 - half))
    return _c(value) > around * (1 + threshold_pct / 100)


def flag_peaks(df: DataFrame, truth: str = "observed", prediction: str = "predicted",
               partition: Sequence[str] = ("health_area",), order: str = "week_index",
               window: int = 3, threshold_pct: float = 50) -> DataFrame:
    spec = Window.partitionBy(*partition).orderBy(order)
    return df.withColumns({"true_peak": detect_peaks(truth, spec, window, threshold_pct),
                           "pred_peak": detect_peaks(prediction, spec, window, threshold_pct)})


def peak_columns(true_peak: str = "true_peak", pred_peak: str = "pred_peak") -> list[Column]:
    """Confusion figures of two peak flags."""
    t, p = F.col(true_peak), F.col(pred_peak)
    tp, fp = F.count_if(t & p), F.count_if(~t & p)
    fn, tn = F.count_if(t & ~p), F.count_if(~t & ~p)

    def pct(part: Column, whole: Column) -> Column:
        return settle(F.try_divide(part, whole) * 100, 1)

    return [pct(tp, tp + fn).alias("sensitivity"), pct(tn, tn + fp).alias("specificity"),
            pct(fp, fp + tn).alias("false_alarm_pct"), F.count_if(t).alias("n_true_peaks"),
            tp.alias("n_detected"), fn.alias("n_missed"), fp.alias("n_false_alarms")]


def compute_peak_detection_metrics(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    return flag_peaks(df, **options).groupBy(*by).agg(*peak_columns())


# ---------------------------------------------------------------------------
# validation tables; input: health_area, week_index, fold, observed, predicted
# ---------------------------------------------------------------------------
def fold_metrics(results: DataFrame, threshold_pct: float = 50) -> DataFrame:
    """One row per fold: errors, bias, peak detection and the tested week range."""
    y, p = F.col("observed"), F.col("predicted")
    flagged = flag_peaks(results, partition=("fold", "health_area"), threshold_pct=threshold_pct)
    return flagged.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.concat_ws("–", F.min("week_index").cast("string"), F.max("week_index").cast("string")).alias("test_weeks"),
        settle(F.avg(F.abs(p - y)), 2).alias("mae"), settle(F.sqrt(F.avg((p - y) * (p - y))), 2).alias("rmse"),
        settle(safe_r2(y, p), 3).alias("r2"), settle(F.avg(p - y), 2).alias("bias"), *peak_columns())


def area_metrics(results: DataFrame) -> DataFrame:
    """Per-area quality, to be ordered by MAE; the label uses the validation R2 scale."""
    y, p = F.col("observed"), F.col("predicted")
    table = results.groupBy("health_area").agg(
        settle(F.avg(F.abs(p - y)), 1).alias("mae"), settle(F.sqrt(F.avg((p - y) * (p - y))), 1).alias("rmse"),
        settle(safe_r2(y, p), 3).alias("r2"), settle(F.avg(p - y), 1).alias("bias"),
        F.count(F.lit(1)).alias("n_weeks"), settle(F.avg(y), 1).alias("mean_observed"))
    return table.withColumns({"mae_pct_mean": settle(F.try_divide("mae", "mean_observed") * 100, 1),
                              "quality": labels.r2_label("r2")})


def best_and_worst_area(areas: DataFrame) -> DataFrame:
    """Best and worst predicted area by MAE (ties: alphabetical)."""
    first = F.struct("mae", "health_area")
    last = F.struct(-F.col("mae"), F.col("health_area"))
    return areas.agg(F.min(first).alias("b"), F.min(last).alias("w")).select(
        F.col("b.health_area").alias("best_area"), F.col("b.mae").alias("best_mae"),
        F.col("w.health_area").alias("worst_area"), (-F.col("w.col1")).alias("worst_mae"))


def global_metrics(results: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """Overall errors, fold-size weighted bias, mean fold R2, residual deviation, mean sensitivity."""
    folds = fold_metrics(results) if folds is None else folds
    y, p = F.col("observed"), F.col("predicted")
    overall = results.agg(
        F.avg(F.abs(p - y)).alias("mae"), F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
        safe_r2(y, p).alias("r2"), F.stddev_pop(p - y).alias("residual_std"), F.avg(y).alias("mean_observed"))
    of_folds = folds.agg(
        F.try_divide(F.sum(F.col("bias") * F.col("n_test")), F.sum("n_test")).alias("bias"),
        F.avg("r2").alias("cv_r2_mean"), F.avg("sensitivity").alias("sensitivity_mean"),
        F.sum("n_true_peaks").alias("n_peaks"), F.sum("n_detected").alias("n_detected"))
    return overall.withColumn("_k", F.lit(1)).join(of_folds.withColumn("_k", F.lit(1)), "_k").drop("_k")


def observed_vs_predicted(results: DataFrame, area: str | None = None, threshold_pct: float = 50) -> DataFrame:
    """Weekly sums with a one-sigma band (floored at 0) and the peak mark.

    The peak window runs over one row per calendar week.
    """
    sigma = results.agg(F.stddev_pop(F.col("predicted") - F.col("observed"))).first()[0] or 0.0
    rows = results.where(F.col("health_area") == area) if area else results
    weekly = rows.groupBy("week_index").agg(F.sum("observed").alias("observed"), F.sum("predicted").alias("predicted"))
    return weekly.withColumns({
        "is_peak": detect_peaks("observed", Window.orderBy("week_index"), threshold_pct=threshold_pct),
        "pred_upper": F.col("predicted") + sigma,
        "pred_lower": F.greatest(F.col("predicted") - sigma, F.lit(0.0))})


def residual_histogram(results: DataFrame, n_bins: int = 30) -> DataFrame:
    """Counts per fold in ``n_bins`` equal bins over the range of the residuals."""
    residual = results.select("fold", (F.col("predicted") - F.col("observed")).alias("residual"))
    low, high = residual.agg(F.min("residual"), F.max("residual")).first()
    if low is None:
        return residual.groupBy("fold", F.lit(0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (high - low) / n_bins or 1.0
    position = F.least(F.floor((F.col("residual") - low) / width), F.lit(n_bins - 1)).cast("int")
    return residual.groupBy("fold", position.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mean_importance(importances: DataFrame) -> DataFrame:
    """Average importance per variable over folds."""
    return importances.groupBy("variable").agg(F.avg("importance").alias("importance"))


def with_skill(df: DataFrame, model: Col, baseline: Col, name: str = "skill") -> DataFrame:
    return df.withColumn(name, skill_score(model, baseline))
