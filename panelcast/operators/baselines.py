"""Naive forecasts and the relational half of validation: splits, folds, origins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import settle, skill_score
from .metrics import metric_columns, metrics_summary
from .panel import area_window
from .ranking import global_rank

# Names of the reference forecasts.
PERSISTENCE, SEASONAL = "persistance", "saisonnier_naif"
AREA_MEAN, SEASON_MEAN = "moyenne_aire", "moyenne_saison"


def baseline_predictions(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """Four forecasts of each week made ``horizon`` weeks earlier (``horizon=1``: last week)."""
    y = F.col("cases")
    season = Window.partitionBy("health_area", "week_").orderBy("week_index")
    past = area_window().rowsBetween(Window.unboundedPreceding, -horizon)
    return panel.select(
        "health_area", "year", "week_", "week_index", "cases",
        F.lag(y, horizon).over(area_window()).alias(PERSISTENCE), F.lag(y, 52).over(area_window()).alias(SEASONAL),
        F.avg(y).over(past).alias(AREA_MEAN),
        F.avg(y).over(season.rowsBetween(Window.unboundedPreceding, -1)).alias(SEASON_MEAN))


def naive_baselines(panel: DataFrame, horizons: Sequence[int] = (1,), min_rows: int = 10) -> DataFrame:
    """Error measures of the four baselines per horizon, in one aggregation."""
    melted = None
    for h in horizons:
        wide = baseline_predictions(panel, h)
        long = wide.select(F.lit(h).alias("horizon"), "cases", F.inline(F.array(*[
            F.struct(F.lit(name).alias("modele"), F.col(name).alias("predicted"))
            for name in (PERSISTENCE, SEASONAL, AREA_MEAN, SEASON_MEAN)])))
        melted = long if melted is None else melted.unionByName(long)
    melted = melted.where(F.col("cases").isNotNull() & F.col("predicted").isNotNull())
    return metrics_summary(melted, "cases", "predicted", by=("modele", "horizon")).where(F.col("n") >= min_rows)


# ---------------------------------------------------------------------------
# splits
# ---------------------------------------------------------------------------
def temporal_cv_splits(panel: DataFrame, n_splits: int = 5, embargo: int = 4,
                       min_train_frac: float = 0.4) -> DataFrame:
    """(fold, role, week_index): blocked by week, expanding window, with an embargo.

    The distinct weeks (bounded by the calendar) are the only thing read on the
    driver; the fold table is joined to the panel where it is used.
    """
    weeks = sorted(r[0] for r in panel.select("week_index").where(F.col("week_index").isNotNull()).distinct().collect())
    n = len(weeks)
    if n < n_splits + 2:
        raise ValueError(f"{n} distinct weeks are not enough for {n_splits} temporal folds")
    start = max(math.ceil(n * min_train_frac), 2)
    cuts = np.linspace(start, n, n_splits + 1).astype(int)
    rows, fold = [], 0
    for low, high in zip(cuts[:-1], cuts[1:]):
        train = weeks[:max(0, low - embargo)]
        if high <= low or not train:
            continue
        fold += 1
        rows += [(fold, "train", int(w)) for w in train] + [(fold, "test", int(w)) for w in weeks[low:high]]
    return panel.sparkSession.createDataFrame(rows, "fold int, role string, week_index int")


def fold_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows per fold and role (a row appears once per fold that uses it)."""
    return panel.join(folds, "week_index")


def row_order_folds(panel: DataFrame, n_splits: int = 5) -> DataFrame:
    """Contiguous blocks of the (area, week) row order; leaks by design.

    Every fold trains on the rows before its test block.  Positions come from
    per-area row counts: areas are ranked, rows are counted inside their area.
    """
    per_area = panel.groupBy("health_area").agg(F.count(F.lit(1)).alias("_rows"))
    start = global_rank(per_area, ["health_area"], "_start", weight="_rows").drop("_rows")
    total = panel.count()
    size = total // (n_splits + 1)
    first = total - size * n_splits
    position = F.col("_start") - 1 + F.row_number().over(area_window()) - 1
    placed = panel.join(start, "health_area").withColumn("position", position)
    block = F.when(F.col("position") < first, 0).otherwise(F.floor((F.col("position") - first) / F.lit(size)) + 1)
    return (placed.withColumn("_block", block.cast("int"))
            .withColumn("fold", F.explode(F.sequence(F.greatest(F.col("_block"), F.lit(1)), F.lit(n_splits))))
            .withColumn("role", F.when(F.col("fold") == F.col("_block"), "test").otherwise("train"))
            .drop("_start", "_block"))


def random_folds(df: DataFrame, keys: Sequence[str], n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Reproducible random assignment 1..n_folds from a hash of the row key."""
    return df.withColumn("fold", (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n_folds)) + 1).cast("int"))


def random_holdout(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    cell = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000))
    return df.withColumn("role", F.when(cell < int(test_share * 1_000_000), "test").otherwise("train"))


def check_no_leakage(assigned: DataFrame) -> DataFrame:
    """Per fold: sizes, week ranges, areas and the weeks present on both sides.

    Reduced to one row per (fold, week) first; the sets of weeks are calendar-bounded.
    """
    train, test = F.col("role") == "train", F.col("role") == "test"
    weekly = assigned.groupBy("fold", "week_index").agg(
        F.count_if(train).alias("a"), F.count_if(test).alias("b"))
    shared = (F.col("a") > 0) & (F.col("b") > 0)
    by_week = weekly.groupBy("fold").agg(
        F.sum("a").alias("n_train"), F.sum("b").alias("n_test"),
        F.min(F.when(F.col("a") > 0, F.col("week_index"))).alias("train_week_min"),
        F.max(F.when(F.col("a") > 0, F.col("week_index"))).alias("train_week_max"),
        F.min(F.when(F.col("b") > 0, F.col("week_index"))).alias("test_week_min"),
        F.max(F.when(F.col("b") > 0, F.col("week_index"))).alias("test_week_max"),
        F.array_sort(F.collect_list(F.when(shared, F.col("week_index")))).alias("week_overlap"))
    areas = (assigned.groupBy("fold", "health_area").agg(F.bool_or(train).alias("a"), F.bool_or(test).alias("b"))
             .groupBy("fold").agg(F.count_if(F.col("a")).alias("train_areas"), F.count_if(F.col("b")).alias("test_areas")))
    return by_week.withColumn("leakage", F.size("week_overlap") > 0).join(areas, "fold")


# ---------------------------------------------------------------------------
# rolling origins
# ---------------------------------------------------------------------------
def backtest_origins(panel: DataFrame, horizons: Sequence[int] = (1, 2, 4, 8), n_origins: int = 12,
                     min_train_weeks: int = 52) -> list[int]:
    """Evenly spread cut-off weeks (the distinct weeks are calendar-bounded)."""
    weeks = sorted(r[0] for r in panel.select("week_index").distinct().collect())
    usable = weeks[min_train_weeks:len(weeks) - max(horizons)]
    if len(weeks) <= min_train_weeks + max(horizons) + 1 or not usable:
        raise ValueError("the history is too short for a multi-horizon backtest")
    spread = np.linspace(usable[0], usable[-1], max(1, min(n_origins, len(usable))))
    return sorted({int(v) for v in np.round(spread)})


def origin_truth(panel: DataFrame, origins: Sequence[int], horizons: Sequence[int], parity: bool = False) -> DataFrame:
    """For each origin, horizon and area: truth, last value, value 52 weeks before, past mean.

    All four come from windows over the panel, so it is shuffled once for all
    origins; only origin rows are then multiplied by the horizons.
    """
    y = F.col("cases")
    past = area_window().rowsBetween(Window.unboundedPreceding, 0)
    if parity:  # historical variant: mean over the whole panel, future included
        past = Window.partitionBy("health_area")
    ahead = panel.select("health_area", F.col("week_index").alias("origin"), y.alias(PERSISTENCE),
                         F.avg(y).over(past).alias(AREA_MEAN), F.array(*[
                             F.struct(F.lit(h).alias("horizon"), F.lead(y, h).over(area_window()).alias("y"),
                                      (F.lag(y, 52 - h).over(area_window()) if h <= 52 else
                                       F.lead(y, h - 52).over(area_window())).alias(SEASONAL))
                             for h in horizons]).alias("_h"))
    return (ahead.where(F.col("origin").isin([int(o) for o in origins]))
            .select("health_area", "origin", PERSISTENCE, AREA_MEAN, F.inline("_h"))
            .where(F.col("y").isNotNull()))


def baseline_forecasts(truth: DataFrame) -> DataFrame:
    """(modele, type, origin, horizon, health_area, y, predicted) of the three baselines."""
    return truth.select("health_area", "origin", "horizon", "y", F.inline(F.array(*[
        F.struct(F.lit(name).alias("modele"), F.col(name).alias("predicted"))
        for name in (PERSISTENCE, SEASONAL, AREA_MEAN)]))).where(
            F.col("predicted").isNotNull()).withColumn("type", F.lit("baseline"))


def summarise_backtest(forecasts: DataFrame, min_rows: int = 10) -> DataFrame:
    """Mean measures over origins, pooled measures, best baseline and skill per (modele, horizon)."""
    keys = ["modele", "type", "horizon"]
    averaged = ("mae", "rmse", "r2", "smape", "bias", "agg_ratio", "mae_pct_mean")
    kept = metrics_summary(forecasts, "y", "predicted", by=(*keys, "origin")).where(
        (F.col("n") >= min_rows) | (F.col("type") == "modele"))
    means = kept.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in averaged], F.sum("n").alias("n"))
    scope = kept.select(*keys, "origin")
    pooled = (forecasts.join(scope, [*keys, "origin"]).groupBy(*keys).agg(*metric_columns("y", "predicted"))
              .select(*keys, *[F.col(m).alias(f"{m}_pool") for m in averaged]))
    best = (pooled.where(F.col("modele").isin(SEASONAL, AREA_MEAN)).groupBy("horizon")
            .agg(F.min("mae_pool").alias("best_baseline_mae")))
    return (means.join(pooled, keys).join(best, "horizon", "left")
            .withColumn("skill_mae_vs_baseline", settle(skill_score("mae_pool", "best_baseline_mae"), 4)))


def backtest_baselines(panel: DataFrame, horizons: Sequence[int] = (1, 2, 4, 8), n_origins: int = 12,
                       min_train_weeks: int = 52, parity: bool = False) -> DataFrame:
    """Backtest of the naive forecasts, all origins in one plan."""
    origins = backtest_origins(panel, horizons, n_origins, min_train_weeks)
    return summarise_backtest(baseline_forecasts(origin_truth(panel, origins, horizons, parity)))
