"""Blocked validation, rolling-origin backtest and configuration studies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..operators import baselines as bl
from ..operators import features as ft
from ..operators import metrics
from ..session import materialise
from .forecast import Fitted, fit_matrix, forecast_origins, score_origins, training_rows
from .linear import Sums, by_membership, growing, solvable, training_sums

PARALLELISM = 8


def _in_parallel(spark, tasks: Sequence[Callable], parallelism: int = PARALLELISM) -> list:
    """Run independent Spark actions side by side; the cluster's scheduler shares the executors."""
    if len(tasks) == 1:
        return [tasks[0]()]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def design_once(panel: DataFrame, builder: Callable, feature_cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The pruned design matrix, written once for all folds or origins.

    Features of week t never look past t, so every fold and origin is a filter of it.
    """
    matrix, columns = ft.written_matrix(panel, builder, feature_cols)
    return training_rows(matrix, columns), columns


def blocked_predictions(matrix: DataFrame, columns: Sequence[str], folds: DataFrame, model_factory: Callable,
                        parallelism: int = PARALLELISM, **fit_options) -> DataFrame:
    """Test predictions of every fold: ``fold, health_area, week_index, observed, predicted``.

    ``folds``: ``fold, role`` keyed by the columns it shares with the matrix.  Least
    squares of all folds come from one set of moments and all test rows are scored at
    once; other models are fitted side by side.
    """
    keys = [c for c in folds.columns if c not in ("fold", "role")]
    if (penalty := solvable(model_factory)) and not set(fit_options) - {"log_target"}:
        marked, sets = by_membership(matrix, folds, keys)
        marked = materialise(marked)
        sums = training_sums(marked, columns, sets, F.col("_segment"))
        target = "log" if fit_options.get("log_target") else "cases"
        fits = {fold: sums.fit(fold, columns, penalty, target) for fold in sets}
        test = matrix.join(folds.where("role = 'test'").select("fold", *keys), keys)
        values = F.transform(F.array(*[F.col(c).cast("double") for c in columns]), finite)
        rows = test.select(F.col("fold").cast("int").alias("origin"), "health_area", "week_index", "cases", values.alias("values"))
        return score_origins(fits, rows, list(columns)).select(F.col("origin").alias("fold"), "health_area", "week_index",
                                                               F.col("cases").alias("observed"), F.col("predicted_cases").alias("predicted"))
    numbers = sorted(r[0] for r in folds.select("fold").distinct().collect())

    def one(fold: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            part = folds.where(F.col("fold") == fold)
            train = matrix.join(part.where("role = 'train'").select(*keys), keys, "left_semi")
            test = matrix.join(part.where("role = 'test'").select(*keys), keys, "left_semi")
            fitted = fit_matrix(train, columns, model_factory, diagnostics=False, **fit_options)
            return fitted.predict(test).select(F.lit(fold).alias("fold"), "health_area", "week_index",
                                               F.col("cases").alias("observed"), F.col("predicted_cases").alias("predicted"))
        return run

    parts = _in_parallel(matrix.sparkSession, [one(f) for f in numbers], parallelism)
    return reduce(DataFrame.unionByName, parts)


def summarise_folds(results: DataFrame, folds: DataFrame) -> dict:
    """Per-fold measures with their week ranges, mean and spread of R2, pooled measures."""
    def span(role: str) -> DataFrame:
        return folds.where(F.col("role") == role).groupBy("fold").agg(
            F.concat_ws("-", F.min("week_index").cast("string"), F.max("week_index").cast("string")).alias(f"{role}_weeks"))

    table = metrics.metrics_summary(results, by=["fold"]).join(span("train"), "fold", "left").join(span("test"), "fold", "left")
    overall = table.agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"), F.avg("mae").alias("cv_mae_mean"),
                        F.count(F.lit(1)).alias("n_splits")).first().asDict()
    return {"folds": table, "pooled": metrics.metrics_summary(results), "predictions": results, **overall}


def temporal_validation(panel: DataFrame, design_builder: Callable, model_factory: Callable, n_splits: int = 5,
                        embargo: int = 4, feature_cols: Sequence[str] | None = None) -> dict:
    """Blocked cross-validation at horizon 1 with an embargo; never trains on later weeks."""
    matrix, columns = design_once(panel, design_builder, feature_cols)
    if matrix.limit(50).count() < 50:
        raise ValueError("the history is too short for temporal validation")
    folds = bl.temporal_cv_splits(matrix, n_splits, embargo)
    results = materialise(blocked_predictions(matrix, columns, folds, model_factory))
    return summarise_folds(results, folds)


def row_order_validation(panel: DataFrame, model_factory: Callable, n_splits: int = 5, threshold_pct: float = 50,
                         lags: Sequence[int] = (1, 2, 4), extra_columns: Sequence[str] = ()) -> dict:
    """Validation in row order with unshifted features, as the retrospective page runs it.

    Leaks by construction; kept to be compared with :func:`temporal_validation`.
    """
    df = ft.add_unshifted_features(panel, lags).where(F.col("cases_lag_1").isNotNull() & F.col("cases_lag_2").isNotNull())
    columns = [*(f"cases_lag_{k}" for k in lags), "cases_ma_2", "cases_ma_4", "sin_week", "cos_week", "growth_rate",
               *[c for c in extra_columns if c in df.columns]]
    matrix = materialise(df.select("health_area", "week_index", "cases", *columns))
    folds = bl.row_order_folds(matrix.select("health_area", "week_index"), n_splits).select("fold", "role", "health_area", "week_index")
    results = materialise(blocked_predictions(matrix, columns, materialise(folds), model_factory))
    table = metrics.fold_metrics(results, threshold_pct)
    return {"results": results, "folds": table, "areas": metrics.area_metrics(results),
            "overall": metrics.global_metrics(results, table)}


# ---------------------------------------------------------------------------
# rolling origins
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Shared:
    """One matrix with all features, its sums, and the columns that are usable up to each origin."""

    origins: list[int]
    matrix: DataFrame
    usable: dict[int, list[str]]
    sums: Sums

    @classmethod
    def build(cls, panel: DataFrame, builder: ft.DesignBuilder, horizons: Sequence[int], n_origins: int, min_train_weeks: int) -> Shared:
        origins = bl.backtest_origins(panel, horizons, n_origins, min_train_weeks)
        matrix, columns = design_once(panel, builder)
        return cls(origins, matrix, ft.usable_columns_by_origin(matrix, columns, origins), training_sums(matrix, columns, *growing(origins)))

    def columns_of(self, origin: int, builder: ft.DesignBuilder) -> list[str]:
        """The usable columns that a builder with fewer sources, lags or windows still makes."""
        return [c for c in self.usable[origin] if builder.makes(c)]


def backtest_forecasts(panel: DataFrame, design_builder: ft.DesignBuilder, model_factory: Callable,
                       horizons: Sequence[int] = (1, 2, 4, 8), n_origins: int = 12, min_train_weeks: int = 52,
                       feature_cols: Sequence[str] | None = None, objective: str = "squared_error", log_target: bool = False,
                       with_baselines: bool = True, parallelism: int = PARALLELISM, name: str | None = None,
                       shared: Shared | None = None) -> DataFrame:
    """(modele, type, origin, horizon, health_area, y, predicted) of the model and the baselines.

    The matrix is built once.  Least squares of all origins come from one set of moments,
    other models are fitted side by side; then all origins advance together.  ``shared``
    holds a matrix and sums that several configurations have in common.
    """
    panel = materialise(panel) if shared is None else panel
    origins = bl.backtest_origins(panel, horizons, n_origins, min_train_weeks) if shared is None else shared.origins
    if shared is None:
        matrix, columns = design_once(panel, design_builder, feature_cols)
        usable = {o: columns for o in origins} if feature_cols is not None else ft.usable_columns_by_origin(matrix, columns, origins)
    else:
        matrix, usable = shared.matrix, {o: shared.columns_of(o, design_builder) for o in origins}

    def one(origin: int) -> Callable[[], Fitted]:
        def run() -> Fitted:
            return fit_matrix(matrix.where(F.col("week_index") <= origin), usable[origin], model_factory,
                              objective, log_target, diagnostics=False)
        return run

    if (penalty := solvable(model_factory)) and objective == "squared_error":
        sums = shared.sums if shared else training_sums(matrix, columns, *growing(origins))
        fits = {o: sums.fit(o, usable[o], penalty, "log" if log_target else "cases") for o in origins}
    else:
        fits = dict(zip(origins, _in_parallel(panel.sparkSession, [one(o) for o in origins], parallelism)))
    forecasts = forecast_origins(fits, panel, int(max(horizons)), design_builder)
    truth = bl.origin_truth(panel, origins, horizons)
    label = name or getattr(model_factory, "name", next(iter(fits.values())).model_name)
    model = truth.join(forecasts, ["origin", "health_area", "horizon"]).select(
        "health_area", "origin", "horizon", "y", F.lit(label).alias("modele"), F.col("predicted_cases").alias("predicted"),
        F.lit("modele").alias("type"))
    return model.unionByName(bl.baseline_forecasts(truth)) if with_baselines else model


def backtest(panel: DataFrame, design_builder: ft.DesignBuilder, model_factory: Callable,
             horizons: Sequence[int] = (1, 2, 4, 8), n_origins: int = 12, min_train_weeks: int = 52,
             feature_cols: Sequence[str] | None = None, objective: str = "squared_error", log_target: bool = False,
             with_baselines: bool = True, name: str | None = None, shared: Shared | None = None) -> DataFrame:
    """Mean and pooled measures per (modele, horizon) with the skill against the best baseline."""
    rows = backtest_forecasts(panel, design_builder, model_factory, horizons, n_origins, min_train_weeks, feature_cols,
                              objective, log_target, with_baselines, name=name, shared=shared)
    return bl.summarise_backtest(materialise(rows))


# ---------------------------------------------------------------------------
# studies: a list of configurations over the same evaluation
# ---------------------------------------------------------------------------
def compare(panel: DataFrame, configs: Mapping[str, Mapping], **options) -> DataFrame:
    """Backtest every configuration (``design_builder``, ``model_factory``, ...) and stack the results."""
    parts = _in_parallel(panel.sparkSession, [lambda label=label, config=config: backtest(panel, **{**options, **config}).withColumn("config", F.lit(label))
                                              for label, config in configs.items()])
    return reduce(DataFrame.unionByName, parts)


def ablations(panel: DataFrame, builder: ft.DesignBuilder, model_factory: Callable, horizons: Sequence[int] = (1, 4),
              **options) -> DataFrame:
    """Full features against no static covariates, no spatial lag and short lags only.

    The features of the smaller builders are columns of the full matrix, so least
    squares of all configurations and origins come from the moments of one matrix.
    """
    given = builder.__dict__
    panel = materialise(panel)
    if solvable(model_factory) and options.get("objective", "squared_error") == "squared_error":
        options["shared"] = Shared.build(panel, builder, horizons, options.get("n_origins", 12), options.get("min_train_weeks", 52))
    configs = {
        "complet": builder,
        "sans covariables statiques": ft.DesignBuilder(**{**given, "static_df": None, "geometry": None}),
        "sans lag spatial": ft.DesignBuilder(**{**given, "neighbour_weights": None}),
        "lags 1, 2, 4": ft.DesignBuilder(**{**given, "lags": (1, 2, 4)}),
    }
    return compare(panel, {k: {"design_builder": b, "model_factory": model_factory} for k, b in configs.items()},
                   horizons=horizons, **options)


def objectives(panel: DataFrame, builder: ft.DesignBuilder, factory_for: Callable[[str], Callable],
               horizons: Sequence[int] = (1, 4), **options) -> DataFrame:
    """Squared error, Poisson and log1p target on the same origins, matrix and moments."""
    panel = materialise(panel)
    options["shared"] = Shared.build(panel, builder, horizons, options.get("n_origins", 12), options.get("min_train_weeks", 52))
    configs = {"squared_error": {}, "poisson": {"objective": "poisson"}, "log1p": {"log_target": True}}
    return compare(panel, {k: {"design_builder": builder, "model_factory": factory_for(c.get("objective", "squared_error")), **c}
                           for k, c in configs.items()}, horizons=horizons, with_baselines=False, **options)


# Feature sets of the leakage study.
LEAK_BASE = ("cases_lag_1", "cases_lag_2", "cases_lag_4", "growth_rate", "sin_week", "cos_week")
LEAK_MEANS = ("cases_ma_2", "cases_ma_4")
LEAK_RATES = ("incidence_rate", "child_risk", "demo_pressure")
LEAK_STATIC = ("Pop_Totale", "Pop_Enfants_0_14", "Densite_Pop")
LEAK_PROTOCOLS = {
    "toutes les fuites": (*LEAK_BASE, *LEAK_MEANS, *LEAK_RATES, *LEAK_STATIC),
    "sans moyennes non décalées": (*LEAK_BASE, *LEAK_RATES, *LEAK_STATIC),
    "sans taux de la semaine": (*LEAK_BASE, *LEAK_MEANS, *LEAK_STATIC),
    "sans fuite": (*LEAK_BASE, *LEAK_STATIC),
}


def leakage_study(panel: DataFrame, static_df: DataFrame, model_factory: Callable, n_splits: int = 5,
                  embargo: int = 4) -> DataFrame:
    """The same model with and without leaking features on blocked folds, and on random folds.

    Rates here use the *same* week's cases and means include it: that is the leak.
    """
    df = ft.add_static_features(ft.add_unshifted_features(panel), static_df)
    df = ft.add_population_rates(df, F.col("cases")).where(F.col("cases_lag_1").isNotNull())
    columns = [c for c in LEAK_PROTOCOLS["toutes les fuites"] if c in df.columns]
    matrix = materialise(df.select("health_area", "week_index", "cases", *columns))
    blocked = bl.temporal_cv_splits(matrix, n_splits, embargo)
    assigned = bl.random_folds(matrix.select("health_area", "week_index"), ["health_area", "week_index"], n_splits)
    every = assigned.select("health_area", "week_index", F.col("fold").alias("_own"),
                            F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold"))
    shuffled = materialise(every.select("fold", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train").alias("role"),
                                        "health_area", "week_index"))
    runs = [(label, "temporel", [c for c in names if c in columns], blocked) for label, names in LEAK_PROTOCOLS.items()]
    runs.append(("sans fuite", "aléatoire", [c for c in LEAK_PROTOCOLS["sans fuite"] if c in columns], shuffled))
    parts = []
    for label, split, names, folds in runs:
        results = blocked_predictions(matrix, names, folds, model_factory)
        whole = fit_matrix(matrix, names, model_factory)
        parts.append(metrics.metrics_summary(results).withColumns({
            "protocol": F.lit(label), "split": F.lit(split), "n_features": F.lit(len(names)),
            "r2_in_sample": F.lit(whole.train_metrics["r2"]).cast("double")}))
    return reduce(DataFrame.unionByName, parts)
