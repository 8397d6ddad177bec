"""Fit, recursive forecast, intervals and importance.

The forecast carries one bounded row per area (as many values as its features need) instead of
rebuilding the panel at every step, and several rolling origins advance together:
a step is one Spark job for all origins and areas.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isoweek as iso
from ..functions.scalars import clip, finite
from ..operators import features as ft
from ..operators.metrics import metric_columns
from ..operators.panel import origin_of
from ..operators.quantiles import exact_quantiles
from ..session import materialise

HISTORY = ft.EWM_HISTORY
HORIZON_PENALTY = 0.12
MIN_RESIDUALS = 20


# ---------------------------------------------------------------------------
# imputation and fit
# ---------------------------------------------------------------------------
def median_imputer(train: DataFrame, columns: Sequence[str], written: bool = False) -> dict[str, float]:
    """Exact training median per column; a column without values gives 0."""
    cleaned = train.select(*[finite(c).alias(c) for c in columns])
    found = exact_quantiles(cleaned, columns, [0.5], written)
    return {c: found[c][0] if found[c][0] is not None else 0.0 for c in columns}


def _vector(values: Column, medians: Sequence[float]) -> Column:
    """``features`` vector of an array of values; missing and not finite ones are imputed.

    One higher-order expression whatever the number of features, so the generated
    code stays small for wide matrices.
    """
    fill = F.array(*[F.lit(float(m)) for m in medians])
    return array_to_vector(F.zip_with(values, fill, lambda v, m: F.coalesce(finite(v), m)))


def assemble(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Add the imputed ``features`` vector in the order of ``medians``."""
    return df.withColumn("features", _vector(F.array(*[F.col(c).cast("double") for c in medians]), list(medians.values())))


@dataclass
class Fitted:
    model: Model
    model_name: str
    feature_cols: list[str]
    medians: dict[str, float]
    objective: str = "squared_error"
    log_target: bool = False
    n_train: int = 0
    residual_std: float = 0.0
    train_metrics: dict = field(default_factory=dict)
    residuals: DataFrame | None = None
    design_builder: Callable | None = None
    exposure: bool = False

    def predict(self, df: DataFrame, name: str = "predicted_cases") -> DataFrame:
        """Add the prediction: counts, never negative, 0 when not finite."""
        return self._score(assemble(df, self.medians), name)

    def predict_array(self, df: DataFrame, columns: Sequence[str], values: str = "values",
                      name: str = "predicted_cases") -> DataFrame:
        """Predict from one array column that holds ``columns`` in order (null = missing)."""
        places = F.array(*[F.lit(columns.index(c) + 1) for c in self.medians])
        chosen = F.transform(places, lambda i: F.element_at(F.col(values), i))
        return self._score(df.withColumn("features", _vector(chosen, list(self.medians.values()))), name)

    def _score(self, df: DataFrame, name: str) -> DataFrame:
        out = self.model.transform(df).drop("features")
        raw = F.expm1(F.col("prediction")) if self.log_target else F.col("prediction")
        return out.withColumn(name, F.greatest(F.coalesce(finite(raw), F.lit(0.0)), F.lit(0.0))).drop("prediction")


def training_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose first lag is known."""
    return df.where(F.col("cases_lag_1").isNotNull()) if "cases_lag_1" in df.columns else df


def fit_matrix(matrix: DataFrame, columns: Sequence[str], model_factory: Callable, objective: str = "squared_error",
               log_target: bool = False, sample_weight_col: str | None = None, exposure: bool = False,
               parity_residuals: bool = False, diagnostics: bool = True) -> Fitted:
    """Fit on the rows of a design matrix: imputer, model, residuals, in-sample measures."""
    n = matrix.count()
    if n < 10:
        raise ValueError(f"training is impossible: {n} usable rows")
    medians = median_imputer(matrix, columns, written=True)
    label = F.col("cases").cast("double")
    data = assemble(matrix, medians).withColumn("label", F.log1p(label) if log_target else label)
    estimator = model_factory()
    if sample_weight_col and sample_weight_col in matrix.columns:
        data = data.withColumn("_weight", F.coalesce(F.col(sample_weight_col).cast("double"), F.lit(1.0)))
        estimator = estimator.copy({estimator.weightCol: "_weight"})
    if exposure and estimator.hasParam("offsetCol") and "log_exposure" in matrix.columns:
        estimator = estimator.copy({estimator.offsetCol: "log_exposure"})
    keep = [c for c in ("features", "label", "_weight", "log_exposure") if c in data.columns]
    model = estimator.fit(data.select(*keep))
    fitted = Fitted(model, type(model).__name__, list(columns), medians, objective, log_target, n, exposure=exposure)
    if diagnostics:
        error = F.col("predicted_cases") - F.col("cases") if parity_residuals else F.col("cases") - F.col("predicted_cases")
        scored = materialise(fitted.predict(matrix).select("cases", "predicted_cases"))
        fitted.residuals = scored.select(error.alias("residual"))
        row = scored.agg(*metric_columns("cases", "predicted_cases"), F.stddev_pop(error).alias("_std")).first().asDict()
        fitted.residual_std = row.pop("_std") or 0.0
        fitted.train_metrics = row
    return fitted


def fit_pipeline(panel: DataFrame, design_builder: Callable, model_factory: Callable,
                 feature_cols: Sequence[str] | None = None, objective: str = "squared_error", log_target: bool = False,
                 min_history_ratio: float = 0.5, sample_weight_col: str | None = None, exposure: bool = False,
                 parity_residuals: bool = False) -> Fitted:
    """Design matrix, median imputer and model on the given panel.

    ``min_history_ratio`` is kept for signature compatibility: rows without the first
    lag are never usable, whatever their share.  The pruned matrix is written once,
    because training reads it many times.
    """
    if sample_weight_col:
        df, columns = design_builder(panel)
        columns = [c for c in (feature_cols or columns) if c in df.columns]
        extra = [c for c in (sample_weight_col, "log_exposure", "cases_lag_1") if c in df.columns and c not in columns]
        matrix = materialise(df.select("health_area", "week_index", "cases", *columns, *extra))
    else:
        matrix, columns = ft.written_matrix(panel, design_builder, feature_cols)
    matrix = training_rows(matrix, columns)
    fitted = fit_matrix(matrix, columns, model_factory, objective, log_target, sample_weight_col, exposure, parity_residuals)
    fitted.design_builder = design_builder
    return fitted


# ---------------------------------------------------------------------------
# recursive forecast
# ---------------------------------------------------------------------------
def features_from_history(hist: Column, lags: Sequence[int], windows: Sequence[int]) -> dict[str, Column]:
    """The temporal features of the next week from the array of past values (oldest first).

    Counterpart of ``add_temporal_features`` for one bounded row per area.
    """
    def back(k: int) -> Column:
        return F.try_element_at(hist, F.lit(-k))

    def tail(w: int) -> Column:
        n = F.least(F.size(hist), F.lit(w))
        return F.slice(hist, F.size(hist) - n + 1, n)

    def mean(values: Column) -> Column:
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))

    last4 = tail(4)
    centre = mean(last4)
    spread = F.aggregate(F.transform(last4, lambda x: (x - centre) * (x - centre)), F.lit(0.0), lambda a, x: a + x)
    new = {f"cases_lag_{k}": back(k) for k in lags}
    new |= {f"cases_ma_{w}": mean(tail(w)) for w in windows}
    new["cases_std_4"] = F.when(F.size(last4) >= 2, F.sqrt(spread / (F.size(last4) - 1)))
    new["cases_max_4"] = F.array_max(last4)
    new["cases_ewm_4"] = ft.ewm_of(tail(HISTORY))
    new["growth_rate"] = ft.growth(back(1), back(2))
    new["cases_diff_1"] = back(1) - back(2)
    return new


def _future_rows(panel: DataFrame, origins: Sequence[int], horizons: int, origin_year: int) -> DataFrame:
    """(origin, health_area, horizon, week_index, year, week_) of every week to predict."""
    areas = panel.select("health_area").distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(int(o)).alias("origin"), F.lit(h).alias("horizon"))
                                for o in origins for h in range(1, horizons + 1)]))
    grid = areas.select("health_area", steps.alias("_s")).select("health_area", "_s.origin", "_s.horizon")
    grid = grid.withColumn("week_index", (F.col("origin") + F.col("horizon")).cast("int"))
    year, week = iso.week_index_to_iso("week_index", origin_year)
    return grid.withColumns({"year": year, "week_": week})


def exogenous_rows(panel: DataFrame, origins: Sequence[int], horizons: int, builder: ft.DesignBuilder,
                   columns: Sequence[str]) -> DataFrame:
    """Features of the weeks to predict that do not depend on predictions."""
    first_year = origin_of(panel)
    future = _future_rows(panel, origins, horizons, first_year)
    df = ft.add_seasonality(future)
    df = ft.add_static_features(df, builder.static_df, builder.geometry)
    wants = set(columns)
    if wants & set(ft.FEATURE_GROUPS["climate"]) and builder.climate_df is not None:
        weeks = future.select("health_area", "year", "week_", "week_index").distinct()
        reach = max(7, 4) + builder.climate_availability_lag + 1
        past = panel.where(F.col("week_index") > min(origins) - reach).select("health_area", "year", "week_", "week_index")
        line = past.unionByName(weeks).distinct()
        weather = ft.add_climate_features(line, builder.climate_df, availability_lag=builder.climate_availability_lag)
        df = df.join(weather.drop("year", "week_"), ["health_area", "week_index"], "left")
    if builder.clusters is not None and "spatial_cluster" in wants:
        df = df.join(ft.one_row_per_area(builder.clusters.select("health_area", F.col("spatial_cluster").cast("double")
                                                                 .alias("spatial_cluster"))), "health_area", "left")
    if "coef_population" in wants and "Pop_Totale" in df.columns:
        static = ft.add_static_features(panel.select("health_area", "year", "week_", "week_index", "cases"), builder.static_df)
        edge = ft.with_population_coefficient(static, builder.parity).where(F.col("week_index").isin([int(o) for o in origins]))
        wide = materialise(edge.select(*[F.when(F.col("week_index") == int(o), F.col("coef_population")).alias(f"o{o}") for o in origins]))
        medians = exact_quantiles(wide, [f"o{o}" for o in origins], [0.5], written=True)
        coef = F.lit(None).cast("double")
        for o in origins:
            coef = F.when(F.col("origin") == int(o), F.lit(medians[f"o{o}"][0])).otherwise(coef)
        df = df.withColumn("coef_population", coef)
    exposure = F.lit(0.0)
    if "Pop_Totale" in df.columns:
        exposure = F.log(F.greatest(F.col("Pop_Totale").cast("double"), F.lit(1.0)))
    needed = {*columns, "origin", "health_area", "horizon", "Pop_Totale", "Pop_Enfants_0_14", "Densite_Pop"}
    return df.select(*[c for c in df.columns if c in needed and c != "log_exposure"], exposure.alias("log_exposure"))


def history_depth(builder: ft.DesignBuilder) -> int:
    """Values of an area that the features of its next week need."""
    return max(HISTORY, *builder.lags, *builder.windows)


def _start_state(panel: DataFrame, origins: Sequence[int], depth: int) -> DataFrame:
    """(origin, health_area, hist, preds): the last ``depth`` values of each area before each origin."""
    week = F.col("week_index")
    near = F.filter(F.array(*[F.lit(int(o)) for o in origins]), lambda o: (week <= o) & (week > o - depth))
    recent = panel.select("health_area", "week_index", F.col("cases").cast("double").alias("cases"), F.explode(near).alias("origin"))
    ordered = F.array_sort(F.collect_list(F.struct("week_index", "cases")))
    return recent.groupBy("origin", "health_area").agg(F.transform(ordered, lambda s: s["cases"]).alias("hist")).withColumn(
        "preds", F.expr("cast(array() as array<double>)"))


def score_origins(fits: dict[int, Fitted], rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Predict each row with the model of its origin.

    Linear models are one table of coefficients (a row per origin) joined to the
    rows, so any number of origins is a single expression.  Other models score
    their own slice of the rows, which are written first so that the slices do not
    recompute them.
    """
    if all(hasattr(f.model, "coefficients") and not f.exposure for f in fits.values()):
        table = rows.sparkSession.createDataFrame(
            [(int(o), [columns.index(c) + 1 for c in f.medians], [float(m) for m in f.medians.values()],
              [float(v) for v in f.model.coefficients.toArray()], float(f.model.intercept), f.objective == "poisson", f.log_target)
             for o, f in fits.items()],
            "origin int, _at array<int>, _m array<double>, _w array<double>, _b double, _exp boolean, _log boolean")
        chosen = F.transform("_at", lambda i: F.element_at(F.col("values"), i))
        filled = F.zip_with(chosen, F.col("_m"), lambda v, m: F.coalesce(v, m))
        linear = F.aggregate(F.zip_with(filled, F.col("_w"), lambda v, w: v * w), F.col("_b"), lambda a, x: a + x)
        raw = F.when(F.col("_exp"), F.exp(linear)).when(F.col("_log"), F.expm1(linear)).otherwise(linear)
        scored = rows.join(F.broadcast(table), "origin")  # one row per origin, a dozen
        return scored.withColumn("predicted_cases", F.greatest(F.coalesce(finite(raw), F.lit(0.0)), F.lit(0.0))).drop(
            "_at", "_m", "_w", "_b", "_exp", "_log")
    rows = materialise(rows)
    return reduce(DataFrame.unionByName, [f.predict_array(rows.where(F.col("origin") == o), columns).select(*rows.columns, "predicted_cases")
                                          for o, f in sorted(fits.items())])


def forecast_origins(fits: dict[int, Fitted], panel: DataFrame, horizons: int, builder: ft.DesignBuilder) -> DataFrame:
    """Recursive forecasts of several origins: ``origin, health_area, horizon, predicted_cases``.

    A step writes the new state, one bounded row per origin and area.
    """
    origins = sorted(fits)
    columns = sorted({c for f in fits.values() for c in f.feature_cols})
    exo = materialise(exogenous_rows(panel, origins, horizons, builder, columns))
    depth = history_depth(builder)
    state = materialise(_start_state(panel, origins, depth))
    edges = None
    if "spatial_lag_1" in columns and builder.neighbour_weights is not None:
        edges = materialise(builder.neighbour_weights.select("health_area", "neighbor", "weight"))
    keys = ["origin", "health_area"]
    for h in range(1, horizons + 1):
        step = state.join(exo.where(F.col("horizon") == h), keys)
        step = step.withColumns(features_from_history(F.col("hist"), builder.lags, builder.windows))
        step = ft.add_population_rates(step, F.col("cases_lag_1"))
        if edges is not None:
            last = state.select("origin", F.col("health_area").alias("neighbor"), F.element_at("hist", -1).alias("_v"))
            mean = F.try_divide(F.sum(F.col("weight") * F.coalesce("_v", F.lit(0.0))), F.sum("weight"))
            lag = edges.join(last, "neighbor").groupBy(*keys).agg(mean.alias("spatial_lag_1"))
            step = step.drop("spatial_lag_1").join(lag, keys, "left")
        have = set(step.columns)
        values = F.array(*[F.col(c).cast("double") if c in have else F.lit(None).cast("double") for c in columns])
        values = F.transform(values, finite)
        scored = score_origins(fits, step.select(*keys, "hist", "preds", "log_exposure", values.alias("values")), columns)
        longer, new = F.concat("hist", F.array("predicted_cases")), F.array("predicted_cases")
        kept = F.least(F.size(longer), F.lit(depth))
        state = materialise(scored.select(
            *keys, F.slice(longer, F.size(longer) - kept + 1, kept).alias("hist"), F.concat("preds", new).alias("preds")))
    return state.select(*keys, F.posexplode("preds").alias("_p", "predicted_cases")).select(
        *keys, (F.col("_p") + 1).alias("horizon"), "predicted_cases")


def label_forecast(rows: DataFrame, origin_year: int, origin_week: int = 1) -> DataFrame:
    """Public forecast columns from ``origin, health_area, horizon, predicted_cases``."""
    index = (F.col("origin") + F.col("horizon")).cast("int")
    year, week = iso.week_index_to_iso(index, origin_year, origin_week)
    return rows.select("health_area", year.alias("year"), week.alias("week_"), index.alias("week_index"),
                       iso.period_label(year, week).alias("period"), "horizon", "predicted_cases", index.alias("week_num"))


def recursive_forecast(fitted: Fitted, panel: DataFrame, horizons: int = 4, design_builder: ft.DesignBuilder | None = None,
                       origin_year: int | None = None, origin_week: int = 1) -> DataFrame:
    """Forecast the weeks after the panel; each step feeds the next."""
    builder = design_builder or fitted.design_builder
    last = int(panel.agg(F.max("week_index")).first()[0])
    rows = forecast_origins({last: fitted}, panel, int(horizons), builder)
    return label_forecast(rows, origin_year or origin_of(panel), origin_week)


def predict_quantiles(fitted: Fitted, forecast: DataFrame, levels: Sequence[float] = (0.1, 0.9),
                      horizon_penalty: float = HORIZON_PENALTY) -> DataFrame:
    """Interval columns ``q10``, ``q90``, ... from the training residuals, wider with the horizon.

    With at least 20 residuals their exact quantile is added, else a normal width.
    """
    residuals = fitted.residuals.where(F.col("residual").isNotNull())
    n = residuals.count()
    steps = F.lit(1.0) + F.lit(horizon_penalty) * (F.col("horizon") - 1)
    widths: dict[float, Column] = {}
    if n >= MIN_RESIDUALS:
        values = exact_quantiles(residuals, ["residual"], list(levels))["residual"]
        widths = {level: F.lit(v) * steps for level, v in zip(levels, values)}
    else:
        sigma = (residuals.agg(F.stddev_pop("residual")).first()[0] or 0.0) if n > 1 else 1.0
        widths = {level: F.lit(NormalDist().inv_cdf(level) * sigma) * F.sqrt(steps) for level in levels}
    return forecast.withColumns({f"q{int(level * 100)}": clip(F.col("predicted_cases") + width, 0.0)
                                 for level, width in widths.items()})


def feature_importance(spark, fitted: Fitted, top_n: int = 25) -> DataFrame:
    """Tree importances or absolute coefficients with their share (one row per feature)."""
    model = fitted.model
    if hasattr(model, "featureImportances"):
        values, kind = model.featureImportances.toArray(), "importance_arbre"
    else:
        values, kind = abs(model.coefficients.toArray()), "coef_abs"
    total = float(values.sum())
    rows = [(c, float(v), kind, round(float(v) / total * 100, 2) if total > 0 else None)
            for c, v in zip(fitted.feature_cols, values)]
    table = spark.createDataFrame(rows, "variable string, importance double, type string, importance_pct double")
    return table.orderBy(F.desc("importance"), "variable").limit(top_n)


# ---------------------------------------------------------------------------
# principal components
# ---------------------------------------------------------------------------
def perform_pca_analysis(df: DataFrame, feature_cols: Sequence[str], explained_variance_threshold: float = 0.95
                         ) -> tuple[DataFrame, dict]:
    """Mean-impute, standardise, keep the fewest components that explain the threshold.

    Returns the rows with ``PC1..PCk`` and a dictionary of the explained variance.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array
    if not 0 < explained_variance_threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    if len(feature_cols) < 2:
        raise ValueError("at least two features are needed")
    means = df.agg(*[F.avg(finite(c)).alias(c) for c in feature_cols]).first().asDict()
    data = assemble(df, {c: means[c] if means[c] is not None else 0.0 for c in feature_cols})
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True).fit(data)
    scaled = scaler.transform(data)
    model = PCA(k=len(feature_cols), inputCol="_scaled", outputCol="_pc").fit(scaled)
    explained = [float(v) for v in model.explainedVariance.toArray()]
    total, k = 0.0, 0
    while k < len(explained) and total < explained_variance_threshold - 1e-12:
        total += explained[k]
        k += 1
    values = vector_to_array(F.col("_pc"))
    out = model.transform(scaled).withColumns({f"PC{i + 1}": values[i] for i in range(k)}).drop("features", "_scaled", "_pc")
    cumulative = [math.fsum(explained[:i + 1]) for i in range(k)]
    return out, {"n_components": k, "explained_variance": explained[:k], "cumulative_variance": cumulative,
                 "components": model.pc.toArray()[:, :k].T.tolist(), "feature_names": list(feature_cols),
                 "total_variance_explained": total}
