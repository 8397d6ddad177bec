"""Model queries: fit, forecast, intervals, validation, backtest, studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as bl
from ..operators import features as ft
from ..plans import forecast as fc
from ..plans import pipelines, validation
from ..plans.models import ModelFactory
from ..session import materialise
from . import fixtures as fx
from . import register, rounded
from .fixtures import r, sql
from .panel_queries import design

RIDGE = ModelFactory("Ridge")
FOREST = ModelFactory("RandomForest", overrides={"numTrees": 30, "maxDepth": 6})
#: the case tables start a year after the grid does: leave two years for training
TRAIN_WEEKS = 104


def _fitted(spark, sf, factory=RIDGE, **options):
    panel, builder = materialise(fx.panel(spark, sf)), design(spark, sf)
    return panel, builder, fc.fit_pipeline(panel, builder, factory, **options)


@register(sql(f"""SELECT variable, {r('coalesce(quantile_cont(v, 0.5), 0)')} AS median FROM (
    SELECT unnest(['cases_lag_1', 'cases_lag_52', 'cases_ma_13', 'superficie_km2', 'empty']) AS variable, unnest([l1, l52, m13, superficie_km2, NULL]) AS v FROM (
    SELECT *, lag(cases, 1) OVER w AS l1, lag(cases, 52) OVER w AS l52, avg(cases) OVER (w ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS m13
    FROM panel JOIN population USING (health_area) WINDOW w AS (PARTITION BY health_area ORDER BY week_index)) WHERE l1 IS NOT NULL) GROUP BY 1""", "panel", "population"))
def median_imputer(spark, sf):
    df = ft.add_temporal_features(fx.panel(spark, sf), lags=(1, 52), windows=(13,))
    df = ft.join_attributes(df, fx.population(spark, sf)).withColumn("empty", F.lit(None).cast("double"))
    columns = ["cases_lag_1", "cases_lag_52", "cases_ma_13", "superficie_km2", "empty"]
    medians = fc.median_imputer(materialise(fc.training_rows(df, columns).select(*columns)), columns)
    return rounded(spark.createDataFrame(list(medians.items()), "variable string, median double"))


@register()
def forecast_model(spark, sf):
    panel, builder, fitted = _fitted(spark, sf, FOREST)
    return rounded(fc.recursive_forecast(fitted, panel, 4, builder))


@register()
def forecast_intervals(spark, sf):
    panel, builder, fitted = _fitted(spark, sf)
    return rounded(fc.predict_quantiles(fitted, fc.recursive_forecast(fitted, panel, 4, builder)))


@register(sql("", "lagged", "forecast").rstrip() + f""",
    q AS (SELECT quantile_cont(cases - lag1, 0.1) AS lo, quantile_cont(cases - lag1, 0.9) AS hi FROM lagged WHERE lag1 IS NOT NULL)
    SELECT health_area, horizon, predicted_cases, {r('greatest(predicted_cases + lo * (1 + 0.12 * (horizon - 1)), 0)')} AS q10,
    {r('greatest(predicted_cases + hi * (1 + 0.12 * (horizon - 1)), 0)')} AS q90 FROM forecast, q""")
def interval_widths(spark, sf):
    """Intervals around the seasonal forecast from the residuals of last week's value."""
    panel = fx.panel(spark, sf)
    rows = bl.baseline_predictions(panel)
    fitted = fc.Fitted(None, "persistance", [], {}, residuals=rows.select((F.col("cases") - F.col(bl.PERSISTENCE)).alias("residual")))
    out = fc.predict_quantiles(fitted, fx.naive_forecast(panel))
    return rounded(out.select("health_area", "horizon", "predicted_cases", "q10", "q90"))


@register()
def importance(spark, sf):
    return rounded(fc.feature_importance(spark, _fitted(spark, sf, FOREST)[2]))


@register()
def glm_poisson(spark, sf):
    """Poisson regression with the exposure as offset."""
    fitted = _fitted(spark, sf, ModelFactory("XGBoost", "poisson"), objective="poisson", exposure=True)[2]
    return rounded(fc.feature_importance(spark, fitted))


@register()
def blocked_cv(spark, sf):
    panel = materialise(fx.panel(spark, sf))
    return rounded(validation.temporal_validation(panel, design(spark, sf), RIDGE)["folds"])


@register()
def row_order_cv(spark, sf):
    """The leaking row-order validation, for comparison with ``blocked_cv``."""
    return validation.row_order_validation(materialise(fx.panel(spark, sf)), RIDGE)["folds"]


@register()
def backtest_model(spark, sf):
    panel = fx.panel(spark, sf)
    return rounded(validation.backtest(panel, design(spark, sf), RIDGE, min_train_weeks=TRAIN_WEEKS))


@register()
def ablation_study(spark, sf):
    panel = materialise(fx.panel(spark, sf))
    return rounded(validation.ablations(panel, design(spark, sf), RIDGE, horizons=(1, 4), min_train_weeks=TRAIN_WEEKS))


@register()
def objective_study(spark, sf):
    panel = materialise(fx.panel(spark, sf))
    return rounded(validation.objectives(
        panel, design(spark, sf), lambda objective: ModelFactory("XGBoost", "poisson") if objective == "poisson" else RIDGE,
        min_train_weeks=TRAIN_WEEKS))


@register()
def leakage_study(spark, sf):
    return rounded(validation.leakage_study(materialise(fx.panel(spark, sf)), fx.static_population(spark, sf), RIDGE))


@register()
def pca(spark, sf):
    df, columns = design(spark, sf, with_climate=False)(fx.panel(spark, sf))
    rows, info = fc.perform_pca_analysis(materialise(df.select("health_area", "week_index", *columns)), columns)
    explained = [(i + 1, float(v)) for i, v in enumerate(info["explained_variance"])]
    return rounded(spark.createDataFrame(explained, "component int, explained double"))


@register()
def measles_pipeline(spark, sf):
    """Case list to forecast under the measles column names."""
    cases = fx.linelist(spark, sf)
    enriched = fx.static_population(spark, sf).join(fx.vaccination(spark, sf), "health_area", "left").withColumnsRenamed(
        {"taux_vaccination": "Taux_Vaccination", "Pop_Enfants_0_14": "Pop_Enfants"})
    panel, builder, _ = pipelines.prepare_measles(cases, enriched, fx.area_polygons(spark, sf))
    fitted = fc.fit_pipeline(panel, builder, RIDGE)
    ahead = fc.predict_quantiles(fitted, fc.recursive_forecast(fitted, panel, 3, builder))
    return rounded(pipelines.measles_columns(ahead))


@register()
def malaria_report(spark, sf):
    """Figures of a full malaria run (fit, validation, forecast, diagnostics)."""
    cases = fx.cases_weekly(spark, sf)
    panel, builder, _ = pipelines.prepare_malaria(cases, fx.area_polygons(spark, sf), fx.static_population(spark, sf), n_clusters=3)
    results = pipelines.run_modelling(panel, builder, "Ridge")
    return pipelines.report_tables(results, cases)["parameters"]
