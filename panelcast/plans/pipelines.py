"""Disease pipelines: prepare, model and collect the result tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import isoweek as iso
from ..functions.scalars import settle
from ..operators import features as ft
from ..operators import kpi, linelist
from ..operators.panel import build_panel, panel_summary
from ..operators.spatial import area_geometry, build_neighbour_weights, spatial_clusters
from ..session import materialise
from . import forecast as fc
from . import validation as va
from .models import DEFAULT_MODEL, ModelFactory, resolve_objective

# Cut of the report tables.
REPORT_ROWS = {"areas": 25, "forecast": 30, "importance": 25}


@dataclass
class Results:
    """Tables (lazy DataFrames) and figures of one modelling run."""

    df_future: DataFrame
    metrics: dict
    feature_cols: list[str]
    feature_dynamics: DataFrame
    climat_invariant: list[str]
    cv_folds: DataFrame | None
    importance: DataFrame
    df_model: DataFrame
    fitted: fc.Fitted
    backtest: DataFrame | None = None
    extras: dict = field(default_factory=dict)


def build_static_table(population: DataFrame | None = None, zonal: DataFrame | None = None,
                       environment: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """One static table per area; earlier tables win, later ones fill gaps."""
    return kpi.merge_static_tables(population, zonal, environment, extra)


def make_design_builder(layer: DataFrame | None, static_df: DataFrame | None, climate_df: DataFrame | None = None,
                        use_spatial: bool = True, neighbour_k: int = 5, n_clusters: int = 5,
                        groups: Sequence[str] = ft.DEFAULT_GROUP_ORDER, lags: Sequence[int] = ft.DEFAULT_LAGS,
                        extra_static: Sequence[str] | None = None, climate_availability_lag: int = 0) -> ft.DesignBuilder:
    """The single feature builder of fit and forecast; ``layer`` holds ``health_area, polygons``."""
    geometry = materialise(area_geometry(layer)) if layer is not None else None
    weights = clusters = None
    if geometry is not None and use_spatial:
        weights = build_neighbour_weights(geometry, neighbour_k)
        if n_clusters and geometry.limit(n_clusters).count() >= n_clusters:
            clusters = spatial_clusters(geometry, n_clusters)
    attributes = geometry.select("health_area", "latitude", "longitude", "Superficie_km2") if geometry is not None else None
    return ft.DesignBuilder(static_df=static_df, climate_df=climate_df, geometry=attributes, neighbour_weights=weights,
                            clusters=clusters, groups=tuple(groups), lags=tuple(lags), extra_static=extra_static,
                            climate_availability_lag=climate_availability_lag).prepared()


def prepare_malaria(cases: DataFrame, layer: DataFrame | None = None, population: DataFrame | None = None,
                    zonal: DataFrame | None = None, environment: DataFrame | None = None, climate: DataFrame | None = None,
                    years: Sequence[int] | None = None, areas: Sequence[str] | None = None, **options
                    ) -> tuple[DataFrame, ft.DesignBuilder, DataFrame]:
    """Panel, feature builder and summary of the malaria pipeline."""
    panel = materialise(build_panel(cases, years=years, areas=areas))
    tables = [t for t in (population, zonal, environment) if t is not None]
    static = build_static_table(population, zonal, environment) if tables else None
    return panel, make_design_builder(layer, static, climate, **options), panel_summary(panel)


def measles_static(enriched: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Static table of the measles pipeline from the enriched layer and the case list."""
    table = kpi.vaccination_features(enriched)
    if cases is not None and "statut_vaccinal" in cases.columns:
        share = linelist.unvaccinated_share_of_known(cases)
        table = table.drop("Part_NonVaccines_Cas").join(share, "health_area", "left")
    elif "Part_NonVaccines_Cas" not in table.columns:
        table = table.withColumn("Part_NonVaccines_Cas", F.lit(None).cast("double"))
    if "Pop_Enfants" in table.columns and "Pop_Enfants_0_14" not in table.columns:
        table = table.withColumn("Pop_Enfants_0_14", F.col("Pop_Enfants"))
    return table


def prepare_measles(cases: DataFrame, enriched: DataFrame, layer: DataFrame | None = None, **options
                    ) -> tuple[DataFrame, ft.DesignBuilder, DataFrame]:
    """Weekly panel from a case list (``health_area, year, week_, ...``) and its builder."""
    weekly = cases.groupBy("health_area", "year", "week_").agg(F.count(F.lit(1)).alias("cases")).withColumn("deaths", F.lit(0))
    panel = materialise(build_panel(weekly))
    static = measles_static(enriched, cases)
    numeric = [c for c, t in static.dtypes if c == "health_area" or t in ("double", "float", "int", "bigint")]
    builder = make_design_builder(layer, static.select(*numeric), extra_static=ft.MEASLES_STATIC, **options)
    return panel, builder, panel_summary(panel)


def choose_factory(algo: str, objective: str) -> tuple[ModelFactory, bool]:
    """Factory and whether a log1p target stands in for an unsupported Poisson objective."""
    if objective == "poisson" and resolve_objective(algo, objective) != "poisson":
        return ModelFactory(algo), True
    return ModelFactory(algo, objective), False


def run_modelling(panel: DataFrame, design_builder: ft.DesignBuilder, algo: str = DEFAULT_MODEL, n_future_weeks: int = 4,
                  objective: str = "squared_error", n_splits: int = 5, embargo: int = 4,
                  quantile_levels: Sequence[float] = (0.1, 0.9), with_backtest: bool = False, backtest_origins: int = 6,
                  factory: Callable | None = None) -> Results:
    """Fit, blocked validation, recursive forecast with intervals, diagnostics, optional backtest."""
    chosen, log_target = choose_factory(algo, objective)
    factory = factory or chosen
    fitted = fc.fit_pipeline(panel, design_builder, factory, objective=objective, log_target=log_target)
    try:
        checked = va.temporal_validation(panel, design_builder, factory, n_splits, embargo, fitted.feature_cols)
    except ValueError:  # too little history: the figures stay empty
        checked = {"folds": None, "cv_r2_mean": None, "cv_r2_std": None, "cv_mae_mean": None, "pooled": None}
    ahead = fc.recursive_forecast(fitted, panel, n_future_weeks, design_builder)
    if quantile_levels:
        ahead = fc.predict_quantiles(fitted, ahead, quantile_levels)
    pooled = checked["pooled"].first().asDict() if checked["pooled"] is not None else {}
    matrix, _ = design_builder(panel)
    dynamics = ft.describe_feature_dynamics(matrix, fitted.feature_cols)
    figures = {
        **{k: fitted.train_metrics.get(k) for k in ("mae", "rmse", "r2")},
        **{k: checked[k] for k in ("cv_r2_mean", "cv_r2_std", "cv_mae_mean")},
        "cv_r2_pool": pooled.get("r2"), "cv_mae_pool": pooled.get("mae"), "n_train": fitted.n_train,
        "n_features": len(fitted.feature_cols), "algorithme": algo,
        "objectif": "log1p+squared_error" if log_target else objective, "horizon_semaines": n_future_weeks,
        "embargo": embargo}
    results = Results(ahead, figures, fitted.feature_cols, dynamics,
                      ft.invariant_climate_variables(matrix, fitted.feature_cols), checked["folds"],
                      fc.feature_importance(panel.sparkSession, fitted, 30), matrix, fitted)
    if with_backtest:
        horizons = sorted({h for h in (1, 2, 4, 8) if h <= n_future_weeks} or {1})
        weeks = panel.select("week_index").distinct().count()
        results.backtest = va.backtest(panel, design_builder, factory, horizons, backtest_origins,
                                       min(52, max(20, weeks // 2)), objective=objective, log_target=log_target)
    return results


def measles_columns(forecast: DataFrame) -> DataFrame:
    """Forecast under the names of the measles exports."""
    return forecast.select(
        F.col("health_area").alias("Aire_Sante"), F.col("period").alias("SemaineLabel"), F.col("week_").alias("SemaineEpi"),
        F.col("year").alias("Annee"), iso.sort_key("year", "week_").alias("sort_key"),
        settle("predicted_cases", 1).alias("CasPredits"), F.col("q10").alias("Q10"), F.col("q90").alias("Q90"),
        F.col("horizon").alias("Horizon"))


def report_tables(results: Results, cases: DataFrame, layer: DataFrame | None = None) -> Mapping[str, DataFrame]:
    """The data behind the printed report: indicators, top areas, folds, areas, importances, forecast."""
    spark = cases.sparkSession
    rows = [(k, None if v is None else str(v)) for k, v in results.metrics.items()]
    tables = {
        "indicators": kpi.kpi_malaria(cases),
        "top_areas": kpi.top_areas(kpi.area_totals(cases), "cases", REPORT_ROWS["areas"]),
        "parameters": spark.createDataFrame(rows, "name string, value string"),
        "folds": results.cv_folds,
        "importance": results.importance.limit(REPORT_ROWS["importance"]),
        "forecast": results.df_future.orderBy(F.desc("predicted_cases"), "health_area", "week_index").limit(REPORT_ROWS["forecast"]),
        "dynamics": results.feature_dynamics,
        "backtest": results.backtest,
    }
    if layer is not None:
        tables["areas"] = kpi.layer_with_cases(layer, cases).orderBy(F.desc("cases"), "health_area").limit(REPORT_ROWS["areas"])
    return {k: v for k, v in tables.items() if v is not None}
