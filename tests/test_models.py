import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import isoweek as iso
from panelcast.operators import diagnostics
from panelcast.operators import features as ft
from panelcast.plans import forecast as fc
from panelcast.plans import models, pipelines, validation
from panelcast.session import materialise


@pytest.fixture(scope="module")
def builder(small_static, small_weights):
    return ft.DesignBuilder(static_df=small_static, neighbour_weights=small_weights)


@pytest.fixture(scope="module")
def ridge(small_panel, builder):
    return fc.fit_pipeline(small_panel, builder, models.ModelFactory("Ridge"))


@pytest.fixture(scope="module")
def ahead(ridge, small_panel):
    return materialise(fc.recursive_forecast(ridge, small_panel, 3))


def test_registry(spark):
    assert len(models.available_models()) >= 7
    for name in models.available_models():
        assert models.make_model(name).hasParam("labelCol") and models.describe_model(name)
    with pytest.raises(KeyError):
        models.make_model("nope")
    assert models.resolve_objective("Ridge", "poisson") == "squared_error" and models.resolve_objective("XGBoost", "poisson") == "poisson"
    assert "GeneralizedLinear" in type(models.make_model("LightGBM", "poisson")).__name__
    assert pipelines.choose_factory("RandomForest", "poisson")[1] and not pipelines.choose_factory("XGBoost", "poisson")[1]


def test_imputer_keeps_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (float("nan"), None), (4.0, None), (7.0, None)], "a double, b double")
    assert fc.median_imputer(df, ["a", "b"]) == {"a": 3.0, "b": 0.0}


def test_forecast_shape_and_scale(ahead, small_panel):
    rows = ahead.toPandas()
    assert len(rows) == 36 and rows["predicted_cases"].min() >= 0 and set(rows["horizon"]) == {1, 2, 3}
    assert (rows["week_num"] == rows["week_index"]).all() and rows["period"].str.match(r"\d{4}-S\d\d").all()
    drift = diagnostics.drift_report(small_panel, ahead, 8).first()
    assert 0.5 < drift["area_ratio_median"] < 2


def test_bounded_state_equals_full_rebuild(ridge, ahead, small_panel, builder):
    last = small_panel.agg(F.max("week_index")).first()[0]
    fixed = ft.DesignBuilder(**{**builder.__dict__, "feature_cols": ridge.feature_cols})
    history = small_panel.withColumn("cases_is_forecast", F.lit(False))
    for h in (1, 2, 3):
        year, week = iso.week_index_to_iso(F.lit(last + h), 2019)
        new = small_panel.select("health_area").distinct().select(
            "health_area", year.alias("year"), week.alias("week_"), F.lit(last + h).alias("week_index"),
            F.lit(None).cast("double").alias("cases"), F.lit(True).alias("cases_is_forecast"))
        longer = history.unionByName(new, allowMissingColumns=True)
        matrix, _ = fixed(longer)
        step = materialise(ridge.predict(matrix.where(F.col("week_index") == last + h)).select(
            "health_area", "week_index", F.col("predicted_cases").alias("full")))
        gap = step.join(ahead, ["health_area", "week_index"]).agg(F.max(F.abs(F.col("full") - F.col("predicted_cases"))), F.count("*")).first()
        assert gap[1] == 12 and gap[0] < 1e-9
        history = materialise(longer.join(step, ["health_area", "week_index"], "left").withColumn("cases", F.coalesce("full", "cases")).drop("full"))


def test_tree_origins_equal_single_forecasts(small_panel, builder):
    factory = models.ModelFactory("RandomForest", overrides={"numTrees": 5, "maxDepth": 4})
    matrix, columns = validation.design_once(small_panel, builder)
    fits = {o: fc.fit_matrix(matrix.where(F.col("week_index") <= o), columns, factory, diagnostics=False) for o in (100, 120)}
    both = fc.forecast_origins(fits, small_panel, 2, builder).toPandas().set_index(["origin", "health_area", "horizon"])["predicted_cases"]
    alone = fc.forecast_origins({100: fits[100]}, small_panel, 2, builder).toPandas().set_index(["origin", "health_area", "horizon"])["predicted_cases"]
    assert np.allclose(both.loc[alone.index], alone) and len(both) == 48


def test_intervals_widen_and_contain(ridge, ahead):
    out = fc.predict_quantiles(ridge, ahead).toPandas()
    assert (out["q10"] <= out["predicted_cases"]).all() and (out["q90"] >= out["predicted_cases"]).all() and (out["q10"] >= 0).all()
    width = (out["q90"] - out["predicted_cases"]).groupby(out["horizon"]).mean()
    assert width[3] == pytest.approx(width[1] * 1.24)


def test_interval_sign_follows_the_skew(spark, ahead):
    residuals = spark.createDataFrame([(float(v),) for v in [0] * 20 + [50] * 5], "residual double")
    skewed = fc.Fitted(None, "x", [], {}, residuals=residuals)
    out = fc.predict_quantiles(skewed, ahead.where("horizon = 1")).toPandas()
    assert np.allclose(out["q90"] - out["predicted_cases"], 50) and np.allclose(out["q10"], out["predicted_cases"])
    few = fc.Fitted(None, "x", [], {}, residuals=residuals.limit(5))
    assert np.allclose(fc.predict_quantiles(few, ahead).toPandas()["q90"], ahead.toPandas()["predicted_cases"])


def test_importance_shares(spark, ridge):
    table = fc.feature_importance(spark, ridge, 5).collect()
    assert len(table) == 5 and table[0]["importance"] >= table[4]["importance"] and table[0]["type"] == "coef_abs"


def test_log_target_and_poisson(small_panel, builder):
    for factory, options in ((models.ModelFactory("Ridge"), {"log_target": True}), (models.ModelFactory("XGBoost", "poisson"), {"objective": "poisson"})):
        fitted = fc.fit_pipeline(small_panel, builder, factory, feature_cols=["cases_lag_1", "cases_ma_4", "sin_week_1"], **options)
        assert fitted.train_metrics["r2"] > 0.3
        assert fc.recursive_forecast(fitted, small_panel, 1, builder).agg(F.min("predicted_cases")).first()[0] >= 0


def test_short_history_is_refused(small_panel, builder):
    with pytest.raises(ValueError):
        fc.fit_pipeline(small_panel.where("week_index < 1"), builder, models.ModelFactory("Ridge"), feature_cols=["cases_lag_1"])
    with pytest.raises(ValueError):
        validation.backtest(small_panel.where("week_index < 40"), builder, models.ModelFactory("Ridge"))


def test_blocked_validation_beats_chance(small_panel, builder):
    out = validation.temporal_validation(small_panel, builder, models.ModelFactory("Ridge"), n_splits=3)
    assert out["n_splits"] == 3 and out["cv_r2_mean"] > 0.5
    assert set(out["folds"].columns) >= {"fold", "mae", "r2", "train_weeks", "test_weeks"} and out["pooled"].first()["n"] > 500


def test_backtest_has_model_baselines_and_skill(small_panel, builder):
    rows = {(r["modele"], r["horizon"]): r for r in validation.backtest(
        small_panel, builder, models.ModelFactory("Ridge"), horizons=(1, 2), n_origins=3, min_train_weeks=60).collect()}
    assert set(m for m, _ in rows) == {"Ridge", "persistance", "saisonnier_naif", "moyenne_aire"}
    assert rows[("Ridge", 1)]["skill_mae_vs_baseline"] > 0 and rows[("Ridge", 1)]["n"] == 36


def test_leak_inflates_the_score(small_panel, small_static):
    rows = {(r["protocol"], r["split"]): r for r in validation.leakage_study(small_panel, small_static, models.ModelFactory("Ridge"), n_splits=3).collect()}
    assert rows[("toutes les fuites", "temporel")]["mae"] < rows[("sans fuite", "temporel")]["mae"]


def test_pca_keeps_the_threshold(small_panel):
    df = ft.add_seasonality(ft.add_temporal_features(small_panel, lags=(1, 2), windows=(4,)))
    out, info = fc.perform_pca_analysis(df, ["cases_lag_1", "cases_lag_2", "cases_ma_4", "sin_week_1"], 0.9)
    assert info["total_variance_explained"] >= 0.9 and info["n_components"] < 4 and "PC1" in out.columns
    with pytest.raises(ValueError):
        fc.perform_pca_analysis(df, ["cases_lag_1"])


def test_full_run_has_the_contract(spark, small_panel, small_static):
    from panelcast.functions import geo
    boxes = spark.createDataFrame([(f"area_{a:02d}", float(a % 4), float(a // 4)) for a in range(12)], "health_area string, x double, y double")
    layer = boxes.select("health_area", F.array(F.array(geo.box_ring("x", "y", F.col("x") + 1, F.col("y") + 1))).alias("polygons"))
    cases = small_panel.where("cases > 0").select("health_area", "year", "week_", "cases", "deaths")
    panel, builder, summary = pipelines.prepare_malaria(cases, layer, small_static, n_clusters=3)
    results = pipelines.run_modelling(panel, builder, "Ridge", n_future_weeks=2, n_splits=3, with_backtest=True, backtest_origins=2)
    assert set(results.df_future.columns) == {"health_area", "year", "week_", "week_index", "period", "horizon", "predicted_cases", "week_num", "q10", "q90"}
    assert results.df_future.count() == 24 and results.metrics["cv_r2_mean"] is not None and "spatial_lag_1" in results.feature_cols
    assert results.backtest.count() > 0 and results.climat_invariant == []
    tables = pipelines.report_tables(results, cases, small_static)
    assert set(tables) >= {"indicators", "top_areas", "parameters", "folds", "importance", "forecast", "areas"}
    renamed = pipelines.measles_columns(results.df_future)
    assert {"Aire_Sante", "SemaineLabel", "CasPredits", "Q10", "Q90"} <= set(renamed.columns)
