import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import baselines as bl
from panelcast.operators import features as ft
from panelcast.operators.panel import build_panel


@pytest.fixture(scope="module")
def matrix(small_panel, small_static, small_weights):
    df, columns = ft.build_design_matrix(small_panel, static_df=small_static, neighbour_weights=small_weights)
    return df.cache(), columns


def test_temporal_features_equal_pandas(small_panel, matrix):
    got = matrix[0].toPandas().sort_values(["health_area", "week_index"]).reset_index(drop=True)
    y = got.groupby("health_area")["cases"]
    prev = y.shift(1)
    by = got["health_area"]
    assert np.allclose(got["cases_lag_13"], y.shift(13), equal_nan=True)
    for name, expected in {
        "cases_ma_8": prev.groupby(by).rolling(8, min_periods=1).mean(), "cases_std_4": prev.groupby(by).rolling(4, min_periods=2).std(),
        "cases_max_4": prev.groupby(by).rolling(4, min_periods=1).max(), "cases_ewm_4": prev.groupby(by).ewm(span=4, min_periods=1).mean(),
    }.items():
        assert np.allclose(got[name], expected.reset_index(level=0, drop=True).sort_index(), equal_nan=True, atol=1e-9), name


def test_gaps_and_nulls_count_calendar_weeks(spark):
    rng = np.random.default_rng(4)
    weeks = [0, 4, 114, *(int(w) for w in np.flatnonzero(rng.random(400) < 0.4) + 115)]
    values = [5.0, 0.0, 7.0, *(float(v) if v % 5 else None for v in rng.integers(0, 40, len(weeks) - 3))]
    values[-90:-5] = [None] * 85  # longer than the stored history
    df = spark.createDataFrame(list(zip(["a"] * len(weeks), weeks, values)), "health_area string, week_index int, cases double")
    got = ft.add_temporal_features(df).toPandas().set_index("week_index").sort_index()
    y = got["cases"].reindex(range(max(weeks) + 1))
    prev = y.shift(1)
    for name, expected in {
        "cases_lag_1": prev, "cases_lag_4": y.shift(4), "cases_ma_4": prev.rolling(4, min_periods=1).mean(), "cases_ma_13": prev.rolling(13, min_periods=1).mean(),
        "cases_std_4": prev.rolling(4, min_periods=2).std(), "cases_max_4": prev.rolling(4, min_periods=1).max(),
        "cases_ewm_4": prev.ewm(span=4, min_periods=1).mean(), "cases_diff_1": prev - y.shift(2),
    }.items():
        assert np.allclose(got[name].astype(float), expected.loc[got.index], equal_nan=True, atol=1e-9), name


def test_no_feature_sees_its_own_week(spark, small_panel, small_static, small_weights, matrix):
    base, columns = matrix
    week = 100
    bumped = small_panel.withColumn("cases", F.when((F.col("health_area") == "area_03") & (F.col("week_index") == week),
                                                    F.col("cases") + 10000).otherwise(F.col("cases")))
    other, _ = ft.build_design_matrix(bumped, static_df=small_static, neighbour_weights=small_weights, feature_cols=columns)
    names = [c for c in columns if c in base.columns]
    a = base.where(f"week_index <= {week}").select("health_area", "week_index", *names)
    b = other.where(f"week_index <= {week}").select("health_area", "week_index", *names)
    assert a.exceptAll(b).count() == 0
    after = other.where(f"week_index = {week + 1} and health_area = 'area_03'").first()
    assert after["cases_lag_1"] > 10000


def test_rates_rebuild_last_week_not_this_one(matrix):
    r = matrix[0].where("cases_lag_1 is not null").agg(
        F.max(F.abs(F.col("incidence_rate") * F.col("Pop_Totale") / 1e4 - F.col("cases_lag_1"))),
        F.max(F.abs(F.col("incidence_rate") * F.col("Pop_Totale") / 1e4 - F.col("cases")))).first()
    assert r[0] < 1e-6 < r[1]


def test_selection_is_ordered_and_stable(spark, small_panel, small_static, small_weights, matrix):
    shuffled = small_panel.orderBy(F.rand(3))
    _, columns = ft.build_design_matrix(shuffled, static_df=small_static, neighbour_weights=small_weights)
    assert columns == matrix[1]
    assert "spatial_cluster" not in columns and "temp_api" not in columns and columns[0] == "cases_lag_1"


def test_given_features_are_kept(small_panel):
    df, columns = ft.build_design_matrix(small_panel, feature_cols=["cases_lag_1", "Eau_Pct"])
    assert columns == ["cases_lag_1", "Eau_Pct"] and "Eau_Pct" in df.columns
    assert ft.non_numeric_features(df, ["cases_lag_1", "health_area", "nope"]) == [("health_area", "string"), ("nope", "missing")]


@pytest.mark.parametrize("lag", [0, 2])
def test_climate_lags_compose_with_the_publication_delay(spark, small_panel, lag):
    climate = small_panel.select("health_area", "year", "week_", F.col("week_index").cast("double").alias("precip_api"))
    df = ft.add_climate_features(small_panel, climate, availability_lag=lag)
    row = df.where("week_index = 60 and health_area = 'area_01'").first()
    assert row["precip_api"] == 60 - lag and row["precip_lag_4"] == 56 - lag and row["precip_ma_4_8"] == 54.5 - lag
    assert row["temp_ma_4"] is None


def test_dynamics_roles(spark):
    rows = [(a, 2020, w, 1.0, t, float(w), alt) for a, t, alt in (("a", 20.0, 100.0), ("b", 25.0, 300.0)) for w in range(1, 53)]
    df = spark.createDataFrame(rows, "health_area string, year int, week_ int, cases double, temp_api double, precip_api double, Altitude_Moy double")
    df = df.withColumns({"humidity_api": F.lit(None).cast("double"), "Superficie_km2": F.lit(5.0)})
    roles = {r["variable"]: r["role"] for r in ft.describe_feature_dynamics(df).collect()}
    assert roles == {"temp_api": "niveau par aire", "precip_api": "temporelle", "Altitude_Moy": "niveau par aire",
                     "humidity_api": "insuffisante", "Superficie_km2": "constante"}
    assert ft.invariant_climate_variables(df) == ["temp_api"]


def test_coefficient_beyond_history_is_the_median(small_panel, small_static):
    df = ft.join_attributes(small_panel, small_static)
    last = df.agg(F.max("week_index")).first()[0]
    known = ft.with_population_coefficient(df).where(F.col("week_index") == last - 1).toPandas()["coef_population"]
    flagged = df.withColumn("cases_is_forecast", F.col("week_index") == last)
    ahead = ft.with_population_coefficient(flagged).where(F.col("week_index") == last).toPandas()["coef_population"]
    assert np.allclose(ahead, known.median())


def test_plan_has_one_exchange_by_area(spark, small_panel):
    """All per-area windows of the temporal family share a single shuffle."""
    plan = ft.add_seasonality(ft.add_temporal_features(small_panel))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_panel_and_features_share_the_exchange(spark):
    rows = [("a", 2019, 1, 5.0, 0.0), ("b", 2019, 9, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "health_area string, year int, week_ int, cases double, deaths double")
    plan = ft.add_temporal_features(build_panel(df, typed=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_blocked_splits_never_overlap(small_panel):
    folds = bl.temporal_cv_splits(small_panel, 5, embargo=4)
    report = bl.check_no_leakage(bl.fold_rows(small_panel, folds)).collect()
    assert len(report) == 5
    for r in report:
        assert not r["leakage"] and r["train_week_max"] + 4 < r["test_week_min"] + 1 and r["n_test"] > 0
    leaky = bl.check_no_leakage(bl.row_order_folds(small_panel, 5)).collect()
    assert len(leaky) == 5 and all(r["leakage"] for r in leaky)
    with pytest.raises(ValueError):
        bl.temporal_cv_splits(small_panel.where("week_index < 5"))


def test_row_order_blocks_match_positions(small_panel):
    n = small_panel.count()
    rows = bl.row_order_folds(small_panel, 5).where("role = 'test'").toPandas()
    size = n // 6
    assert (rows.groupby("fold").size() == size).all()
    frame = small_panel.select("health_area", "week_index").toPandas().sort_values(["health_area", "week_index"]).reset_index(drop=True)
    expected = frame.iloc[n - 5 * size:n - 4 * size]
    got = rows[rows.fold == 1].sort_values("position")
    assert list(got.health_area) == list(expected.health_area) and list(got.week_index) == list(expected.week_index)


def test_baseline_horizon_uses_older_values(small_panel):
    h4 = bl.baseline_predictions(small_panel, 4).where("week_index = 50 and health_area = 'area_00'").first()
    truth = {r["week_index"]: r["cases"] for r in small_panel.where("health_area = 'area_00'").collect()}
    assert h4["persistance"] == truth[46]
    assert h4["moyenne_aire"] == pytest.approx(np.mean([truth[i] for i in range(47)]))


def test_static_tables_merge_by_priority(spark):
    from panelcast.operators.kpi import merge_static_tables
    a = spark.createDataFrame([("A", None, 1.0), ("b", 2.0, 5.0)], "health_area string, v double, w double")
    b = spark.createDataFrame([("a ", 9.0, 3.0), ("b", 8.0, 4.0), ("c", 1.0, 1.0)], "health_area string, v double, z double")
    got = {r["health_area"]: tuple(r)[1:] for r in merge_static_tables(a, None, b).collect()}
    assert got == {"a": (9.0, 1.0, 3.0), "b": (2.0, 5.0, 4.0)}


def test_one_row_per_area_prevents_fan_out(spark, small_panel):
    double = spark.createDataFrame([("area_00", 1.0), (" AREA_00", 1.0)], "health_area string, Altitude_Moy double")
    assert ft.add_static_features(small_panel, double).count() == small_panel.count()


