"""Moments and the models they determine against single fits and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import features as ft
from panelcast.operators.moments import linear_solution, segment_moments
from panelcast.plans import forecast as fc
from panelcast.plans import linear, models, validation
from panelcast.session import materialise


def data(spark, n=900, centre=1e7):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(centre, 1, n), "b": rng.exponential(3, n), "c": rng.integers(0, 3, n).astype(float), "k": np.full(n, 4.0), "e": np.full(n, np.nan)})
    pdf["cases"] = 0.3 * (pdf.a - centre) + pdf.b ** 2 + rng.normal(0, 0.1, n) + 10
    pdf.loc[rng.random(n) < 0.3, "b"] = np.nan
    pdf.loc[5, "c"] = np.inf
    pdf["week_index"] = np.arange(n) % 30
    return pdf, materialise(spark.createDataFrame(pdf).repartition(5))


def test_moments_equal_numpy(spark):
    pdf, df = data(spark)
    parts = segment_moments(df, ["a", "b", "c"], {"cases": F.col("cases")}, F.when(F.col("week_index") < 20, F.floor(F.col("week_index") / 10)), {"a": 1e7, "b": 2.0}, squares=True)
    assert list(parts) == [0, 1]
    rows = pdf[pdf.week_index < 20].replace(np.inf, np.nan)
    whole = parts[0] + parts[1]
    assert whole.n == len(rows)
    x = np.column_stack([np.ones(len(rows)), rows.a - 1e7, rows.b.fillna(7.0) - 2.0, rows.cases])
    assert np.allclose(whole.imputed(["a", "b"], {"a": 0.0, "b": 7.0}, "cases"), x.T @ x, rtol=1e-12)
    pairs, shifted = whole.pairs(), rows[["a", "b", "c"]] - [1e7, 2.0, 0.0]
    for i, u in enumerate("abc"):
        for j, v in enumerate("abc"):
            both = shifted[[u, v]].dropna().to_numpy()
            want = [len(both), both[:, 0].sum(), both[:, -1].sum(), (both[:, 0] ** 2).sum(), (both[:, -1] ** 2).sum(), (both[:, 0] * both[:, -1]).sum()]
            assert np.allclose([pairs[k][i, j] for k in ("n", "x", "y", "xx", "yy", "xy")], want)


@pytest.mark.parametrize("name, overrides", [("Ridge", {}), ("Ridge", {"regParam": 0.01}), ("Lasso", {"regParam": 0.5, "tol": 1e-12, "maxIter": 5000}), ("Ridge", {"elasticNetParam": 0.4, "tol": 1e-12, "maxIter": 5000})])
@pytest.mark.parametrize("log", [False, True])
def test_solutions_equal_single_fits(spark, name, overrides, log):
    _, df = data(spark, centre=3.0)
    factory, columns = models.ModelFactory(name, overrides=overrides), ["a", "b", "c"]
    sums = linear.training_sums(df, columns, *linear.growing([9, 19, 29]))
    for origin in (9, 29):
        one = fc.fit_matrix(df.where(F.col("week_index") <= origin), columns, factory, log_target=log, diagnostics=False)
        got = sums.fit(origin, columns, linear.solvable(factory), "log" if log else "cases")
        assert got.medians == pytest.approx(one.medians) and got.n_train == one.n_train
        tolerance = 1e-8 if name == "Ridge" and not overrides.get("elasticNetParam") else 1e-5
        assert np.allclose(got.model.coefficients.toArray(), one.model.coefficients.toArray(), rtol=tolerance, atol=tolerance)
        mine, theirs = (f.predict(df).agg(F.sum("predicted_cases")).first()[0] for f in (got, one))
        assert mine == pytest.approx(theirs, rel=max(tolerance, 1e-8))


def test_large_means_lose_no_digits(spark):
    """Mean 1e7, spread 1: equal to a penalised fit of centred columns, where raw second moments keep no digit of the spread."""
    pdf, df = data(spark)
    fitted = linear.training_sums(df, ["a", "b"], *linear.growing([29])).fit(29, ["a", "b"], (1.0, 0.0))
    x = pdf[["a", "b"]].fillna(pdf[["a", "b"]].median()).to_numpy()
    z, y = (x - x.mean(0)) / x.std(0), (pdf.cases - pdf.cases.mean()) / pdf.cases.std(ddof=0)
    beta = np.linalg.solve(z.T @ z / len(z) + np.eye(2) / pdf.cases.std(ddof=0), z.T @ y / len(z)) * pdf.cases.std(ddof=0) / x.std(0)
    assert np.allclose(fitted.model.coefficients.toArray(), beta, rtol=1e-7)


def test_subsets_empty_and_constant_columns(spark):
    _, df = data(spark)
    sums = linear.training_sums(df, ["a", "b", "c", "k", "e"], *linear.growing([29]))
    fitted = sums.fit(29, ["k", "e", "b"], (1.0, 0.0))
    assert fitted.model.coefficients[0] == fitted.model.coefficients[1] == 0.0 and fitted.model.coefficients[2] > 0 and fitted.medians["e"] == 0.0
    with pytest.raises(ValueError):
        linear.training_sums(df.where("week_index < 0"), ["a"], *linear.growing([29])).fit(29, ["a"], (1.0, 0.0))


def test_only_plain_least_squares_is_solved():
    assert linear.solvable(models.ModelFactory("Ridge")) == (1.0, 0.0) and linear.solvable(models.ModelFactory("Lasso")) == (1.0, 1.0)
    assert linear.solvable(models.ModelFactory("XGBoost", "poisson")) is None and linear.solvable(models.ModelFactory("RandomForest")) is None
    assert linear.solvable(models.ModelFactory("Ridge", overrides={"fitIntercept": False})) is None


def test_solution_of_one_row_and_constant_target():
    products = np.ones((3, 3))
    assert linear_solution(products, ["x"], {"x": 0.0, "y": 0.0}, "y", 1.0)[0].tolist() == [0.0]


def test_folds_and_backtest_equal_single_fits(small_panel, small_static, small_weights, monkeypatch):
    builder = ft.DesignBuilder(static_df=small_static, neighbour_weights=small_weights)
    ridge = models.ModelFactory("Ridge")

    def runs():
        cv = validation.temporal_validation(small_panel, builder, ridge, n_splits=3)["folds"].toPandas().sort_values("fold")
        back = validation.backtest(small_panel, builder, ridge, horizons=(1, 2), n_origins=3, min_train_weeks=60).toPandas().sort_values(["modele", "horizon"])
        study = validation.ablations(small_panel, builder, ridge, horizons=(1, 2), n_origins=2, min_train_weeks=60).toPandas().sort_values(["config", "modele", "horizon"])
        return [t.select_dtypes("number").to_numpy() for t in (cv, back, study)]

    fast = runs()
    monkeypatch.setattr(validation, "solvable", lambda factory: None)
    for a, b in zip(fast, runs(), strict=True):
        assert a.shape == b.shape and np.allclose(a, b, rtol=1e-7, equal_nan=True)


def test_random_folds_by_membership(spark):
    _, df = data(spark)
    df = materialise(df.withColumn("health_area", F.concat(F.lit("h"), F.monotonically_increasing_id())))
    folds = df.select("health_area", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("fold")).withColumn(
        "role", F.when(F.pmod(F.xxhash64("health_area"), F.lit(3)) + 1 == F.col("fold"), "test").otherwise("train"))
    out = validation.blocked_predictions(df, ["b", "c"], materialise(folds), models.ModelFactory("Ridge"))
    assert out.count() == 900 and out.select("fold").distinct().count() == 3
    train = df.join(folds.where("role = 'train' and fold = 2").select("health_area"), "health_area")
    one = fc.fit_matrix(materialise(train), ["b", "c"], models.ModelFactory("Ridge"), diagnostics=False)
    test = df.join(folds.where("role = 'test' and fold = 2").select("health_area"), "health_area")
    want = one.predict(test).agg(F.sum("predicted_cases")).first()[0]
    assert out.where("fold = 2").agg(F.sum("predicted")).first()[0] == pytest.approx(want, rel=1e-8)


def test_correlations_of_many_columns(spark):
    """Three hundred columns with gaps, a large mean, a constant and an empty one, in one scan."""
    from panelcast.operators import kpi
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(rng.normal(size=(400, 300)).cumsum(axis=1), columns=[f"c{i}" for i in range(300)])
    pdf["c1"] = 1e9 + pdf["c0"] + rng.normal(size=400)
    pdf["c2"], pdf["c3"] = 5.1, np.nan
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1)
    got = kpi.correlation_matrix(spark.createDataFrame(pdf).repartition(4), list(pdf.columns)).toPandas().pivot(index="variable_1", columns="variable_2", values="r")
    want = pdf.drop(columns=["c2", "c3"]).corr()
    assert np.allclose(got.loc[want.index, want.columns], want, atol=1e-9)
    assert got.loc["c2"].drop("c2").isna().all() and got.loc["c3"].drop("c3").isna().all()
    empty = kpi.correlation_matrix(spark.createDataFrame([], "a double, b double"), ["a", "b"])
    assert {(r.variable_1, r.variable_2, r.r) for r in empty.collect()} == {("a", "a", 1.0), ("b", "b", 1.0), ("a", "b", None), ("b", "a", None)}
