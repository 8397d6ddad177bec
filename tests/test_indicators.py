from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import isoweek as iso
from panelcast.functions import labels, scalars
from panelcast.operators import climate, diagnostics, kpi, linelist, metrics, risk


def test_perfect_prediction(spark):
    df = spark.createDataFrame([(float(v), float(v)) for v in (0, 1, 5, 9)] + [(None, 3.0)], "observed double, predicted double")
    m = metrics.metrics_summary(df).first()
    assert (m["n"], m["mae"], m["rmse"], m["r2"], m["smape"], m["bias"], m["agg_ratio"]) == (4, 0, 0, 1, 0, 0, 1)


def test_flat_truth_has_no_r2(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "observed double, predicted double")
    m = metrics.metrics_summary(df).first()
    assert m["r2"] is None and m["mae"] == 1.0 and df.agg(metrics.safe_r2("observed", "predicted")).first()[0] is None


def test_peaks_and_confusion(spark):
    truth = [1, 1, 9, 1, 1, 8, 1, 1]
    guess = [1, 1, 9, 1, 1, 1, 1, 7]
    df = spark.createDataFrame([("a", i, float(t), float(g)) for i, (t, g) in enumerate(zip(truth, guess))],
                               "health_area string, week_index int, observed double, predicted double")
    m = metrics.compute_peak_detection_metrics(df).first()
    assert (m["n_true_peaks"], m["n_detected"], m["n_missed"], m["n_false_alarms"]) == (2, 1, 1, 1)
    assert m["sensitivity"] == 50.0 and m["specificity"] == 83.3


@pytest.mark.parametrize("n", [4, 6, 7, 8, 25])
def test_savgol_equals_local_quadratics(spark, n):
    rng = np.random.default_rng(n)
    y = rng.poisson(20, n).astype(float)
    curve = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "sort_key int, cases double")
    got = [r["trend"] for r in linelist.savgol_trend(curve).orderBy("sort_key").collect()]
    if n <= 5:
        assert got == [None] * n
        return
    w = min(7, n if n % 2 else n - 1)
    half = w // 2
    for i in range(n):
        start = min(max(i - half, 0), n - w)
        x = np.arange(start, start + w)
        assert got[i] == pytest.approx(np.polyval(np.polyfit(x, y[start:start + w], 2), i))


def test_expansion_is_complete_and_repeatable(spark):
    cells = spark.createDataFrame([("a", 2020, 53, 7, 2), ("b", 2021, 1, 0, 0), ("c", 2021, 2, 5, 9), ("d", 2021, 3, None, None)],
                                  "health_area string, year int, week_ int, cases int, deaths int")
    rows = linelist.expand_counts(cells, chunk=3)
    a = rows.where("Aire_Sante = 'a'").collect()
    assert len(a) == 7 and sum(r["Issue"] == "Décédé" for r in a) == 2 and sorted(r["rang"] for r in a) == list(range(1, 8))
    assert all(date(2020, 12, 28) <= r["Date_Debut_Eruption"] <= date(2021, 1, 3) for r in a)
    assert rows.where("Aire_Sante = 'c' and Issue = 'Décédé'").count() == 5 and rows.count() == 12
    assert rows.exceptAll(linelist.expand_counts(cells, chunk=100)).count() == 0


def test_linelist_defaults(spark):
    df = spark.createDataFrame([("x", "2020-12-31", "14"), ("y", "oops", "3")], "Aire_Sante string, Date_Debut_Eruption string, Age_Mois string")
    full = linelist.complete_linelist(df).collect()
    assert len(full) == 1
    r = full[0]
    assert (r["Semaine_Epi"], r["Annee"], r["Semaine_Annee"], r["ID_Cas"]) == (53, 2020, "2020-S53", 1)
    assert r["Date_Notification"] == date(2021, 1, 3) and r["Sexe"] == "Inconnu" and r["Age_Mois"] == 14.0
    late = spark.createDataFrame([("x", "2021-01-02")], "Aire_Sante string, Date_Debut_Eruption string")
    assert linelist.complete_linelist(late).first()["Annee"] == 2020
    assert linelist.complete_linelist(late, calendar_year=True).first()["Annee"] == 2021
    assert linelist.complete_linelist(late, max_week=52).count() == 0
    weeks = spark.createDataFrame([("x", "10", "2021")], "Aire_Sante string, Semaine_Epi string, Annee string")
    assert linelist.complete_linelist(weeks).first()["Date_Debut_Eruption"] == date.fromisocalendar(2021, 10, 1)


def test_onset_clamp(spark):
    df = spark.createDataFrame([(2020, 53)], "y int, w int")
    assert df.select(iso.onset_from_week("y", "w")).first()[0] == date(2020, 12, 28)
    assert df.select(iso.onset_from_week("y", "w", 52)).first()[0] == date(2020, 12, 21)


def test_labels(spark):
    df = spark.createDataFrame([(0.9, 1.0, 10.0), (0.7, 3.0, 25.0), (0.5, -4.0, 45.0), (0.1, 0.0, 90.0), (None, None, None)],
                               "r2 double, bias double, mae double")
    rows = df.select(labels.r2_label("r2"), labels.bias_label("bias"), labels.mae_label("mae", F.lit(100.0)),
                     labels.rmse_label("mae", F.lit(100.0)), labels.model_verdict("r2", "mae")).collect()
    assert [r[0] for r in rows] == ["Excellent", "Bon", "Moyen", "Faible", "—"]
    assert [r[1] for r in rows] == ["Bien centré", "Sur-estimation", "Sous-estimation", "Bien centré", None]
    assert [r[2] for r in rows][:4] == ["Excellent", "Bon", "Moyen", "Élevé"]
    assert [r[3] for r in rows][:4] == ["Excellent", "Bon", "Moyen", "Élevé"]
    assert [r[4] for r in rows] == ["Bon", "Bon", "Moyen", "Faible", "Validation impossible"]


def test_scalars(spark):
    df = spark.createDataFrame([(float("inf"), "Zindér-Est", None), (float("nan"), " n'Guigmi  x", 96.0), (2.0, "A_b", 80.0)], "v double, s string, c double")
    rows = df.select(scalars.finite("v"), scalars.match_key("s"), scalars.immunity_gap("c"), scalars.below_threshold("c"),
                     scalars.susceptibles("c", F.lit(100.0)), scalars.clip("v", 0.0, 1.0)).collect()
    assert [r[0] for r in rows] == [None, None, 2.0]
    assert [r[1] for r in rows] == ["zinder est", "n guigmi x", "a b"]
    assert [r[2] for r in rows] == [None, 0.0, 15.0] and [r[3] for r in rows] == [None, 0.0, 1.0]
    assert rows[2][4] == pytest.approx(20.0) and rows[2][5] == 1.0
    urban = spark.createDataFrame([("Rural",), (" URBAIN",), ("semi urbain",), ("?",)], "u string").select(scalars.urban_code("u")).collect()
    assert [r[0] for r in urban] == [0.0, 2.0, 1.0, None]


def test_vintage_selection(spark):
    df = spark.createDataFrame([("a", 2019, 1.0), ("a", 2021, 2.0)], "health_area string, year int, pop double")
    assert kpi.select_vintage(df)[0].first()["year"] == 2021 and kpi.select_vintage(df, 2019)[0].first()["pop"] == 1.0
    table, warning = kpi.select_vintage(df, 2030)
    assert table.count() == 2 and "2030" in warning


def test_coverage_report_has_units(spark):
    df = spark.createDataFrame([("a", 100.0, None), ("b", 300.0, None)], "health_area string, Altitude_Moy double, other string")
    rows = {r["variable"]: r for r in kpi.describe_coverage(df).collect()}
    assert rows["Altitude_Moy"]["unite"] == "m" and rows["Altitude_Moy"]["pct"] == 100.0 and rows["other"]["n_renseigne"] == 0


def test_heat_matrix_is_chronological(spark):
    df = spark.createDataFrame([("a", "2020-S02", 3.0), ("a", "2020-S01", 1.0), ("b", "2020-S01", 9.0), ("c", "2020-S02", 1.0)],
                               "health_area string, period string, cases double")
    wide = kpi.heat_matrix(df, n_areas=2)
    assert wide.columns == ["health_area", "2020-S01", "2020-S02"]
    assert {tuple(r) for r in wide.collect()} == {("a", 1.0, 3.0), ("b", 9.0, 0.0)}


def test_correlation_ignores_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)], "cases double, x double, flat double")
    got = {(r["variable_1"], r["variable_2"]): r["r"] for r in kpi.correlation_matrix(df, ["cases", "x", "flat"]).collect()}
    assert got[("cases", "x")] == pytest.approx(1.0) and got[("cases", "flat")] is None and got[("x", "x")] == 1.0


def test_alert_threshold_is_strict(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 4)], "health_area string, predicted_cases double")
    assert risk.generate_alerts(df, 75).count() == 0 and risk.generate_alerts(df, 50).count() == 2
    assert risk.generate_alerts(df.limit(0)).count() == 0


def test_risk_categories(spark):
    forecast = spark.createDataFrame([(a, i, f"2020-S{i:02d}", v) for a, v in (("up", 20.0), ("slight", 10.5), ("down", 1.0), ("same", 10.0), ("new", 0.0)) for i in (1, 2)],
                                     "health_area string, week_index int, period string, predicted_cases double")
    observed = spark.createDataFrame([(a, 10.0) for a in ("up", "slight", "down", "same")], "health_area string, cases double")
    got = {r["health_area"]: (r["category"], r["peak_week"]) for r in risk.risk_synthesis(forecast, observed, 2).collect()}
    assert got == {"up": ("Forte hausse", "2020-S01"), "slight": ("Légère hausse", "2020-S01"), "down": ("Forte baisse", "2020-S01"),
                   "same": ("Stable/baisse", "2020-S01"), "new": ("Stable/baisse", "2020-S01")}


def test_climate_points_are_shared_and_weeks_are_iso(spark):
    areas = spark.createDataFrame([("a", 13.001, 2.0), ("b", 13.002, 2.0), ("c", 20.0, 2.0)], "health_area string, latitude double, longitude double")
    points = spark.createDataFrame([(13.0, 2.0, date(2020, 12, 31), 20.0, 1.5, 40.0), (13.0, 2.0, date(2021, 1, 1), 22.0, 2.5, None)],
                                   "latitude double, longitude double, date date, temp double, precip double, humidity double")
    cases = spark.createDataFrame([(53,)], "week_ int")
    got = {r["health_area"]: r for r in climate.aggregate_climate_by_week_and_area(areas, cases, points).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["year"], got["a"]["week_"], got["a"]["nb_days"], got["a"]["temp_api"], got["a"]["precip_api"], got["a"]["humidity_api"]) == (2020, 53, 2, 21.0, 4.0, 40.0)
    jan = climate.climate_by_week(climate.daily_for_areas(areas, points), calendar="jan1").where("health_area = 'a'").collect()
    assert {(r["year"], r["week_"]) for r in jan} == {(2020, 53), (2021, 1)}


def test_skew_flags_missing_and_shifted(spark):
    train = spark.createDataFrame([(1.0, 1.0, 1.0)], "a double, b double, c double")
    served = spark.createDataFrame([(1.2, 9.0)], "a double, b double")
    got = {r["variable"]: r["flagged"] for r in diagnostics.skew_report(train, served, ["a", "b", "c"]).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_overlaps(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "health_area string, week_index int")
    b = spark.createDataFrame([("y", 1), ("y", 5)], "health_area string, week_index int")
    assert [r[0] for r in diagnostics.week_overlap(a, b).collect()] == [1]
    assert [r[0] for r in diagnostics.area_overlap(a, b).collect()] == ["y"]


def test_mean_importance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "variable string, importance double")
    assert {tuple(r) for r in metrics.mean_importance(df).collect()} == {("a", 2.0), ("b", 5.0)}


def test_outcomes_of_every_age(spark, sf):
    import __spark_entry__ as contract
    cases = spark.read.parquet(f"{sf}/lineitem.parquet")
    tables = {name: contract.queries()[name](spark, sf) for name in ("outcome_table", "outcome_table_all_ages")}
    assert {t.agg(F.sum("n")).first()[0] for t in tables.values()} == {cases.count()}
    by_age = {r.age_class: r.n for r in tables["outcome_table"].groupBy("age_class").agg(F.sum("n").alias("n")).collect()}
    assert by_age["1-60"] == cases.where("l_quantity <= 20").count() and by_age["61+"] == cases.where("l_quantity > 20").count()
