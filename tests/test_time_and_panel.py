from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelcast.functions import isoweek as iso
from panelcast.operators import clean
from panelcast.operators.panel import build_panel, panel_summary


def test_iso_functions_follow_the_calendar(spark):
    days = [(date(2014, 12, 20) + timedelta(days=i),) for i in range(4400)]
    df = spark.createDataFrame(days, "d date").select("d", iso.iso_year("d").alias("y"), iso.iso_week("d").alias("w"))
    df = df.withColumns({"monday": iso.iso_week_to_date("y", "w"), "i": iso.iso_week_index("y", "w", 2014)})
    year, week = iso.week_index_to_iso("i", 2014)
    for r in df.withColumns({"y2": year, "w2": week}).collect():
        expected = r["d"].isocalendar()
        assert (r["y"], r["w"]) == (expected[0], expected[1]) == (r["y2"], r["w2"])
        assert r["monday"] == date.fromisocalendar(expected[0], expected[1], 1)


def test_week_edges(spark):
    rows = [(2020, 53), (2019, 53), (2015, 53), (2021, 1), (2021, 0), (None, 4), (2021, None)]
    df = spark.createDataFrame(rows, "y int, w int").withColumn("m", iso.iso_week_to_date("y", "w"))
    got = [r["m"] for r in df.collect()]
    assert got == [date(2020, 12, 28), date(2019, 12, 23), date(2015, 12, 28), date(2021, 1, 4), date(2021, 1, 4), None, None]


def test_future_weeks_iso_and_wrap(spark):
    last = spark.createDataFrame([(2020, 52)], "year int, week_ int")
    assert [r["label"] for r in iso.future_weeks(last, 3).orderBy("step").collect()] == ["2020-S53", "2021-S01", "2021-S02"]
    assert [r["label"] for r in iso.future_weeks(last, 2, wrap=52).orderBy("step").collect()] == ["2021-S01", "2021-S02"]


def test_index_without_origin_starts_at_the_first_date(spark):
    df = spark.createDataFrame([(2020, 10), (2020, 12)], "year int, week_ int")
    assert [r["week_index"] for r in iso.with_week_index(df).orderBy("week_").collect()] == [0, 2]


def test_week_labels(spark):
    labels = [("2019-W01",), ("2019-S01",), ("S07",), ("12",), ("abc",)]
    df = spark.createDataFrame(labels, "week_ string")
    got = clean.normalise_week_labels(df.withColumn("raw", F.col("week_"))).collect()
    assert {r["raw"]: r["week_"] for r in got} == {"2019-W01": 1, "2019-S01": 1, "S07": 7, "12": 12, "abc": 5}
    parity = clean.normalise_week_labels(df.withColumn("raw", F.col("week_")), parity=True).collect()
    assert {r["raw"]: r["week_"] for r in parity}["2019-S01"] == 201901


def test_panel_keeps_years_apart_and_fills_zeros(spark):
    rows = [("A", 2019, 1, 5, 0), (" a ", 2019, 1, 2, 1), ("a", 2020, 1, 7, 0), ("b", 2020, 53, 3, 0), ("b", 2019, 53, 9, 0)]
    df = spark.createDataFrame(rows, "health_area string, year int, week_ int, cases int, deaths int")
    panel = build_panel(df).cache()
    assert panel.count() == 2 * (52 + 53)
    assert panel.groupBy("health_area", "year", "week_").count().where("count > 1").count() == 0
    value = {(r["health_area"], r["year"], r["week_"]): (r["cases"], r["deaths"]) for r in panel.collect()}
    assert value[("a", 2019, 1)] == (7.0, 1.0) and value[("a", 2020, 1)] == (7.0, 0.0)
    assert value[("b", 2020, 53)] == (3.0, 0.0) and value[("b", 2020, 1)] == (0.0, 0.0)
    assert panel.agg(F.sum("cases")).first()[0] == 17.0  # 2019 has no week 53
    summary = panel_summary(panel).first()
    assert summary["completeness_pct"] == 100.0 and summary["years"] == [2019, 2020] and summary["week_index_max"] == 104


def test_panel_scope_extras_and_sparse_form(spark):
    rows = [("a", 2019, 2, 1, 10.0), ("a", 2019, 2, 3, 20.0), ("b", 2020, 2, 4, 5.0)]
    df = spark.createDataFrame(rows, "health_area string, year int, week_ int, cases int, temp double")
    panel = build_panel(df, years=[2019], areas=["A"])
    first = panel.where("week_ = 2").first()
    assert (first["cases"], first["temp"]) == (4.0, 15.0) and panel.where("week_ = 3").first()["temp"] is None
    assert build_panel(df, complete_grid=False).count() == 2
    assert build_panel(df, years=[2019], fill_zero=False).where("cases is null").count() == 51


def test_years_are_inferred(spark):
    rows = [("a", "1", "3", None, "2018-S01"), ("a", "2", "x", "2019", None), ("a", "3", "4", "2019", None), ("a", "4", "4", None, None),
            ("a", "bad", "4", "2019", None)]
    df = spark.createDataFrame(rows, "health_area string, week_ string, cases string, year string, period string")
    got = clean.infer_year(clean.clean_cases(df)).orderBy("week_").collect()
    assert [(r["week_"], r["year"], r["cases"]) for r in got] == [(1, 2018, 3.0), (2, 2019, 0.0), (3, 2019, 4.0), (4, 2019, 4.0)]


def test_header_roles():
    assert clean.role_renames(["aire_de_sante", "nb_cas_confirmes", "semaine"], clean.CASE_ROLES, contains=True) == {
        "aire_de_sante": "health_area", "semaine": "week_", "nb_cas_confirmes": "cases"}
    folded = clean.role_renames(["Année", "AIRE DE SANTE", "Décès", "Semaine"], clean.LINELIST_ROLES, fold=True)
    assert folded == {"Année": "Annee", "AIRE DE SANTE": "Aire_Sante", "Décès": "Deces", "Semaine": "Semaine_Epi"}


def test_detectors(spark):
    df = spark.createDataFrame([("x", "2020-01-01", "nation_1"), ("y", "2020-01-09", "zz"), ("z", "?", "q")], "k string, when_ string, place string")
    layer = spark.createDataFrame([("nation_1",)], "health_area string")
    assert clean.first_date_column(df) == "when_" and clean.first_area_column(df, layer) == "place"
    assert clean.first_date_column(df.select("k")) is None


def test_forecast_and_validation_headers(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], " Aire_Sante string, weeknum int, predictedcases double")
    assert clean.harmonise_forecast(df).columns == ["health_area", "week_num", "predicted_cases"]
    other = spark.createDataFrame([("a", 1, 2.0)], "`Nom Aire` string, `num_semaine` int, `Cas Observes` double")
    assert clean.harmonise_validation(other).columns == ["health_area", "week_num", "cases"]
    with pytest.raises(ValueError):
        clean.harmonise_validation(other.select("`Nom Aire`"))
