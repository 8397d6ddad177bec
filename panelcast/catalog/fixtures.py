"""Logical surveillance tables read from the driver tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import isoweek as iso
from ..operators.panel import build_panel


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cases_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases of the customer's nation.

    Orders are counted per customer and week before any join, so a customer with a
    third of all orders is a few hundred rows when the join shuffles.
    """
    orders = table(spark, sf, "orders").select(
        "o_custkey", iso.iso_year("o_orderdate").alias("year"), iso.iso_week("o_orderdate").alias("week_"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 50 == 0)).cast("bigint").alias("died"))
    counted = orders.groupBy("o_custkey", "year", "week_").agg(F.count(F.lit(1)).alias("cases"), F.sum("died").alias("deaths"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("health_area"))
    by_nation = (counted.join(customer, F.col("o_custkey") == F.col("c_custkey"))
                 .groupBy("c_nationkey", "year", "week_").agg(F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths")))
    return (by_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("health_area", "year", "week_", "cases", "deaths"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return build_panel(cases_weekly(spark, sf), typed=True)


def site_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases of the customer: a panel with gaps that grows with the tables."""
    weekly = table(spark, sf, "orders").groupBy(
        F.concat(F.lit("site_"), "o_custkey").alias("health_area"), iso.iso_year("o_orderdate").alias("year"), iso.iso_week("o_orderdate").alias("week_"))
    return build_panel(weekly.agg(F.count(F.lit(1)).alias("cases"), F.lit(0).cast("bigint").alias("deaths")), typed=True, complete_grid=False)


def linelist(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("health_area"))
    onset = F.col("l_shipdate").cast("date")
    return (lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_cas"), "health_area", onset.alias("onset"),
                    iso.iso_year(onset).alias("year"), iso.iso_week(onset).alias("week_"),
                    (F.col("l_quantity") * 3).cast("int").alias("age_mois"),
                    F.when(F.col("l_returnflag") == "A", "Oui").when(F.col("l_returnflag") == "R", "Non")
                    .otherwise("Inconnu").alias("statut_vaccinal"),
                    F.when(F.col("l_linenumber") % 2 == 0, "M").otherwise("F").alias("sexe"),
                    F.when(F.col("l_orderkey") % 40 == 0, "Décédé").when(F.col("l_orderkey") % 20 == 1, "Inconnu")
                    .otherwise("Guéri").alias("issue")))


def layer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.lower("n_name").alias("health_area"))


def population(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    total = 20000 + key * 1777
    return table(spark, sf, "nation").select(
        F.lower("n_name").alias("health_area"), total.cast("bigint").alias("pop_totale"),
        F.floor(total * 0.48).cast("bigint").alias("pop_enfants_0_14"),
        F.when(key != 24, (100 + key * 10).cast("double")).alias("superficie_km2"))


def static_population(spark: SparkSession, sf: str) -> DataFrame:
    """Population under the names of the design matrix."""
    density = F.col("pop_totale") / F.col("superficie_km2")
    return population(spark, sf).select(
        "health_area", F.col("pop_totale").cast("double").alias("Pop_Totale"),
        F.col("pop_enfants_0_14").cast("double").alias("Pop_Enfants_0_14"),
        F.col("superficie_km2").alias("Superficie_km2"), density.alias("Densite_Pop"))


def vaccination(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").where(key < 23).select(
        F.lower("n_name").alias("health_area"),
        F.when(key % 6 != 5, (60 + (key * 7) % 40).cast("double")).alias("taux_vaccination"))


def static_a(spark: SparkSession, sf: str) -> DataFrame:
    balance = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("b"))
    return (table(spark, sf, "nation").join(balance, F.col("n_nationkey") == F.col("s_nationkey"), "left")
            .select(F.lower("n_name").alias("health_area"),
                    F.when(F.col("n_nationkey") % 4 != 0, F.round("b", 2)).alias("altitude_moy")))


def static_b(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.lower("n_name").alias("health_area"), (200 + 10 * F.col("n_nationkey")).cast("double").alias("altitude_moy"),
        F.col("n_regionkey").cast("double").alias("urban_code"))


def climate_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily climate per nation; lines are reduced per supplier and day before the joins."""
    per_day = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("t"), F.sum("l_discount").alias("d"))
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("health_area"))
    daily = (per_day.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "date")
             .agg(*[F.sum(c).alias(c) for c in ("n", "q", "t", "d")]))
    return (daily.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("health_area", "date",
                    F.round(F.round(20 + F.col("q") / F.col("n") / 5, 10), 4).cast("double").alias("temp"),
                    F.round(F.round(F.col("t") * 100, 8), 4).cast("double").alias("precip"),
                    F.round(F.round(F.col("d") / F.col("n") * 800, 10), 4).cast("double").alias("humidity")))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer as a small health area, so that per-area work grows with the tables.

    Positions are multiples of 1/8 degree: distances of equal length compare equal.
    """
    key = F.col("c_custkey")
    total = 20000 + key % 997 * 17
    return table(spark, sf, "customer").select(
        F.format_string("site_%d", key).alias("health_area"), total.cast("bigint").alias("pop_totale"),
        F.floor(total * 0.48).cast("bigint").alias("pop_enfants_0_14"),
        F.when(key % 24 != 0, (100 + key % 50).cast("double")).alias("superficie_km2"),
        F.when(key % 6 != 5, (60 + key * 7 % 40).cast("double")).alias("taux_vaccination"),
        ((key * 7919 % 1000).cast("double") / 8).alias("longitude"), ((key * 104729 % 397).cast("double") / 8).alias("latitude"))


def site_cases(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cases"))
    return orders.select(F.format_string("site_%d", "o_custkey").alias("health_area"), "cases")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """River segments from the suppliers."""
    key = F.col("s_suppkey")
    x, y = (key * 3767 % 1000).cast("double") / 8, (key * 9109 % 397).cast("double") / 8
    return table(spark, sf, "supplier").select(x.alias("x1"), y.alias("y1"), (x + key % 7 - 3).alias("x2"), (y + key % 5 - 2).alias("y2"))


def area_boxes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    x0, y0 = ((key % 5) * 2).cast("double"), (10 + 2 * F.floor(key / 5)).cast("double")
    return table(spark, sf, "nation").select(F.lower("n_name").alias("health_area"), x0.alias("x0"), y0.alias("y0"),
                                             (x0 + 2).alias("x1"), (y0 + 2).alias("y1"))


def area_polygons(spark: SparkSession, sf: str) -> DataFrame:
    return area_boxes(spark, sf).select("health_area", F.array(F.array(geo.box_ring("x0", "y0", "x1", "y1"))).alias("polygons"))


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return area_boxes(spark, sf).select("health_area", (F.col("x0") + 1).alias("longitude"), (F.col("y0") + 1).alias("latitude"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Raster cells from the parts; null is no-data."""
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        ((key % 40).cast("double") / 4 + 0.125).alias("x"), (10 + F.floor(key / 40).cast("double") % 40 / 4 + 0.125).alias("y"),
        F.when(key % 17 != 0, F.col("p_size").cast("double")).alias("value"))


def dirty_names(spark: SparkSession, sf: str) -> DataFrame:
    name, kind = F.lower("n_name"), F.col("n_nationkey") % 4
    return table(spark, sf, "nation").select(
        name.alias("truth"),
        F.when(kind == 0, name).when(kind == 1, F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")))
        .when(kind == 2, F.regexp_replace(name, "_", "-")).otherwise(F.regexp_replace(name, "nation", "natien")).alias("raw_name"))


def age_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Population by band and sex counted from the customers."""
    key = F.col("c_custkey")
    band = F.element_at(F.array(*[F.lit(b) for b in ("0_4", "5_9", "10_14", "15_19", "20_24", "25_29", "30_34", "35_plus")]),
                        (key % 8 + 1).cast("int"))
    start = F.element_at(F.array(*[F.lit(b) for b in (0, 12, 60, 120)]), (key % 4 + 1).cast("int"))
    length = F.element_at(F.array(*[F.lit(b) for b in (12, 48, 48, 60)]), (key % 4 + 1).cast("int"))
    rows = table(spark, sf, "customer").select(
        band.alias("band"), F.when(F.floor(key / 8) % 3 == 0, "M").otherwise("F").alias("sex"), start.alias("band_start"),
        length.alias("band_months"))
    return rows.groupBy("band", "sex", "band_start", "band_months").agg(F.count(F.lit(1)).alias("population"))


def naive_forecast(panel_df: DataFrame, horizons: int = 4) -> DataFrame:
    """Seasonal-naive forecast of the weeks after the panel: the value 52 weeks before."""
    last, first_year = panel_df.agg(F.max("week_index"), F.min("year")).first()
    rows = panel_df.where(F.col("week_index").between(last - 51, last - 52 + horizons))
    target = F.col("week_index") + 52
    year, week = iso.week_index_to_iso(target, int(first_year))
    return rows.select("health_area", year.alias("year"), week.alias("week_"), target.alias("week_index"),
                       iso.period_label(year, week).alias("period"), (target - last).cast("int").alias("horizon"),
                       F.col("cases").alias("predicted_cases"))


def validation_results(panel_df: DataFrame) -> DataFrame:
    """Test rows of the blocked folds with last week's value as prediction."""
    from ..operators.baselines import PERSISTENCE, baseline_predictions, fold_rows, temporal_cv_splits
    folds = temporal_cv_splits(panel_df).where("role = 'test'")
    return fold_rows(baseline_predictions(panel_df), folds).select(
        "fold", "health_area", "week_index", F.col("cases").alias("observed"), F.col(PERSISTENCE).alias("predicted"))


# ---------------------------------------------------------------------------
# the same views in SQL
# ---------------------------------------------------------------------------
def r(expression: str, digits: int = 6) -> str:
    """SQL twin of ``settle``."""
    return f"CAST(round(CAST(round({expression}, 10) AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "cases_weekly": ((), """SELECT lower(n_name) AS health_area, CAST(isoyear(o_orderdate) AS INT) AS year,
        CAST(week(o_orderdate) AS INT) AS week_, count(*) AS cases,
        CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS deaths
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3"""),
    "extent": (("cases_weekly",), """SELECT min(year) AS y0, max(year) AS y1,
        date_trunc('week', make_date(min(year), 1, 4)) AS monday0,
        datediff('day', date_trunc('week', make_date(min(year), 1, 4)), date_trunc('week', make_date(max(year) + 1, 1, 4))) // 7 AS n_weeks
        FROM cases_weekly"""),
    "weeks": (("extent",), """SELECT CAST(i AS INT) AS week_index, CAST(isoyear(d) AS INT) AS year, CAST(week(d) AS INT) AS week_
        FROM (SELECT i, CAST(monday0 AS DATE) + CAST(i * 7 AS INT) AS d FROM extent, LATERAL (SELECT unnest(generate_series(0, n_weeks - 1)) AS i))"""),
    "panel": (("cases_weekly", "weeks"), """SELECT a.health_area, w.year, w.week_, w.week_index,
        CAST(coalesce(c.cases, 0) AS DOUBLE) AS cases, CAST(coalesce(c.deaths, 0) AS DOUBLE) AS deaths,
        concat(w.year, '-S', lpad(CAST(w.week_ AS VARCHAR), 2, '0')) AS period
        FROM (SELECT DISTINCT health_area FROM cases_weekly) a CROSS JOIN weeks w
        LEFT JOIN cases_weekly c ON c.health_area = a.health_area AND c.year = w.year AND c.week_ = w.week_"""),
    "linelist": ((), """SELECT l_orderkey * 10 + l_linenumber AS id_cas, lower(n_name) AS health_area, CAST(l_shipdate AS DATE) AS onset,
        CAST(isoyear(l_shipdate) AS INT) AS year, CAST(week(l_shipdate) AS INT) AS week_,
        CAST(l_quantity * 3 AS INT) AS age_mois,
        CASE l_returnflag WHEN 'A' THEN 'Oui' WHEN 'R' THEN 'Non' ELSE 'Inconnu' END AS statut_vaccinal,
        CASE WHEN l_linenumber % 2 = 0 THEN 'M' ELSE 'F' END AS sexe,
        CASE WHEN l_orderkey % 40 = 0 THEN 'Décédé' WHEN l_orderkey % 20 = 1 THEN 'Inconnu' ELSE 'Guéri' END AS issue
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""),
    "layer": ((), "SELECT lower(n_name) AS health_area FROM nation"),
    "population": ((), """SELECT lower(n_name) AS health_area, CAST(20000 + n_nationkey * 1777 AS BIGINT) AS pop_totale,
        CAST(floor((20000 + n_nationkey * 1777) * 0.48) AS BIGINT) AS pop_enfants_0_14,
        CASE WHEN n_nationkey = 24 THEN NULL ELSE CAST(100 + n_nationkey * 10 AS DOUBLE) END AS superficie_km2 FROM nation"""),
    "vaccination": ((), """SELECT lower(n_name) AS health_area,
        CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE CAST(60 + (n_nationkey * 7) % 40 AS DOUBLE) END AS taux_vaccination
        FROM nation WHERE n_nationkey < 23"""),
    "static_a": ((), """SELECT lower(n_name) AS health_area, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE round(avg(s_acctbal), 2) END AS altitude_moy
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey"""),
    "static_b": ((), """SELECT lower(n_name) AS health_area, CAST(200 + 10 * n_nationkey AS DOUBLE) AS altitude_moy,
        CAST(n_regionkey AS DOUBLE) AS urban_code FROM nation"""),
    "climate_daily": ((), f"""SELECT lower(n_name) AS health_area, CAST(l_shipdate AS DATE) AS date,
        {r('20 + avg(l_quantity) / 5', 4)} AS temp, {r('round(sum(l_tax) * 100, 8)', 4)} AS precip,
        {r('avg(l_discount) * 800', 4)} AS humidity
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""),
    "area_boxes": ((), """SELECT lower(n_name) AS health_area, CAST((n_nationkey % 5) * 2 AS DOUBLE) AS x0,
        CAST(10 + 2 * floor(n_nationkey / 5) AS DOUBLE) AS y0, CAST((n_nationkey % 5) * 2 + 2 AS DOUBLE) AS x1,
        CAST(12 + 2 * floor(n_nationkey / 5) AS DOUBLE) AS y1 FROM nation"""),
    "centroids": (("area_boxes",), "SELECT health_area, x0 + 1 AS longitude, y0 + 1 AS latitude FROM area_boxes"),
    "cells": ((), """SELECT CAST(p_partkey % 40 AS DOUBLE) / 4 + 0.125 AS x,
        10 + CAST(floor(p_partkey / 40) AS DOUBLE) % 40 / 4 + 0.125 AS y,
        CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value FROM part"""),
    "located": (("cells", "area_boxes"), """SELECT health_area, x, y, value FROM cells JOIN area_boxes
        ON x > x0 AND x < x1 AND y > y0 AND y < y1"""),
    "sites": ((), """SELECT concat('site_', c_custkey) AS health_area, CAST(20000 + c_custkey % 997 * 17 AS BIGINT) AS pop_totale,
        CAST(floor((20000 + c_custkey % 997 * 17) * 0.48) AS BIGINT) AS pop_enfants_0_14,
        CASE WHEN c_custkey % 24 = 0 THEN NULL ELSE CAST(100 + c_custkey % 50 AS DOUBLE) END AS superficie_km2,
        CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE CAST(60 + c_custkey * 7 % 40 AS DOUBLE) END AS taux_vaccination,
        CAST(c_custkey * 7919 % 1000 AS DOUBLE) / 8 AS longitude, CAST(c_custkey * 104729 % 397 AS DOUBLE) / 8 AS latitude FROM customer"""),
    "site_cases": ((), "SELECT concat('site_', o_custkey) AS health_area, count(*) AS cases FROM orders GROUP BY 1"),
    "segments": ((), """SELECT x1, y1, x1 + k % 7 - 3 AS x2, y1 + k % 5 - 2 AS y2 FROM (SELECT s_suppkey AS k,
        CAST(s_suppkey * 3767 % 1000 AS DOUBLE) / 8 AS x1, CAST(s_suppkey * 9109 % 397 AS DOUBLE) / 8 AS y1 FROM supplier)"""),
    "dirty_names": ((), """SELECT lower(n_name) AS truth, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name)
        WHEN 1 THEN concat(' ', upper(n_name), ' ') WHEN 2 THEN replace(lower(n_name), '_', '-')
        ELSE replace(lower(n_name), 'nation', 'natien') END AS raw_name FROM nation"""),
    "age_bands": ((), """SELECT CASE c_custkey % 8 WHEN 0 THEN '0_4' WHEN 1 THEN '5_9' WHEN 2 THEN '10_14' WHEN 3 THEN '15_19'
        WHEN 4 THEN '20_24' WHEN 5 THEN '25_29' WHEN 6 THEN '30_34' ELSE '35_plus' END AS band,
        CASE WHEN (c_custkey // 8) % 3 = 0 THEN 'M' ELSE 'F' END AS sex,
        CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 12 WHEN 2 THEN 60 ELSE 120 END AS band_start,
        CASE c_custkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 48 WHEN 2 THEN 48 ELSE 60 END AS band_months,
        count(*) AS population FROM customer GROUP BY ALL"""),
    "forecast": (("panel", "extent"), """SELECT health_area, CAST(isoyear(d) AS INT) AS year, CAST(week(d) AS INT) AS week_, target AS week_index,
        concat(CAST(isoyear(d) AS INT), '-S', lpad(CAST(week(d) AS VARCHAR), 2, '0')) AS period, horizon, cases AS predicted_cases
        FROM (SELECT health_area, cases, CAST(week_index + 52 AS INT) AS target, CAST(week_index + 52 - n_weeks + 1 AS INT) AS horizon,
              CAST(monday0 AS DATE) + CAST((week_index + 52) * 7 AS INT) AS d
              FROM panel, extent WHERE week_index + 52 - n_weeks + 1 BETWEEN 1 AND 4)"""),
    "lagged": (("panel",), """SELECT *, lag(cases, 1) OVER w AS lag1, lag(cases, 52) OVER w AS lag52,
        avg(cases) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_area,
        avg(cases) OVER (PARTITION BY health_area, week_ ORDER BY week_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_season
        FROM panel WINDOW w AS (PARTITION BY health_area ORDER BY week_index)"""),
    "fold_cuts": (("extent",), """SELECT k, CAST(floor(first + k * (n_weeks - first) / 5.0) AS INT) AS low,
        CAST(floor(first + (k + 1) * (n_weeks - first) / 5.0) AS INT) AS high
        FROM (SELECT n_weeks, greatest(CAST(ceil(n_weeks * 0.4) AS INT), 2) AS first, unnest(range(0, 5)) AS k FROM extent)"""),
    "folds": (("fold_cuts", "weeks"), """SELECT CAST(k + 1 AS INT) AS fold, CASE WHEN week_index < low THEN 'train' ELSE 'test' END AS role, week_index
        FROM fold_cuts JOIN weeks ON week_index < low - 4 OR (week_index >= low AND week_index < high)"""),
    "results": (("folds", "lagged"), """SELECT fold, health_area, week_index, cases AS observed, lag1 AS predicted
        FROM folds JOIN lagged USING (week_index) WHERE role = 'test'"""),
    "flagged": (("results",), """SELECT *, observed > 1.5 * avg(observed) OVER w AS tp, predicted > 1.5 * avg(predicted) OVER w AS pp
        FROM results WINDOW w AS (PARTITION BY fold, health_area ORDER BY week_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""),
    "climate_weekly": (("climate_daily",), f"""SELECT health_area, CAST(isoyear(date) AS INT) AS year, CAST(week(date) AS INT) AS week_,
        count(*) AS nb_days, {r('avg(temp)', 2)} AS temp_api, {r('min(temp)', 2)} AS temp_api_min, {r('max(temp)', 2)} AS temp_api_max,
        {r('sum(precip)', 2)} AS precip_api, {r('max(precip)', 2)} AS precip_api_max, {r('avg(humidity)', 2)} AS humidity_api,
        {r('min(humidity)', 2)} AS humidity_api_min, {r('max(humidity)', 2)} AS humidity_api_max
        FROM climate_daily GROUP BY 1, 2, 3"""),
}


def sql(body: str, *views: str) -> str:
    """Prefix ``body`` with the views it needs, in dependency order."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dep in VIEWS[name][0]:
            need(dep)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v][1]})" for v in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body
