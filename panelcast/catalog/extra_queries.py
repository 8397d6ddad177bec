"""Smaller tables of the pages: labels, overlaps, per-week means, recent weeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import isoweek as iso
from ..functions import labels
from ..functions import scalars as sc
from ..operators import baselines as bl
from ..operators import climate, diagnostics, kpi, metrics
from . import fixtures as fx
from . import register, rounded
from .fixtures import r, sql


@register(sql(f"""SELECT health_area, CASE WHEN abs(bias) < 2 THEN 'Bien centré' WHEN bias > 0 THEN 'Sur-estimation' ELSE 'Sous-estimation' END AS bias_label,
    CASE WHEN mean <= 0 THEN '—' WHEN mae / mean * 100 <= 15 THEN 'Excellent' WHEN mae / mean * 100 <= 30 THEN 'Bon' WHEN mae / mean * 100 <= 50 THEN 'Moyen' ELSE 'Élevé' END AS mae_label,
    CASE WHEN mean <= 0 THEN '—' WHEN rmse / mean * 100 <= 20 THEN 'Excellent' WHEN rmse / mean * 100 <= 40 THEN 'Bon' WHEN rmse / mean * 100 <= 70 THEN 'Moyen' ELSE 'Élevé' END AS rmse_label
    FROM (SELECT health_area, {r('avg(predicted - observed)')} AS bias, {r('avg(abs(predicted - observed))')} AS mae,
      {r('sqrt(avg((predicted - observed) * (predicted - observed)))')} AS rmse, {r('avg(observed)')} AS mean FROM results GROUP BY 1)""", "results"))
def quality_labels(spark, sf):
    table = rounded(metrics.metrics_summary(fx.validation_results(fx.panel(spark, sf)), by=["health_area"]))
    return table.select("health_area", labels.bias_label("bias").alias("bias_label"), labels.mae_label("mae", "mean_observed").alias("mae_label"),
                        labels.rmse_label("rmse", "mean_observed").alias("rmse_label"))


@register(sql(f"""SELECT CAST(horizon AS INT) AS horizon, {r('1 - p / nullif(s, 0)')} AS skill FROM (
    SELECT 1 AS horizon, avg(abs(lag1 - cases)) AS p, avg(abs(lag52 - cases)) AS s FROM lagged WHERE lag52 IS NOT NULL)""", "lagged"))
def skill_of_persistence(spark, sf):
    rows = bl.baseline_predictions(fx.panel(spark, sf)).where(F.col(bl.SEASONAL).isNotNull())
    errors = rows.agg(*[F.avg(F.abs(F.col(c) - F.col("cases"))).alias(c) for c in (bl.PERSISTENCE, bl.SEASONAL)])
    return rounded(errors.select(F.lit(1).alias("horizon"), sc.skill_score(bl.PERSISTENCE, bl.SEASONAL).alias("skill")))


@register(sql("SELECT DISTINCT week_index FROM panel WHERE year = 1998 AND week_ > 50 INTERSECT SELECT week_index FROM panel WHERE week_ = 53", "panel"))
def shared_weeks(spark, sf):
    panel = fx.panel(spark, sf)
    return diagnostics.week_overlap(panel.where("year = 1998 and week_ > 50"), panel.where("week_ = 53"))


@register(sql("SELECT health_area FROM cases_weekly WHERE year = 1995 INTERSECT SELECT health_area FROM cases_weekly WHERE year = 2001", "cases_weekly"))
def shared_areas(spark, sf):
    cases = fx.cases_weekly(spark, sf)
    return diagnostics.area_overlap(cases.where("year = 1995"), cases.where("year = 2001"))


@register(sql("SELECT p.health_area, p.week_index, p.cases FROM panel p, extent WHERE p.week_index >= n_weeks - 8", "panel", "extent"))
def recent_weeks(spark, sf):
    return diagnostics.recent_weeks(fx.panel(spark, sf), 8).select("health_area", "week_index", "cases")


@register(sql(f"SELECT year, week_, {r('avg(temp_api)')} AS temp_api, {r('avg(precip_api)')} AS precip_api, {r('avg(humidity_api)')} AS humidity_api FROM climate_weekly GROUP BY 1, 2", "climate_weekly"))
def climate_week_means(spark, sf):
    return rounded(climate.mean_by(climate.climate_by_week(fx.climate_daily(spark, sf)), ["year", "week_"]))


@register(sql(f"""SELECT health_area, CAST(sum(cases) AS BIGINT) AS cases, {r('avg(rate)')} AS rate FROM (SELECT health_area, cases, cases * 10000.0 / pop_totale AS rate
    FROM cases_weekly JOIN population USING (health_area)) GROUP BY 1 HAVING sum(cases) > 0""", "cases_weekly", "population"))
def area_totals(spark, sf):
    joined = fx.cases_weekly(spark, sf).join(fx.population(spark, sf), "health_area")
    return rounded(kpi.area_totals(kpi.attack_rate(joined, "pop_totale", name="rate"), "rate"))


@register(sql("SELECT health_area, pop_totale, CAST(coalesce(cases, 0) AS BIGINT) AS cases FROM sites LEFT JOIN site_cases USING (health_area)", "sites", "site_cases"))
def layer_totals(spark, sf):
    totals = fx.site_cases(spark, sf).withColumn("deaths", F.lit(0))
    return kpi.layer_with_cases(fx.sites(spark, sf).select("health_area", "pop_totale"), totals).select("health_area", "pop_totale", "cases")


@register(sql("""SELECT year, week_, CAST(CAST(date_trunc('week', make_date(year, 1, 4)) AS DATE) + CAST((least(week_, 52) - 1) * 7 AS INT) AS DATE) AS onset, count(*) AS n
    FROM (SELECT CAST(isoyear(l_shipdate) AS INT) AS year, CAST(week(l_shipdate) AS INT) AS week_ FROM lineitem) GROUP BY 1, 2, 3"""))
def onset_from_week(spark, sf):
    weeks = fx.table(spark, sf, "lineitem").groupBy(iso.iso_year("l_shipdate").alias("year"), iso.iso_week("l_shipdate").alias("week_")).agg(
        F.count(F.lit(1)).alias("n"))
    return weeks.select("year", "week_", iso.onset_from_week("year", "week_", 52).alias("onset"), "n")


@register(sql("""SELECT health_area, sexe, issue, CASE WHEN age_mois BETWEEN 1 AND 60 THEN '1-60' WHEN age_mois > 60 THEN '61+' ELSE '?' END AS age_class, count(*) AS n
    FROM linelist GROUP BY 1, 2, 3, 4""", "linelist"))
def outcome_table(spark, sf):
    """Every case, split at 60 months."""
    age = F.when(F.col("age_mois").between(1, 60), "1-60").when(F.col("age_mois") > 60, "61+").otherwise("?")
    return fx.linelist(spark, sf).groupBy("health_area", "sexe", "issue", age.alias("age_class")).agg(F.count(F.lit(1)).alias("n"))


@register(sql("SELECT health_area, sexe, issue, count(*) AS n FROM linelist GROUP BY 1, 2, 3", "linelist"))
def outcome_table_all_ages(spark, sf):
    """Every case of the line list, without the split by age of ``outcome_table``."""
    return fx.linelist(spark, sf).groupBy("health_area", "sexe", "issue").agg(F.count(F.lit(1)).alias("n"))


@register(sql("""SELECT CASE WHEN o_totalprice > 400000 THEN 'Urbain' WHEN o_totalprice > 200000 THEN 'semi-urbain' WHEN o_totalprice > 100000 THEN 'RURAL' ELSE '?' END AS label,
    CASE WHEN o_totalprice > 400000 THEN 2.0::DOUBLE WHEN o_totalprice > 200000 THEN 1.0::DOUBLE WHEN o_totalprice > 100000 THEN 0.0::DOUBLE END AS code, count(*) AS n FROM orders GROUP BY 1, 2"""))
def urban_codes(spark, sf):
    price = F.col("o_totalprice")
    label = F.when(price > 400000, "Urbain").when(price > 200000, "semi-urbain").when(price > 100000, "RURAL").otherwise("?")
    rows = fx.table(spark, sf, "orders").select(label.alias("label"))
    return rows.groupBy("label", sc.urban_code("label").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@register(sql("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (v IS NOT NULL) AS BIGINT) AS n_kept FROM (SELECT CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS v FROM lineitem)"))
def scrubbed_ratio(spark, sf):
    from ..operators.clean import scrub
    wild = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_tax", "l_discount"))
    rows = scrub(fx.table(spark, sf, "lineitem").select(wild.alias("v")), ["v"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_kept"))


@register(sql("SELECT CASE WHEN \"Annee\" IS NULL THEN 0 ELSE \"Annee\" END AS year, count(*) AS n FROM (SELECT CAST(isoyear(o_orderdate) AS INT) AS \"Annee\" FROM orders) GROUP BY 1"))
def harmonised_years(spark, sf):
    """Foreign headers and missing years: even orders only carry the year in ``period``."""
    from ..operators.clean import clean_cases, harmonise_cases, infer_year
    year = iso.iso_year("o_orderdate")
    raw = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("Aire de Sante"), iso.iso_week("o_orderdate").cast("string").alias("Semaine"), F.lit("1").alias("Nb cas"),
        F.when(F.col("o_orderkey") % 2 == 1, year.cast("string")).alias("Annee"), iso.period_label(year, iso.iso_week("o_orderdate")).alias("period"))
    return infer_year(clean_cases(harmonise_cases(raw))).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


