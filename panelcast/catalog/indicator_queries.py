"""Line-list, indicator, climate, risk and name-matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import climate, kpi, linelist, matching, ranking, risk
from . import fixtures as fx
from . import register, rounded
from .fixtures import r, sql

# ---------------------------------------------------------------------------
# line list
# ---------------------------------------------------------------------------
_UNVAX = "avg(CASE WHEN statut_vaccinal = 'Non' THEN 100.0 ELSE 0.0 END)"


@register(sql(f"SELECT health_area, year, week_, count(*) AS cases, {r('avg(age_mois)')} AS mean_age FROM linelist GROUP BY 1, 2, 3", "linelist"))
def weekly_rollup(spark, sf):
    return rounded(linelist.weekly_rollup(fx.linelist(spark, sf)))


@register(sql(f"SELECT health_area, count(*) AS cases, {r('avg(age_mois)')} AS mean_age, {r(_UNVAX)} AS pct_unvaccinated FROM linelist GROUP BY 1", "linelist"))
def area_rollup(spark, sf):
    return rounded(linelist.area_rollup(fx.linelist(spark, sf)))


_CURVE = """SELECT year, week_, count(*) AS cases, concat(year, '-S', lpad(CAST(week_ AS VARCHAR), 2, '0')) AS label,
    CAST(year * 100 + week_ AS INT) AS sort_key FROM linelist GROUP BY 1, 2"""


@register(sql(_CURVE, "linelist"))
def epi_curve(spark, sf):
    return linelist.epidemic_curve(fx.linelist(spark, sf))


@register(sql(f"SELECT health_area, {r(_UNVAX)} AS \"Part_NonVaccines_Cas\" FROM linelist WHERE statut_vaccinal IN ('Oui', 'Non') GROUP BY 1", "linelist"))
def unvaccinated_share(spark, sf):
    return rounded(linelist.unvaccinated_share_of_known(fx.linelist(spark, sf)))


@register(sql(f"""SELECT age_band, count(*) AS cases, {r(_UNVAX)} AS pct_unvaccinated FROM (SELECT *, CASE WHEN age_mois > 0 AND age_mois <= 12 THEN '0-1 an'
    WHEN age_mois > 12 AND age_mois <= 60 THEN '1-5 ans' WHEN age_mois > 60 AND age_mois <= 120 THEN '5-10 ans'
    WHEN age_mois > 120 AND age_mois <= 180 THEN '10-15 ans' END AS age_band FROM linelist) WHERE age_band IS NOT NULL GROUP BY 1""", "linelist"))
def age_bands(spark, sf):
    return rounded(linelist.age_distribution(fx.linelist(spark, sf)))


@register(sql(f"""SELECT count(*) AS total_cases, {r(_UNVAX)} AS pct_unvaccinated, {r(_UNVAX + ' - 45')} AS delta_45, {r('quantile_cont(age_mois, 0.5)')} AS median_age,
    {r("avg(CASE WHEN issue = 'Décédé' THEN 100.0 ELSE 0.0 END)")} AS lethality_pct, count(DISTINCT health_area) AS n_areas,
    {r('100.0 * count(DISTINCT health_area) / (SELECT count(*) FROM layer)')} AS pct_areas FROM linelist""", "linelist", "layer"))
def kpi_measles(spark, sf):
    return rounded(linelist.kpi_measles(fx.linelist(spark, sf), fx.layer(spark, sf)))


@register(sql(f"""SELECT label, cases, sort_key, {r('''CASE WHEN n <= 5 THEN NULL
    WHEN i = 0 THEN (32*l0 + 15*l1 + 3*l2 - 4*l3 - 6*l4 - 3*l5 + 5*l6) / 42.0
    WHEN i = 1 THEN (15*p1 + 12*l0 + 9*l1 + 6*l2 + 3*l3 + 0*l4 - 3*l5) / 42.0
    WHEN i = 2 THEN (3*p2 + 9*p1 + 12*l0 + 12*l1 + 9*l2 + 3*l3 - 6*l4) / 42.0
    WHEN i = n - 1 THEN (32*l0 + 15*p1 + 3*p2 - 4*p3 - 6*p4 - 3*p5 + 5*p6) / 42.0
    WHEN i = n - 2 THEN (15*l1 + 12*l0 + 9*p1 + 6*p2 + 3*p3 - 3*p5) / 42.0
    WHEN i = n - 3 THEN (3*l2 + 9*l1 + 12*l0 + 12*p1 + 9*p2 + 3*p3 - 6*p4) / 42.0
    ELSE (-2*p3 + 3*p2 + 6*p1 + 7*l0 + 6*l1 + 3*l2 - 2*l3) / 21.0 END''')} AS trend FROM (
    SELECT label, cases, sort_key, row_number() OVER w - 1 AS i, count(*) OVER () AS n, cases AS l0, {', '.join(f'lead(cases, {k}) OVER w AS l{k}, lag(cases, {k}) OVER w AS p{k}' for k in range(1, 7))}
    FROM ({_CURVE}) WINDOW w AS (ORDER BY sort_key))""", "linelist"))
def epi_trend(spark, sf):
    return rounded(linelist.savgol_trend(linelist.epidemic_curve(fx.linelist(spark, sf))).select("label", "cases", "sort_key", "trend"))


@register(sql(f"""SELECT arg_max(label, (cases, -sort_key)) AS peak_label, max(cases) AS peak_cases, {r('avg(cases)')} AS weekly_mean,
    arg_max(cases - prev, sort_key) AS last_variation, {r('arg_max((cases - prev) * 100.0 / prev, sort_key)')} AS last_variation_pct
    FROM (SELECT *, lag(cases) OVER (ORDER BY sort_key) AS prev FROM ({_CURVE}))""", "linelist"))
def curve_summary(spark, sf):
    return rounded(linelist.curve_summary(linelist.epidemic_curve(fx.linelist(spark, sf))))


@register(sql("""SELECT health_area AS "Aire_Sante", year AS "Annee", week_ AS "Semaine_Epi", CAST(i AS BIGINT) AS rang, CASE WHEN i <= deaths THEN 'Décédé' ELSE 'Guéri' END AS "Issue"
    FROM cases_weekly, LATERAL (SELECT unnest(generate_series(1, cases)) AS i)""", "cases_weekly"))
def case_expansion(spark, sf):
    return linelist.expand_counts(fx.cases_weekly(spark, sf)).select("Aire_Sante", "Annee", "Semaine_Epi", "rang", "Issue")


@register(sql("""SELECT "Semaine_Epi", "Annee", count(*) AS n, min("Date_Notification") AS first_notified, count(DISTINCT "ID_Cas") AS n_ids FROM (
    SELECT row_number() OVER () AS "ID_Cas", CAST(week(l_shipdate) AS INT) AS "Semaine_Epi", CAST(isoyear(l_shipdate) AS INT) AS "Annee",
    CAST(CAST(l_shipdate AS DATE) + 3 AS DATE) AS "Date_Notification" FROM lineitem) GROUP BY 1, 2"""))
def linelist_defaults(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("Date_Debut_Eruption"))
    full = linelist.complete_linelist(lines, default_area="inconnue")
    # a number is a few bytes in a shuffle and far more in the set of a task: tasks follow the rows, not the bytes
    tasks = max(1, -(-lines.count() // ranking.UNROLLED))
    full = full.repartition(tasks, "Semaine_Epi", "Annee", "ID_Cas")
    return full.groupBy("Semaine_Epi", "Annee").agg(F.count(F.lit(1)).alias("n"), F.min("Date_Notification").alias("first_notified"),
                                                    F.countDistinct("ID_Cas").alias("n_ids"))


@register(sql("SELECT count(*) AS n, count(*) AS n_ids, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id FROM orders"))
def sequential_ids(spark, sf):
    rows = fx.table(spark, sf, "orders").select("o_orderstatus", "o_custkey")
    ids = ranking.sequential_id(rows, "id")
    return ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register(sql("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders"))
def global_positions(spark, sf):
    rows = fx.table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    return ranking.global_rank(rows, ["o_totalprice", "o_orderkey"], "position").select("o_orderkey", "position")


@register(sql(f"""SELECT delay, count(*) AS n FROM (SELECT datediff('day', CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INT)) AS delay FROM lineitem) GROUP BY 1"""))
def notification_delay(spark, sf):
    day = F.col("l_shipdate").cast("date")
    lines = fx.table(spark, sf, "lineitem").select(day.alias("Date_Debut_Eruption"), F.date_add(day, F.col("l_linenumber").cast("int")).alias("Date_Notification"))
    return linelist.notification_delay(lines).groupBy(F.col("Delai_Notification").cast("bigint").alias("delay")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# indicators
# ---------------------------------------------------------------------------
@register(sql(f"""SELECT CAST(sum(cases) AS BIGINT) AS total_cases, CAST(sum(deaths) AS BIGINT) AS total_deaths, count(DISTINCT health_area) AS n_areas,
    count(DISTINCT week_) AS n_weeks, {r('CASE WHEN sum(cases) > 0 THEN sum(deaths) * 100.0 / sum(cases) ELSE 0 END')} AS cfr_pct FROM cases_weekly""", "cases_weekly"))
def kpi_malaria(spark, sf):
    return rounded(kpi.kpi_malaria(fx.cases_weekly(spark, sf)))


@register(sql(f"""SELECT {r('sum(cases) * 10000.0 / sum(pop_totale)')} AS incidence_10000, {r('sum(cases) * 1000.0 / sum(pop_enfants_0_14)')} AS child_attack_1000,
    {r('sum(cases) * 10000.0 / sum(pop_totale) / count(cases)')} AS incidence_per_area, {r('avg(cases * 10000.0 / pop_totale)')} AS mean_area_incidence,
    CAST(sum(pop_totale) AS BIGINT) AS population, CAST(sum(pop_enfants_0_14) AS BIGINT) AS children, {r('avg(pop_totale / superficie_km2)')} AS mean_density
    FROM population FULL JOIN (SELECT health_area, sum(cases) AS cases FROM cases_weekly GROUP BY 1) USING (health_area)""", "cases_weekly", "population"))
def kpi_population(spark, sf):
    return rounded(kpi.kpi_population(fx.cases_weekly(spark, sf), fx.population(spark, sf)))


@register(sql("SELECT year, week_, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths FROM cases_weekly GROUP BY 1, 2", "cases_weekly"))
def weekly_curve(spark, sf):
    return kpi.per_period(fx.cases_weekly(spark, sf))


_TOTALS = "(SELECT health_area, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths FROM cases_weekly GROUP BY 1)"


@register(sql(f"SELECT * FROM (SELECT health_area, cases, {r('cases * 10000.0 / pop_enfants_0_14')} AS attack_rate FROM {_TOTALS} JOIN population USING (health_area)) "
              "ORDER BY attack_rate DESC, health_area LIMIT 10", "cases_weekly", "population"))
def top_areas(spark, sf):
    table = kpi.layer_with_cases(fx.population(spark, sf), fx.cases_weekly(spark, sf))
    rates = rounded(kpi.attack_rate(table, "pop_enfants_0_14"), "attack_rate")
    return kpi.top_areas(rates, "attack_rate").select("health_area", "cases", "attack_rate")


@register(sql(f"""SELECT health_area, CAST(coalesce(cases, 0) AS BIGINT) AS cases, CAST(coalesce(deaths, 0) AS BIGINT) AS deaths,
    {r('coalesce(cases, 0) * 10000.0 / pop_totale')} AS rate_10000, {r('coalesce(cases, 0) * 10000.0 / pop_enfants_0_14')} AS child_rate_10000,
    altitude_moy, taux_vaccination, pop_totale, pop_enfants_0_14, superficie_km2
    FROM layer LEFT JOIN {_TOTALS} USING (health_area) LEFT JOIN population USING (health_area) LEFT JOIN static_b USING (health_area)
    LEFT JOIN vaccination USING (health_area)""", "layer", "cases_weekly", "population", "static_b", "vaccination"))
def area_profile(spark, sf):
    table = kpi.area_profile(fx.layer(spark, sf), fx.cases_weekly(spark, sf), fx.population(spark, sf),
                             fx.static_b(spark, sf).drop("urban_code"), fx.vaccination(spark, sf))
    return rounded(table, "rate_10000", "child_rate_10000")


@register(sql(f"""SELECT count(*) FILTER (cases >= 600) AS n_alert, {r('100.0 * count(*) FILTER (cases >= 600) / count(*)')} AS pct_alert,
    count(*) FILTER (cases = 0) AS n_without_cases, {r('100.0 * count(*) FILTER (cases = 0) / count(*)')} AS pct_without_cases,
    {r('avg(pop_totale / superficie_km2)')} AS mean_density FROM population JOIN {_TOTALS} USING (health_area)""", "population", "cases_weekly"))
def map_counts(spark, sf):
    table = kpi.layer_with_cases(kpi.density_table(fx.population(spark, sf)), fx.cases_weekly(spark, sf))
    return rounded(kpi.map_counts(table, 600))


@register(sql(f"SELECT health_area, cases FROM {_TOTALS} WHERE cases >= 600", "cases_weekly"))
def fixed_threshold_alerts(spark, sf):
    return risk.fixed_threshold_alerts(kpi.area_totals(fx.cases_weekly(spark, sf)), 600)


@register(sql(f"SELECT health_area, pop_totale, superficie_km2, {r('pop_totale / superficie_km2')} AS densite_pop FROM sites", "sites"))
def density_table(spark, sf):
    return rounded(kpi.density_table(fx.sites(spark, sf)).select("health_area", "pop_totale", "superficie_km2", "densite_pop"))


@register(sql("SELECT health_area, year, CAST(sum(cases) AS BIGINT) AS population FROM cases_weekly WHERE year = 1996 GROUP BY 1, 2", "cases_weekly"))
def population_vintage(spark, sf):
    """One vintage out of a multi-year table."""
    table = fx.cases_weekly(spark, sf).groupBy("health_area", "year").agg(F.sum("cases").alias("population"))
    return kpi.select_vintage(table, 1996)[0]


@register(sql("""SELECT health_area, coalesce(a.altitude_moy, b.altitude_moy) AS altitude_moy, urban_code FROM static_a a LEFT JOIN static_b b USING (health_area)""",
              "static_a", "static_b"))
def static_merge(spark, sf):
    return kpi.merge_static_tables(fx.static_a(spark, sf), fx.static_b(spark, sf))


@register(sql(f"""SELECT variable, count(v) AS n_renseigne, {r('100.0 * count(v) / count(*)', 1)} AS pct, {r('min(v)', 3)} AS min, {r('max(v)', 3)} AS max, '' AS unite, '' AS source
    FROM (SELECT unnest(['altitude_moy']) AS variable, unnest([altitude_moy]) AS v FROM static_a) GROUP BY 1""", "static_a"))
def static_coverage(spark, sf):
    return kpi.describe_coverage(fx.static_a(spark, sf))


@register(sql(f"""SELECT health_area, taux_vaccination AS "Taux_Vaccination", {r('CASE WHEN taux_vaccination IS NULL THEN NULL ELSE greatest(0, 95 - taux_vaccination) END')} AS "Gap_Immunite_Collective",
    CASE WHEN taux_vaccination < 95 THEN 1.0::DOUBLE WHEN taux_vaccination IS NOT NULL THEN 0.0::DOUBLE END AS "Zone_Sous_Seuil",
    {r('(1 - taux_vaccination / 100) * pop_enfants_0_14')} AS "Susceptibles_Estimes" FROM sites""", "sites"))
def vaccination_gap(spark, sf):
    sites = fx.sites(spark, sf)
    layer = kpi.enrich_layer(sites.select("health_area"), population=sites.select("health_area", "pop_enfants_0_14"),
                             vaccination=sites.select("health_area", F.col("taux_vaccination").alias("Taux_Vaccination")))
    table = kpi.vaccination_features(layer, children="pop_enfants_0_14")
    return rounded(table.select("health_area", "Taux_Vaccination", "Gap_Immunite_Collective", "Zone_Sous_Seuil", "Susceptibles_Estimes"))


@register(sql("SELECT band, CAST(sum(CASE WHEN sex = 'M' THEN population ELSE 0 END) AS BIGINT) AS male, CAST(sum(CASE WHEN sex = 'F' THEN population ELSE 0 END) AS BIGINT) AS female FROM age_bands GROUP BY 1", "age_bands"))
def age_pyramid(spark, sf):
    return kpi.age_pyramid(fx.age_bands(spark, sf))


@register(sql(f"""SELECT CAST(sum(CASE WHEN band <> '35_plus' THEN population ELSE 0 END) AS BIGINT) AS under_35, CAST(sum(population) AS BIGINT) AS total,
    {r("100.0 * sum(CASE WHEN band <> '35_plus' THEN population ELSE 0 END) / sum(population)")} AS pct_under_35 FROM age_bands""", "age_bands"))
def under_35_share(spark, sf):
    return rounded(kpi.under_35_share(fx.age_bands(spark, sf)))


@register(sql(f"""SELECT CASE WHEN k = 0 THEN '0-14 ans' ELSE '15+ ans' END AS band, {r('CASE WHEN k = 0 THEN c * 0.51 ELSE greatest(t - c, 0) * 0.48 END')} AS male,
    {r('CASE WHEN k = 0 THEN c * 0.49 ELSE greatest(t - c, 0) * 0.52 END')} AS female
    FROM (SELECT sum(pop_totale) AS t, sum(pop_enfants_0_14) AS c FROM sites), (SELECT unnest([0, 1]) AS k)""", "sites"))
def simplified_pyramid(spark, sf):
    return rounded(kpi.simplified_pyramid(fx.sites(spark, sf)))


@register(sql("""SELECT CASE WHEN band_start < 60 THEN '0-4 ans' WHEN band_start < 120 THEN '5-9 ans' ELSE '10-14 ans' END AS band,
    CAST(sum(CASE WHEN sex = 'M' THEN population ELSE 0 END) AS BIGINT) AS male, CAST(sum(CASE WHEN sex = 'F' THEN population ELSE 0 END) AS BIGINT) AS female
    FROM age_bands GROUP BY 1""", "age_bands"))
def child_pyramid(spark, sf):
    return kpi.child_pyramid(fx.age_bands(spark, sf))


@register(sql(f"""SELECT {r('arg_min(band_start + (half - (upto - t)) / t * band_months, band_start)')} AS median_age_months FROM (
    SELECT band_start, band_months, t, sum(t) OVER (ORDER BY band_start) AS upto, sum(t) OVER () / 2.0 AS half
    FROM (SELECT band_start, band_months, sum(population) AS t FROM age_bands GROUP BY 1, 2)) WHERE upto >= half""", "age_bands"))
def grouped_median_age(spark, sf):
    return rounded(kpi.grouped_median_age(fx.age_bands(spark, sf)))


# ---------------------------------------------------------------------------
# correlation
# ---------------------------------------------------------------------------
_COLUMNS = ["cases", "deaths", "temp_api", "precip_api", "humidity_api"]
_CORR_VIEW = """obs AS (SELECT cases, deaths, temp_api, precip_api, humidity_api FROM panel LEFT JOIN climate_weekly USING (health_area, year, week_))"""


def _corr_base() -> str:
    return sql("", "panel", "climate_weekly").rstrip() + ",\n" + _CORR_VIEW + ",\n m AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, " + (f"corr({a}, {b})" if a != b else "max(1.0::DOUBLE)") + " AS r FROM obs"
        for a in _COLUMNS for b in _COLUMNS) + ")\n"


def _observations(spark, sf):
    weekly = climate.climate_by_week(fx.climate_daily(spark, sf))
    return fx.panel(spark, sf).join(weekly, ["health_area", "year", "week_"], "left")


@register(_corr_base() + f"SELECT variable_1, variable_2, {r('r')} AS r FROM m")
def correlations(spark, sf):
    return rounded(kpi.correlation_matrix(_observations(spark, sf), _COLUMNS))


@register(_corr_base() + f"""SELECT variable_2 AS variable, {r('r')} AS r, CASE WHEN r > 0.2 THEN 'positive' WHEN r < -0.2 THEN 'negative' ELSE 'weak' END AS sign,
    abs(r) > 0.3 AND sum(CASE WHEN abs(r) > 0.3 THEN 1 ELSE 0 END) OVER (ORDER BY r DESC, variable_2) <= 6 AS plotted,
    variable_2 <> 'deaths' AND row_number() OVER (ORDER BY CASE WHEN variable_2 <> 'deaths' THEN abs(r) ELSE -1 END DESC, variable_2) = 1 AS key_variable
    FROM m WHERE variable_1 = 'cases' AND variable_2 <> 'cases' AND r IS NOT NULL""")
def correlation_screening(spark, sf):
    return rounded(kpi.correlation_screening(kpi.correlation_matrix(_observations(spark, sf), _COLUMNS)))


@register(sql("", "panel", "climate_weekly").rstrip() + ",\n" + _CORR_VIEW + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, {r(f'regr_slope(cases, {c})')} AS slope, {r(f'regr_intercept(cases, {c})')} AS intercept, {r(f'regr_r2(cases, {c})')} AS r2 FROM obs"
    for c in _COLUMNS[2:]))
def ols_trend(spark, sf):
    return rounded(kpi.ols_trend(_observations(spark, sf), _COLUMNS[2:]))


@register(sql(f"""SELECT health_area, {r('coef')} AS coef_population, CASE WHEN coef > 1.2 THEN 'Risque élevé' WHEN coef < 0.8 THEN 'Risque faible' ELSE 'Risque moyen' END AS label FROM (
    SELECT health_area, greatest(0.5, least(2.0, (m / pop_totale) / (sum(m) OVER () / sum(pop_totale) OVER ()))) AS coef
    FROM (SELECT health_area, avg(cases) AS m FROM cases_weekly GROUP BY 1) JOIN population USING (health_area))""", "cases_weekly", "population"))
def adjustment_coef(spark, sf):
    return rounded(kpi.adjustment_coefficient(fx.cases_weekly(spark, sf), fx.population(spark, sf)))


@register(sql("""SELECT health_area, period, sum(cases) AS cases FROM panel WHERE health_area IN (
    SELECT health_area FROM panel GROUP BY 1 ORDER BY sum(cases) DESC, health_area LIMIT 15) GROUP BY 1, 2""", "panel"))
def heat_matrix(spark, sf):
    return kpi.heat_cells(fx.panel(spark, sf))


@register()
def heat_matrix_wide(spark, sf):
    """The pivoted form of ``heat_matrix``."""
    return kpi.heat_matrix(fx.panel(spark, sf))


# ---------------------------------------------------------------------------
# climate
# ---------------------------------------------------------------------------
@register(sql("SELECT * FROM climate_weekly", "climate_weekly"))
def climate_weekly(spark, sf):
    return climate.climate_by_week(fx.climate_daily(spark, sf))


@register(sql(f"""SELECT health_area, CAST(year(date) AS INT) AS year, CAST((dayofyear(date) - 1) // 7 + 1 AS INT) AS week_, count(*) AS nb_days, {r('avg(temp)', 2)} AS temp_api,
    {r('sum(precip)', 2)} AS precip_api, {r('avg(humidity)', 2)} AS humidity_api FROM climate_daily GROUP BY 1, 2, 3""", "climate_daily"))
def climate_weekly_jan1(spark, sf):
    return climate.climate_by_week(fx.climate_daily(spark, sf), calendar="jan1").select(
        "health_area", "year", "week_", "nb_days", "temp_api", "precip_api", "humidity_api")


@register(sql(f"SELECT health_area, {r('avg(temp_api)')} AS temp_api, {r('avg(precip_api)')} AS precip_api, {r('avg(humidity_api)')} AS humidity_api FROM climate_weekly GROUP BY 1", "climate_weekly"))
def climate_area_means(spark, sf):
    return rounded(climate.mean_by(climate.climate_by_week(fx.climate_daily(spark, sf)), ["health_area"]))


@register(sql(" UNION ALL ".join(f"""SELECT '{c}' AS variable, count({c}) AS n, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min,
    {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50, {r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'max({c})')} AS max FROM climate_weekly"""
    for c in climate.WEEKLY), "climate_weekly"))
def climate_describe(spark, sf):
    return rounded(climate.describe(climate.climate_by_week(fx.climate_daily(spark, sf))))


@register(sql(f"""SELECT count(DISTINCT health_area) AS n_areas, count(DISTINCT (year, week_)) AS n_weeks, {r('100.0 * count(DISTINCT health_area) / (SELECT count(*) FROM layer)')} AS pct_areas,
    {r('100.0 * count(DISTINCT (year, week_)) / 417')} AS pct_weeks FROM climate_weekly""", "climate_weekly", "layer"))
def climate_coverage(spark, sf):
    return rounded(climate.coverage(climate.climate_by_week(fx.climate_daily(spark, sf)), fx.layer(spark, sf), 417))


@register(sql(f"""SELECT health_area, {r('avg(temp)')} AS "Temperature_Moy", {r('avg(humidity)')} AS "Humidite_Moy", {r('avg(humidity) * 0.7')} AS "Saison_Seche_Humidite" FROM climate_daily GROUP BY 1""", "climate_daily"))
def climate_measles(spark, sf):
    return rounded(climate.area_climate(fx.climate_daily(spark, sf)))


@register(sql("SELECT health_area, precip_api FROM layer LEFT JOIN (SELECT * FROM climate_weekly WHERE year = 1997 AND week_ = 20) USING (health_area)", "climate_weekly", "layer"))
def climate_map(spark, sf):
    return climate.climate_map(fx.layer(spark, sf), climate.climate_by_week(fx.climate_daily(spark, sf)), 1997, 20, "precip_api")


@register(sql(f"""SELECT health_area, {r('exp(-((temp_api - 27.5) ** 2) / 50) * humidity_api / 100')} AS climate_index, {r('temp_api * precip_api')} AS heat_rain,
    {r('precip_api / (nb_days + 0.1)')} AS flood_risk, year, week_ FROM climate_weekly""", "climate_weekly"))
def environment_scores(spark, sf):
    from ..functions import scalars as sc
    weekly = climate.climate_by_week(fx.climate_daily(spark, sf))
    return rounded(weekly.select("health_area", sc.climate_suitability("temp_api", "humidity_api").alias("climate_index"),
                                 sc.heat_rain("temp_api", "precip_api").alias("heat_rain"), sc.flood_risk("precip_api", "nb_days").alias("flood_risk"), "year", "week_"))


# ---------------------------------------------------------------------------
# risk
# ---------------------------------------------------------------------------
def _forecast(spark, sf):
    panel = fx.panel(spark, sf)
    return panel, fx.naive_forecast(panel)


@register(sql("SELECT health_area, week_index, predicted_cases FROM forecast WHERE predicted_cases > (SELECT quantile_cont(predicted_cases, 0.75) FROM forecast)", "forecast"))
def alerts_percentile(spark, sf):
    return risk.generate_alerts(_forecast(spark, sf)[1]).select("health_area", "week_index", "predicted_cases")


@register(sql("SELECT health_area, sum(predicted_cases) AS predicted_cases, count(*) AS n_alerts FROM forecast WHERE predicted_cases > (SELECT quantile_cont(predicted_cases, 0.75) FROM forecast) GROUP BY 1", "forecast"))
def alert_totals(spark, sf):
    return risk.alert_totals(risk.generate_alerts(_forecast(spark, sf)[1]))


_WEEK = "(SELECT health_area, coalesce(predicted_cases, 0) AS predicted_cases FROM layer LEFT JOIN (SELECT * FROM forecast WHERE horizon = 2) USING (health_area))"


def _week_alerts(spark, sf):
    panel, forecast = _forecast(spark, sf)
    week = forecast.where("horizon = 2").agg(F.min("week_index")).first()[0]
    return risk.week_alerts(fx.population(spark, sf), forecast, week)


@register(sql(f"SELECT health_area, predicted_cases, predicted_cases > (SELECT quantile_cont(predicted_cases, 0.75) FROM {_WEEK}) AS is_alert FROM {_WEEK}", "forecast", "layer"))
def alerts_week(spark, sf):
    return _week_alerts(spark, sf).select("health_area", "predicted_cases", "is_alert")


@register(sql(f"""SELECT sum(predicted_cases) AS total, max(predicted_cases) AS max_cases, arg_max(health_area, (predicted_cases, health_area)) AS max_area, {r('avg(predicted_cases)')} AS mean,
    count(*) FILTER (predicted_cases > t) AS n_alerts, {r('100.0 * count(*) FILTER (predicted_cases > t) / count(*)')} AS pct_alerts
    FROM {_WEEK}, (SELECT quantile_cont(predicted_cases, 0.75) AS t FROM {_WEEK})""", "forecast", "layer"))
def forecast_cards(spark, sf):
    return rounded(risk.forecast_cards(_week_alerts(spark, sf)))


@register(sql(f"""SELECT health_area, predicted_cases, {r('predicted_cases / pop_totale * 10000', 2)} AS rate_10000,
    CASE WHEN predicted_cases > (SELECT quantile_cont(predicted_cases, 0.75) FROM {_WEEK}) THEN 'OUI' ELSE 'Non' END AS alert FROM {_WEEK} JOIN population USING (health_area)""", "forecast", "layer", "population"))
def prediction_table(spark, sf):
    return risk.prediction_table(_week_alerts(spark, sf)).select("health_area", "predicted_cases", "rate_10000", "alert")


_RISK = f"""SELECT health_area, {r('total', 1)} AS predicted_total, {r('v', 1)} AS variation_pct,
    CASE WHEN v >= 20 THEN 'Forte hausse' WHEN v <= -20 THEN 'Forte baisse' WHEN v > 0 THEN 'Légère hausse' ELSE 'Stable/baisse' END AS category, peak_week FROM (
    SELECT health_area, total, peak_week, (total / 4 - m) / (m + 1) * 100 AS v FROM (
      SELECT health_area, sum(predicted_cases) AS total, arg_max(period, (predicted_cases, -week_index)) AS peak_week FROM forecast GROUP BY 1)
    JOIN (SELECT health_area, avg(cases) AS m FROM cases_weekly GROUP BY 1) USING (health_area))"""


def _risk(spark, sf):
    return risk.risk_synthesis(_forecast(spark, sf)[1], fx.cases_weekly(spark, sf), 4)


@register(sql(_RISK, "forecast", "cases_weekly"))
def risk_synthesis(spark, sf):
    return _risk(spark, sf)


@register(sql(f"""SELECT count(*) FILTER (category = 'Forte hausse') AS n_strong_rise, count(*) FILTER (category = 'Légère hausse') AS n_slight_rise,
    count(*) FILTER (category = 'Forte baisse') AS n_strong_fall, count(*) FILTER (category = 'Stable/baisse') AS n_stable, {r('sum(predicted_total)')} AS predicted_total,
    {r('sum(predicted_total) / 4')} AS weekly_mean FROM ({_RISK})""", "forecast", "cases_weekly"))
def risk_counts(spark, sf):
    return rounded(risk.risk_counts(_risk(spark, sf), 4))


@register(sql(f"SELECT health_area, coalesce(predicted_total, 0) AS predicted_total, coalesce(variation_pct, 0) AS variation_pct, coalesce(category, 'Stable/baisse') AS category FROM layer LEFT JOIN ({_RISK}) USING (health_area)", "layer", "forecast", "cases_weekly"))
def risk_layer(spark, sf):
    return risk.risk_layer(fx.layer(spark, sf), _risk(spark, sf)).drop("peak_week")


@register(sql(f"SELECT * FROM ({_RISK}) ORDER BY predicted_total DESC, health_area LIMIT 20", "forecast", "cases_weekly"))
def top_risk_areas(spark, sf):
    return kpi.top_areas(_risk(spark, sf), "predicted_total", 20)


@register(sql("""SELECT health_area, period, CAST(predicted_cases AS DOUBLE) AS predicted_cases, printf('%.1f – %.1f', greatest(predicted_cases - 1, 0), predicted_cases + 1) AS interval, concat('h+', horizon) AS horizon_label
    FROM forecast ORDER BY predicted_cases DESC, health_area, week_index LIMIT 30""", "forecast"))
def top_forecasts(spark, sf):
    forecast = _forecast(spark, sf)[1].withColumns({"q10": F.greatest(F.col("predicted_cases") - 1, F.lit(0.0)), "q90": F.col("predicted_cases") + 1})
    return risk.top_forecasts(forecast).select("health_area", "period", "predicted_cases", "interval", "horizon_label")


@register(sql("SELECT health_area, period, cases, 'Observé' AS type FROM panel UNION ALL SELECT health_area, period, predicted_cases, 'Prédit' FROM forecast", "panel", "forecast"))
def observed_and_predicted(spark, sf):
    return risk.observed_and_predicted(*_forecast(spark, sf))


@register(sql(f"""SELECT health_area, week_index, {r('t')} AS threshold, CASE WHEN t IS NULL THEN NULL WHEN cases > 2 * t THEN 'rouge' WHEN cases > t THEN 'jaune' ELSE 'normal' END AS level FROM (
    SELECT *, avg(cases) OVER w + 2 * stddev_samp(cases) OVER w AS t FROM panel
    WINDOW w AS (PARTITION BY health_area ORDER BY week_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "panel"))
def local_thresholds(spark, sf):
    return rounded(risk.local_thresholds(fx.panel(spark, sf)).select("health_area", "week_index", "threshold", "level"))


@register(sql(f"""SELECT health_area, week_index, {r('rate')} AS weekly_rate, above, two AS two_weeks, {r('month')} AS attack_4w, two OR month > 50 AS confirmed FROM (
    SELECT *, above AND coalesce(lag(above) OVER w, false) AS two, sum(rate) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS month FROM (
      SELECT health_area, week_index, cases / pop_enfants_0_14 * 10000 AS rate, cases / pop_enfants_0_14 * 10000 >= 5 AS above FROM panel JOIN population USING (health_area))
    WINDOW w AS (PARTITION BY health_area ORDER BY week_index))""", "panel", "population"))
def outbreak_rules(spark, sf):
    table = risk.outbreak_rules(fx.panel(spark, sf), fx.population(spark, sf))
    return rounded(table.select("health_area", "week_index", "weekly_rate", "above", "two_weeks", "attack_4w", "confirmed"))


# ---------------------------------------------------------------------------
# names
# ---------------------------------------------------------------------------
def _names(spark, sf):
    """The dirty spelling of each customer's nation: as many rows as customers."""
    dirty = fx.dirty_names(spark, sf)
    customer = fx.table(spark, sf, "customer")
    nation = fx.table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("truth"))
    return (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(dirty, "truth")
            .select(F.col("raw_name").alias("health_area"), "truth"))


@register(sql("SELECT DISTINCT raw_name AS health_area FROM dirty_names WHERE raw_name NOT IN (SELECT health_area FROM layer)", "dirty_names", "layer"))
def name_report(spark, sf):
    return matching.unmatched_names(_names(spark, sf), fx.layer(spark, sf))


@register()
def name_suggestions(spark, sf):
    return rounded(matching.unmatched_report(_names(spark, sf), fx.layer(spark, sf)))


@register()
def name_match_best(spark, sf):
    return rounded(matching.best_matches(_names(spark, sf), "health_area", fx.layer(spark, sf)))


@register()
def name_match_strict(spark, sf):
    return rounded(matching.build_auto_health_area_mapping(fx.layer(spark, sf), _names(spark, sf)))


@register(sql("SELECT substr(sha1(concat(CAST(sum(n) AS BIGINT), '|', array_to_string(list_sort(list(d)), '|'))), 1, 12) AS fingerprint FROM (SELECT count(*) AS n, sha1(array_to_string(list_sort(list(health_area)), '|')) AS d FROM (SELECT DISTINCT health_area FROM sites) GROUP BY substr(sha1(health_area), 1, 3))", "sites"))
def layer_fingerprint(spark, sf):
    return matching.layer_fingerprint(fx.sites(spark, sf))


@register(sql("SELECT o_orderkey, match_key FROM (SELECT o_orderkey, trim(regexp_replace(lower(trim(o_orderpriority)), '[\\s\\-_/'']+', ' ', 'g')) AS match_key FROM orders)"))
def match_keys(spark, sf):
    from ..functions.scalars import match_key
    return fx.table(spark, sf, "orders").select("o_orderkey", match_key("o_orderpriority").alias("match_key"))




# Spellings of a customer's area, an invented name of 16 letters.  By the customer's key: a letter left out, a letter doubled
# (both found), another beginning (rejected: the first four letters differ), and a name that two areas are equally close to (rejected: a rival).
_AREA = "substr(md5(CAST(c_custkey AS {text})), 1, 16)"
_SPELLING = """CASE c_custkey % 4 WHEN 0 THEN concat(substr({area}, 1, 8), substr({area}, 10)) WHEN 1 THEN concat({area}, 'z')
    WHEN 2 THEN concat('z', substr({area}, 2)) ELSE concat({area}, 'w') END"""
_REAL = "CASE c_custkey % 4 WHEN 3 THEN concat({area}, {end}) ELSE {area} END"


@register(sql(f"""SELECT {_SPELLING.format(area=_AREA.format(text='VARCHAR'))} AS raw_name, {_AREA.format(text='VARCHAR')} AS health_area,
    {r('CASE c_custkey % 4 WHEN 0 THEN 30.0 / 31 ELSE 32.0 / 33 END')} AS score FROM customer WHERE c_custkey % 4 < 2"""))
def name_match_rivals(spark, sf):
    """The conservative mapping with matches, rejections and rivals."""
    area = _AREA.format(text="STRING")
    customer = fx.table(spark, sf, "customer")
    cases = customer.select(F.expr(_SPELLING.format(area=area)).alias("health_area"))
    layer = customer.select(F.explode(F.expr("array('x', 'y')")).alias("end"), "c_custkey").select(F.expr(_REAL.format(area=area, end="end")).alias("health_area"))
    return rounded(matching.build_auto_health_area_mapping(layer, cases))
