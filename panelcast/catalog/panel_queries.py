"""Panel, time, feature, baseline and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import isoweek as iso
from ..operators import baselines as bl
from ..operators import clean, diagnostics, features, metrics
from ..operators import panel as pn
from ..operators.spatial import build_neighbour_weights
from . import fixtures as fx
from . import register, rounded
from .fixtures import r, sql


@register(sql("SELECT health_area, year, week_, week_index, period, cases, deaths, " + r("(week_ - 1) / 52.1775")
              + " AS week_frac FROM panel", "panel"))
def panel_complete(spark, sf):
    return rounded(fx.panel(spark, sf)).select(
        "health_area", "year", "week_", "week_index", "period", "cases", "deaths", "week_frac")


@register(sql("SELECT health_area, year, week_, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths "
              "FROM cases_weekly GROUP BY 1, 2, 3", "cases_weekly"))
def weekly_aggregation(spark, sf):
    return pn.weekly_totals(fx.cases_weekly(spark, sf))


@register(sql(f"""SELECT count(DISTINCT health_area) AS n_areas, count(DISTINCT week_index) AS n_weeks, count(*) AS n_rows,
    count(DISTINCT health_area) * count(DISTINCT week_index) AS n_rows_expected,
    {r('count(*) * 100.0 / (count(DISTINCT health_area) * count(DISTINCT week_index))', 2)} AS completeness_pct,
    count(*) FILTER (cases = 0) AS n_zero_rows, {r('count(*) FILTER (cases = 0) * 100.0 / count(*)', 2)} AS zero_pct,
    sum(cases) AS total_cases, min(week_index) AS week_index_min, max(week_index) AS week_index_max,
    array_to_string(list_sort(list(DISTINCT year)), ',') AS years FROM panel""", "panel"))
def panel_summary(spark, sf):
    return pn.panel_summary(fx.panel(spark, sf)).withColumn("years", F.concat_ws(",", F.col("years").cast("array<string>")))


@register(sql("""SELECT year, week_, CAST(monday AS DATE) AS monday, CAST(datediff('day', origin, monday) // 7 AS INT) AS week_index,
    CAST(isoyear(monday) AS INT) AS back_year, CAST(week(monday) AS INT) AS back_week, n
    FROM (SELECT year, week_, n, CAST(date_trunc('week', make_date(year, 1, 4)) AS DATE) + CAST((week_ - 1) * 7 AS INT) AS monday,
          CAST(date_trunc('week', make_date(1994, 1, 4)) AS DATE) AS origin
          FROM (SELECT CAST(isoyear(o_orderdate) AS INT) AS year, CAST(week(o_orderdate) AS INT) AS week_, count(*) AS n
                FROM orders GROUP BY 1, 2))"""))
def iso_roundtrip(spark, sf):
    weeks = fx.table(spark, sf, "orders").groupBy(
        iso.iso_year("o_orderdate").alias("year"), iso.iso_week("o_orderdate").alias("week_")).agg(F.count(F.lit(1)).alias("n"))
    index = iso.iso_week_index("year", "week_", 1994)
    year, week = iso.week_index_to_iso(index, 1994)
    return weeks.select("year", "week_", iso.iso_week_to_date("year", "week_").alias("monday"), index.alias("week_index"),
                        year.alias("back_year"), week.alias("back_week"), "n")


@register(sql("""SELECT health_area, year, week_, step,
    CAST(isoyear(d) AS INT) AS future_year, CAST(week(d) AS INT) AS future_week,
    concat(CAST(isoyear(d) AS INT), '-S', lpad(CAST(week(d) AS VARCHAR), 2, '0')) AS label,
    CAST(isoyear(d) * 100 + week(d) AS INT) AS sort_key
    FROM (SELECT *, CAST(date_trunc('week', make_date(year, 1, 4)) AS DATE) + CAST((week_ - 1 + step) * 7 AS INT) AS d
    FROM (SELECT health_area, k // 100 AS year, CAST(k % 100 AS INT) AS week_, CAST(unnest(range(1, 9)) AS INT) AS step
          FROM (SELECT health_area, max(year * 100 + week_) AS k FROM cases_weekly GROUP BY 1)))""", "cases_weekly"))
def future_weeks(spark, sf):
    last = fx.cases_weekly(spark, sf).groupBy("health_area").agg(F.max(iso.sort_key("year", "week_")).alias("k"))
    last = last.select("health_area", F.floor(F.col("k") / 100).cast("int").alias("year"), (F.col("k") % 100).alias("week_"))
    return iso.future_weeks(last, 8)


@register(sql("""SELECT max(year * 100 + week_) // 100 AS year, CAST(max(year * 100 + week_) % 100 AS INT) AS week_ FROM cases_weekly""",
              "cases_weekly"))
def last_observed_week(spark, sf):
    return iso.last_observed_week(fx.cases_weekly(spark, sf))


@register(sql("""SELECT CAST(year(d) AS INT) AS year, CAST((dayofyear(d) - 1) // 7 + 1 AS INT) AS week_,
    CAST(make_date(CAST(year(d) AS INT), 1, 1) + CAST(((dayofyear(d) - 1) // 7) * 7 AS INT) AS DATE) AS week_start, count(*) AS n
    FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1, 2, 3"""))
def jan1_weeks(spark, sf):
    day = F.col("o_orderdate").cast("date")
    rows = fx.table(spark, sf, "orders").select(F.year(day).alias("year"), iso.jan1_week(day).alias("week_"))
    return rows.groupBy("year", "week_", iso.jan1_week_start("year", "week_").alias("week_start")).agg(F.count(F.lit(1)).alias("n"))


@register(sql("""SELECT min(period) AS first_period, max(period) AS last_period, count(DISTINCT period) AS n_periods,
    count(DISTINCT year) AS n_years, count(DISTINCT health_area) AS n_areas, CAST(sum(cases) AS BIGINT) AS total_cases,
    CAST(sum(deaths) AS BIGINT) AS total_deaths
    FROM (SELECT *, concat(year, '-S', lpad(CAST(week_ AS VARCHAR), 2, '0')) AS period FROM cases_weekly)""", "cases_weekly"))
def series_statistics(spark, sf):
    cases = fx.cases_weekly(spark, sf).withColumn("period", iso.period_label("year", "week_"))
    return clean.series_statistics(cases)


@register(sql("""SELECT count(DISTINCT week_) AS n_weeks, CAST(least(100, count(DISTINCT week_) * 1.5 + 40) AS DOUBLE) AS quality FROM cases_weekly""",
              "cases_weekly"))
def data_quality(spark, sf):
    return clean.quality_score(fx.cases_weekly(spark, sf), has_climate=True, has_static=False)


@register(sql("""SELECT bool_or(age_mois IS NOT NULL) AS has_age_mois, bool_or(age_mois > 0) AS has_positive_age,
    bool_or(statut_vaccinal <> 'Inconnu') AS has_statut_vaccinal FROM linelist""", "linelist"))
def availability_flags(spark, sf):
    lines = fx.linelist(spark, sf).withColumn("positive_age", F.col("age_mois"))
    return clean.availability(lines, any_value=["age_mois"], positive=["positive_age"], known=["statut_vaccinal"])


@register(sql("""SELECT CAST(regexp_replace(label, '^.*[WS-]', '') AS INT) AS week_, count(*) AS n FROM (
    SELECT CASE o_orderkey % 3 WHEN 0 THEN concat(CAST(isoyear(o_orderdate) AS INT), '-W', lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0'))
    WHEN 1 THEN concat(CAST(isoyear(o_orderdate) AS INT), '-S', lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0'))
    ELSE CAST(week(o_orderdate) AS VARCHAR) END AS label FROM orders) GROUP BY 1"""))
def week_labels(spark, sf):
    year, week = iso.iso_year("o_orderdate"), iso.iso_week("o_orderdate")
    kind = F.col("o_orderkey") % 3
    label = (F.when(kind == 0, F.format_string("%d-W%02d", year, week)).when(kind == 1, F.format_string("%d-S%02d", year, week))
             .otherwise(week.cast("string")))
    rows = fx.table(spark, sf, "orders").select(label.alias("week_"))
    return clean.normalise_week_labels(rows).groupBy("week_").agg(F.count(F.lit(1)).alias("n"))


@register(sql("SELECT year, week_, health_area, cases FROM cases_weekly WHERE year IN (1996, 1998) AND health_area IN ('nation_3', 'nation_11')",
              "cases_weekly"))
def scope_filter(spark, sf):
    return clean.select_scope(fx.cases_weekly(spark, sf), years=[1996, 1998], weeks=[], areas=[" NATION_3", "nation_11"]).select(
        "year", "week_", "health_area", "cases")


# ---------------------------------------------------------------------------
# features
# ---------------------------------------------------------------------------
_LAGS = ", ".join(f"lag(cases, {k}) OVER w AS cases_lag_{k}" for k in features.DEFAULT_LAGS)
_MEANS = ", ".join(f"{r(f'avg(cases) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)')} AS cases_ma_{k}" for k in features.DEFAULT_WINDOWS)


@register(sql(f"""SELECT health_area, week_index, {_LAGS}, {_MEANS},
    {r('stddev_samp(cases) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)')} AS cases_std_4,
    max(cases) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS cases_max_4,
    {r('greatest(-5, least(5, (lag(cases, 1) OVER w - lag(cases, 2) OVER w) / nullif(lag(cases, 2) OVER w, 0)))')
       .replace('greatest(-5, least(5, ', 'CASE WHEN nullif(lag(cases, 2) OVER w, 0) IS NULL THEN NULL ELSE greatest(-5, least(5, ', 1)
       .replace('OVER w, 0)))', 'OVER w, 0))) END', 1)} AS growth_rate,
    lag(cases, 1) OVER w - lag(cases, 2) OVER w AS cases_diff_1
    FROM panel WINDOW w AS (PARTITION BY health_area ORDER BY week_index)""", "panel"))
def temporal_features(spark, sf):
    df = features.add_temporal_features(fx.panel(spark, sf))
    names = [c for c in features.FEATURE_GROUPS["temporal"] if c != "cases_ewm_4"]
    return rounded(df.select("health_area", "week_index", *names))


_EWM = sql("""SELECT a.health_area, a.week_index, {0} AS cases_ewm_4
    FROM panel a LEFT JOIN panel b ON b.health_area = a.health_area AND b.week_index < a.week_index AND b.week_index >= a.week_index - 80
    GROUP BY 1, 2""".format(r("sum(b.cases * power(0.6, a.week_index - 1 - b.week_index)) / sum(power(0.6, a.week_index - 1 - b.week_index))")), "panel")


@register(_EWM)
def ewm_feature(spark, sf):
    df = features.add_temporal_features(fx.panel(spark, sf), lags=(1,), windows=(4,))
    return rounded(df.select("health_area", "week_index", "cases_ewm_4"))


def _within(aggregate: str, width: int) -> str:
    return f"{aggregate}(b.cases) FILTER (b.week_index >= a.week_index - {width})"


def _ago(k: int) -> str:
    return f"max(b.cases) FILTER (b.week_index = a.week_index - {k})"


_GAPS = f"""WITH weekly AS (SELECT concat('site_', o_custkey) AS health_area, CAST(isoyear(o_orderdate) AS INT) AS year,
    CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(count(*) AS DOUBLE) AS cases FROM orders GROUP BY 1, 2, 3),
    start AS (SELECT CAST(date_trunc('week', make_date(min(year), 1, 4)) AS DATE) AS monday0 FROM weekly),
    p AS (SELECT health_area, CAST(datediff('day', monday0, monday) // 7 AS INT) AS week_index, cases FROM weekly, start)
    SELECT a.health_area, a.week_index, {', '.join(f"{_ago(k)} AS cases_lag_{k}" for k in features.DEFAULT_LAGS)},
    {', '.join(f"{r(_within('avg', w))} AS cases_ma_{w}" for w in features.DEFAULT_WINDOWS)},
    {r(_within('stddev_samp', 4))} AS cases_std_4, {_within('max', 4)} AS cases_max_4,
    {r("sum(b.cases * power(0.6, a.week_index - 1 - b.week_index)) / sum(power(0.6, a.week_index - 1 - b.week_index))")} AS cases_ewm_4,
    CASE WHEN {_ago(1)} IS NOT NULL AND {_ago(2)} IS NOT NULL THEN
    {r(f"greatest(-5, least(5, ({_ago(1)} - {_ago(2)}) / {_ago(2)}))")} END AS growth_rate, {_ago(1)} - {_ago(2)} AS cases_diff_1
    FROM p a LEFT JOIN p b ON b.health_area = a.health_area AND b.week_index < a.week_index GROUP BY 1, 2"""


@register(_GAPS)
def temporal_features_gaps(spark, sf):
    """Customers as areas, only the weeks with an order: lags and windows count calendar weeks."""
    df = features.add_temporal_features(fx.site_panel(spark, sf))
    return rounded(df.select("health_area", "week_index", *features.FEATURE_GROUPS["temporal"]))


@register(sql(f"""SELECT health_area, week_index, {', '.join(
    f"{r(f'{fn}(2 * pi() * {k} * (week_ - 1) / 52.1775)')} AS {fn}_week_{k}" for k in (1, 2) for fn in ('sin', 'cos'))},
    CAST(week_ AS DOUBLE) AS week_of_year, CAST(least(12, greatest(1, floor(week_ / 52.1775 * 12) + 1)) AS DOUBLE) AS month FROM panel""", "panel"))
def seasonality(spark, sf):
    df = features.add_seasonality(fx.panel(spark, sf))
    return rounded(df.select("health_area", "week_index", *features.FEATURE_GROUPS["seasonal"]))


@register(sql(f"""SELECT health_area, week_index, {r('cap(l1, l2) - cap(l2, l3)')
    .replace('cap(l1, l2)', 'CASE WHEN l2 = 0 THEN NULL ELSE greatest(-5, least(5, (l1 - l2) / l2)) END')
    .replace('cap(l2, l3)', 'CASE WHEN l3 = 0 THEN NULL ELSE greatest(-5, least(5, (l2 - l3) / l3)) END')} AS acceleration,
    cases_min_4, cases_max_4, cases_min_8, cases_max_8
    FROM (SELECT health_area, week_index, lag(cases, 1) OVER w AS l1, lag(cases, 2) OVER w AS l2, lag(cases, 3) OVER w AS l3,
    min(cases) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS cases_min_4, max(cases) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS cases_max_4,
    min(cases) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS cases_min_8, max(cases) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS cases_max_8
    FROM panel WINDOW w AS (PARTITION BY health_area ORDER BY week_index))""".replace("CAST(round(CAST(round(CASE WHEN l2 = 0", "CAST(round(CAST(round(CASE WHEN l2 = 0 OR l2 IS NULL OR l3 = 0 OR l3 IS NULL THEN NULL WHEN l2 = 0"), "panel"))
def extended_temporal_features(spark, sf):
    df = features.add_extended_temporal_features(fx.panel(spark, sf))
    return rounded(df.select("health_area", "week_index", "acceleration", "cases_min_4", "cases_max_4", "cases_min_8", "cases_max_8"))


@register(sql(f"""SELECT health_area, week_index, lag(cases, 1) OVER w AS cases_lag_1, lag(cases, 2) OVER w AS cases_lag_2, lag(cases, 4) OVER w AS cases_lag_4,
    {r('avg(cases) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)')} AS cases_ma_2, {r('avg(cases) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS cases_ma_4,
    {r('greatest(-5, least(5, coalesce((cases - lag(cases, 1) OVER w) / nullif(lag(cases, 1) OVER w, 0), 0)))')} AS growth_rate,
    {r('sin(2 * pi() * week_ / 52)')} AS sin_week, {r('cos(2 * pi() * week_ / 52)')} AS cos_week
    FROM panel WINDOW w AS (PARTITION BY health_area ORDER BY week_index)""", "panel"))
def unshifted_features(spark, sf):
    df = features.add_unshifted_features(fx.panel(spark, sf))
    return rounded(df.select("health_area", "week_index", "cases_lag_1", "cases_lag_2", "cases_lag_4", "cases_ma_2", "cases_ma_4", "growth_rate", "sin_week", "cos_week"))


@register(sql(f"""SELECT health_area, week_index, lag(cases, 1) OVER w AS lag_1, lag(cases, 2) OVER w AS lag_2, lag(cases, 3) OVER w AS lag_3,
    lag(cases, 4) OVER w AS lag_4, {r('avg(cases) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)')} AS mean_4,
    {r('stddev_samp(cases) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)')} AS std_4,
    {r('sin(2 * pi() * week_ / 52)')} AS sin_week, {r('cos(2 * pi() * week_ / 52)')} AS cos_week
    FROM panel WINDOW w AS (PARTITION BY health_area ORDER BY week_index)""", "panel"))
def measles_original_features(spark, sf):
    df = features.add_measles_original_features(fx.panel(spark, sf))
    return rounded(df.select("health_area", "week_index", "lag_1", "lag_2", "lag_3", "lag_4", "mean_4", "std_4", "sin_week", "cos_week"))


@register(sql(f"""SELECT health_area, week_index, {r('l1 / pop_totale * 10000')} AS incidence_rate, {r('l1 / pop_enfants_0_14 * 1000')} AS child_risk,
    {r('pop_totale / superficie_km2 * (l1 / pop_totale * 10000)')} AS demo_pressure,
    {r('pop_enfants_0_14 / superficie_km2')} AS "Densite_Enfants", {r('ln(pop_totale)')} AS log_exposure
    FROM (SELECT *, lag(cases, 1) OVER (PARTITION BY health_area ORDER BY week_index) AS l1 FROM panel) JOIN population USING (health_area)""",
              "panel", "population"))
def population_features(spark, sf):
    df = features.add_temporal_features(fx.panel(spark, sf), lags=(1,), windows=(4,))
    df = features.add_static_features(df, fx.static_population(spark, sf))
    df = features.add_population_features(df)
    return rounded(df.select("health_area", "week_index", "incidence_rate", "child_risk", "demo_pressure", "Densite_Enfants", "log_exposure"))


def _coef_sql(own: str, backfill: str) -> str:
    return sql(f"""SELECT health_area, week_index, {r(f'greatest(0.5, least(2.0, coalesce(known, {backfill}, 1.0)))')} AS coef_population FROM (
    SELECT health_area, week_index, last_value(raw IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known,
      first_value(raw IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM (
      SELECT health_area, week_index, {own} / pop_totale / nullif(all_before / total_pop, 0) AS raw FROM (
        SELECT health_area, week_index, pop_totale, sum(cases) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cum,
          count(*) FILTER (cases > 0) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
        FROM panel JOIN population USING (health_area) WINDOW w AS (PARTITION BY health_area ORDER BY week_index))
      JOIN (SELECT week_index, total_pop, sum(c) OVER (ORDER BY week_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS all_before
            FROM (SELECT week_index, sum(cases) AS c, sum(pop_totale) AS total_pop FROM panel JOIN population USING (health_area) GROUP BY 1))
      USING (week_index)) WINDOW w AS (PARTITION BY health_area ORDER BY week_index))""", "panel", "population")


@register(_coef_sql("cum", "NULL"))
def coef_population(spark, sf):
    df = features.join_attributes(fx.panel(spark, sf), fx.static_population(spark, sf))
    return rounded(features.with_population_coefficient(df).select("health_area", "week_index", "coef_population"))


@register(_coef_sql("cum / nullif(seen, 0)", "later"))
def coef_population_parity(spark, sf):
    df = features.join_attributes(fx.panel(spark, sf), fx.static_population(spark, sf))
    return rounded(features.with_population_coefficient(df, parity=True).select("health_area", "week_index", "coef_population"))


_KNN = """knn AS (SELECT health_area, neighbor, (1 / (d + 1e-6)) / sum(1 / (d + 1e-6)) OVER (PARTITION BY health_area) AS weight FROM (
    SELECT a.health_area, b.health_area AS neighbor, sqrt((a.longitude - b.longitude) ** 2 + (a.latitude - b.latitude) ** 2) AS d,
    row_number() OVER (PARTITION BY a.health_area ORDER BY (a.longitude - b.longitude) ** 2 + (a.latitude - b.latitude) ** 2, b.health_area) AS k
    FROM centroids a JOIN centroids b ON a.health_area <> b.health_area) WHERE k <= 5)"""


def _with_knn(body: str, *views: str) -> str:
    return sql("", "centroids", *views).rstrip() + ",\n" + _KNN + "\n" + body


def weights(spark, sf):
    return build_neighbour_weights(fx.centroids(spark, sf), 5, "longitude", "latitude")


@register(sql("", "sites").rstrip() + ",\n" + _KNN.replace("centroids", "sites") + f"\nSELECT health_area, neighbor, {r('weight')} AS weight FROM knn")
def knn_weights(spark, sf):
    return rounded(build_neighbour_weights(fx.sites(spark, sf), 5, "longitude", "latitude"))


def _spatial_sql(offset: int) -> str:
    return _with_knn(f"""SELECT k.health_area, p.week_index, {r('sum(weight * coalesce(q.cases, 0)) / sum(weight)')} AS spatial_lag_{offset}
    FROM knn k JOIN panel p ON p.health_area = k.neighbor LEFT JOIN panel q ON q.health_area = k.neighbor AND q.week_index = p.week_index - {offset}
    GROUP BY 1, 2""", "panel")


@register(_spatial_sql(1))
def spatial_lag(spark, sf):
    return rounded(features.spatial_lag(fx.panel(spark, sf), weights(spark, sf)))


@register(_spatial_sql(0))
def spatial_lag_same_week(spark, sf):
    return rounded(features.spatial_lag(fx.panel(spark, sf), weights(spark, sf), offset=0))


_CLIMATE = """SELECT health_area, week_index, temp_api, precip_api, humidity_api,
    lag(precip_api, 4) OVER w AS precip_lag_4, lag(precip_api, 6) OVER w AS precip_lag_6, lag(precip_api, 8) OVER w AS precip_lag_8,
    {0} AS precip_ma_4_8, {1} AS temp_ma_4 FROM ({2}) WINDOW w AS (PARTITION BY health_area ORDER BY week_index)"""
_CL_MA = r("avg(precip_api) OVER (w ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING)")
_CL_TM = r("avg(temp_api) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
_CL_JOIN = "SELECT p.health_area, p.week_index, temp_api, precip_api, humidity_api FROM panel p LEFT JOIN climate_weekly USING (health_area, year, week_)"
_CL_LATE = f"""SELECT health_area, week_index, lag(temp_api, 2) OVER v AS temp_api, lag(precip_api, 2) OVER v AS precip_api,
    lag(humidity_api, 2) OVER v AS humidity_api FROM ({_CL_JOIN}) WINDOW v AS (PARTITION BY health_area ORDER BY week_index)"""


def _climate_features(spark, sf, lag):
    from ..operators.climate import climate_by_week
    df = features.add_climate_features(fx.panel(spark, sf), climate_by_week(fx.climate_daily(spark, sf)), availability_lag=lag)
    return rounded(df.select("health_area", "week_index", *features.FEATURE_GROUPS["climate"]))


@register(sql(_CLIMATE.format(_CL_MA, _CL_TM, _CL_JOIN), "panel", "climate_weekly"))
def climate_features(spark, sf):
    return _climate_features(spark, sf, 0)


@register(sql(_CLIMATE.format(_CL_MA, _CL_TM, _CL_LATE), "panel", "climate_weekly"))
def climate_features_delayed(spark, sf):
    return _climate_features(spark, sf, 2)


def design(spark, sf, with_climate=True):
    """Builder with population, neighbours and climate of the driver tables."""
    from ..operators.climate import climate_by_week
    return features.DesignBuilder(
        static_df=fx.static_population(spark, sf), neighbour_weights=weights(spark, sf),
        climate_df=climate_by_week(fx.climate_daily(spark, sf)) if with_climate else None).prepared()


_PROFILE = """SELECT variable, n_rows, n_non_null, {0} AS std,
    n_non_null >= greatest(1, floor(0.05 * n_rows)) AND NOT (n_non_null > 1 AND coalesce(std, 0) = 0) AS kept FROM (
    SELECT variable, count(*) AS n_rows, count(value) AS n_non_null, stddev_pop(value) AS std FROM (
      SELECT unnest(['cases_lag_1', 'cases_lag_52', 'cases_ma_13', 'Pop_Totale', 'latitude', 'spatial_cluster']) AS variable,
             unnest([l1, l52, m13, CAST(pop_totale AS DOUBLE), 1.0, NULL]) AS value
      FROM (SELECT *, lag(cases, 1) OVER w AS l1, lag(cases, 52) OVER w AS l52, avg(cases) OVER (w ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS m13
            FROM panel JOIN population USING (health_area) WINDOW w AS (PARTITION BY health_area ORDER BY week_index)))
    GROUP BY 1)""".format(r("std"))


@register(sql(_PROFILE, "panel", "population"))
def feature_selection(spark, sf):
    df, _ = features.build_design_matrix(fx.panel(spark, sf), static_df=fx.static_population(spark, sf), feature_cols=[])
    df = df.withColumn("latitude", F.lit(1.0))
    columns = ["cases_lag_1", "cases_lag_52", "cases_ma_13", "Pop_Totale", "latitude", "spatial_cluster"]
    return rounded(features.selected_features(df, columns).select("variable", "n_rows", "n_non_null", "std", "kept"))


@register()
def design_matrix(spark, sf):
    """The whole feature matrix (its families are checked one by one)."""
    builder = design(spark, sf)
    df, columns = builder(fx.panel(spark, sf))
    return rounded(df.select("health_area", "week_index", "cases", *columns))


_DYNAMICS = """SELECT variable, CASE WHEN n < 2 THEN 0 ELSE d END AS n_distinct_intra_aire,
    {0} AS std_intra_aire, {1} AS std_global,
    CASE WHEN n < 2 THEN 'insuffisante' WHEN d > 1 THEN 'temporelle' WHEN sg = 0 THEN 'constante' ELSE 'niveau par aire' END AS role
    FROM (SELECT variable, max(d) AS d, avg(s) AS s, sum(n) AS n FROM (SELECT variable, health_area, count(DISTINCT value) AS d, stddev_pop(value) AS s,
          count(value) AS n FROM melted GROUP BY 1, 2) GROUP BY 1)
    JOIN (SELECT variable, stddev_pop(value) AS sg FROM melted GROUP BY 1) USING (variable)""".format(
    r("CASE WHEN n < 2 THEN NULL ELSE s END"), r("CASE WHEN n < 2 THEN NULL ELSE sg END"))
_MELTED = """melted AS (SELECT health_area, unnest(['cases_lag_1', 'Pop_Totale', 'Superficie_km2', 'week_of_year', 'temp_api', 'precip_api', 'humidity_api']) AS variable,
    unnest([l1, CAST(pop_totale AS DOUBLE), superficie_km2, CAST(week_ AS DOUBLE), fixed, rain, NULL]) AS value FROM (
    SELECT p.*, pop_totale, superficie_km2, lag(cases, 1) OVER (PARTITION BY health_area ORDER BY week_index) AS l1,
    length(health_area) * 1.0 AS fixed, week_ * 2.0 AS rain FROM panel p JOIN population USING (health_area)))"""


def _static_climate(panel):
    return panel.select("health_area", "year", "week_", F.length("health_area").cast("double").alias("temp_api"),
                        (F.col("week_") * 2.0).alias("precip_api"), F.lit(None).cast("double").alias("humidity_api"))


@register(sql("", "panel", "population").rstrip() + ",\n" + _MELTED + "\n" + _DYNAMICS)
def feature_dynamics(spark, sf):
    panel = fx.panel(spark, sf)
    df, _ = features.build_design_matrix(panel, static_df=fx.static_population(spark, sf), climate_df=_static_climate(panel), feature_cols=[])
    columns = ["cases_lag_1", "Pop_Totale", "Superficie_km2", "week_of_year", "temp_api", "precip_api", "humidity_api"]
    return rounded(features.describe_feature_dynamics(df, columns)).drop("groupe")


@register(sql("", "panel", "population").rstrip() + ",\n" + _MELTED + """
    SELECT variable FROM (SELECT variable, max(d) AS d FROM (SELECT variable, health_area, count(DISTINCT value) AS d, count(value) AS n
    FROM melted WHERE variable LIKE '%_api' GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) >= 2) WHERE d <= 1""")
def invariant_climate(spark, sf):
    panel = fx.panel(spark, sf)
    df = features.add_climate_features(panel, _static_climate(panel))
    names = features.invariant_climate_variables(df, ["temp_api", "precip_api", "humidity_api"])
    return spark.createDataFrame([(n,) for n in names], "variable string")


# ---------------------------------------------------------------------------
# baselines, splits, metrics
# ---------------------------------------------------------------------------
def _metric_sql(y: str, p: str) -> str:
    e = f"({p} - {y})"
    return f"""count(*) AS n, {r(f'avg(abs{e})')} AS mae, {r(f'sqrt(avg({e} * {e}))')} AS rmse,
    CASE WHEN var_pop({y}) > 1e-12 THEN {r(f'1 - avg({e} * {e}) / var_pop({y})')} END AS r2,
    {r(f'avg(CASE WHEN abs({y}) + abs({p}) > 1e-12 THEN 2 * abs{e} / (abs({y}) + abs({p})) ELSE 0 END) * 100')} AS smape,
    {r(f'avg{e}')} AS bias, CASE WHEN avg({y}) > 1e-12 THEN {r(f'avg(abs{e}) / avg({y}) * 100')} END AS mae_pct_mean,
    {r(f'avg({y})')} AS mean_observed, {r(f'sum({y})')} AS total_observed, {r(f'sum({p})')} AS total_predicted,
    CASE WHEN sum({y}) > 1e-12 THEN {r(f'sum({p}) / sum({y})')} END AS agg_ratio"""


_BASE_LONG = """SELECT unnest(['persistance', 'saisonnier_naif', 'moyenne_aire', 'moyenne_saison']) AS modele,
    unnest([lag1, lag52, mean_area, mean_season]) AS p, cases AS y FROM lagged"""


@register(sql(f"SELECT modele, CAST(1 AS INT) AS horizon, {_metric_sql('y', 'p')} FROM ({_BASE_LONG}) WHERE p IS NOT NULL GROUP BY modele HAVING count(*) >= 10",
              "lagged"))
def naive_baselines(spark, sf):
    return rounded(bl.naive_baselines(fx.panel(spark, sf)))


@register(sql(f"""SELECT {r('sqrt(avg((p - y) * (p - y))) / avg(y)')} AS cv_rmse, {r('avg(abs(p - y)) / avg(abs(y - l))')} AS mase,
    {r('sqrt(avg((p - y) * (p - y))) / avg(abs(p - y))')} AS rmse_mae_ratio
    FROM (SELECT cases AS y, lag52 AS p, lag1 AS l FROM lagged WHERE lag52 IS NOT NULL)""", "lagged"))
def extended_metrics(spark, sf):
    rows = bl.baseline_predictions(fx.panel(spark, sf)).where(F.col(bl.SEASONAL).isNotNull())
    return rounded(metrics.extended_metrics(rows, "cases", bl.SEASONAL, bl.PERSISTENCE))


@register(sql("SELECT fold, role, week_index FROM folds", "folds"))
def cv_folds(spark, sf):
    return bl.temporal_cv_splits(fx.panel(spark, sf))


@register(sql("""SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test,
    min(week_index) FILTER (role = 'train') AS train_week_min, max(week_index) FILTER (role = 'train') AS train_week_max,
    min(week_index) FILTER (role = 'test') AS test_week_min, max(week_index) FILTER (role = 'test') AS test_week_max,
    CAST(0 AS INT) AS n_overlap, false AS leakage, count(DISTINCT health_area) FILTER (role = 'train') AS train_areas,
    count(DISTINCT health_area) FILTER (role = 'test') AS test_areas FROM panel JOIN folds USING (week_index) GROUP BY 1""", "panel", "folds"))
def leakage_check(spark, sf):
    panel = fx.panel(spark, sf)
    report = bl.check_no_leakage(bl.fold_rows(panel, bl.temporal_cv_splits(panel)))
    return report.withColumn("week_overlap", F.size("week_overlap")).withColumnRenamed("week_overlap", "n_overlap")


@register(sql("""SELECT CAST(fold AS INT) AS fold, count(*) FILTER (block < fold) AS n_train, count(*) FILTER (block = fold) AS n_test,
    count(DISTINCT health_area) FILTER (block < fold) AS train_areas, count(DISTINCT health_area) FILTER (block = fold) AS test_areas,
    max(week_index) FILTER (block < fold) > min(week_index) FILTER (block = fold) AS future_in_train
    FROM (SELECT *, CASE WHEN i < n - n // 6 * 5 THEN 0 ELSE (i - (n - n // 6 * 5)) // (n // 6) + 1 END AS block FROM (
      SELECT health_area, week_index, row_number() OVER (ORDER BY health_area, week_index) - 1 AS i, count(*) OVER () AS n FROM panel))
    CROSS JOIN range(1, 6) f(fold) WHERE block <= fold GROUP BY 1""", "panel"))
def row_order_folds(spark, sf):
    report = bl.check_no_leakage(bl.row_order_folds(fx.panel(spark, sf)))
    return report.select("fold", "n_train", "n_test", "train_areas", "test_areas",
                         (F.col("train_week_max") > F.col("test_week_min")).alias("future_in_train"))


@register()
def random_holdout(spark, sf):
    rows = bl.random_holdout(fx.panel(spark, sf), ["health_area", "week_index"])
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


_ORIGIN_ROWS = """truth AS (SELECT p.health_area, o.origin, h.horizon, t.cases AS y, p.cases AS persistance, s.cases AS saisonnier_naif, m.mean AS moyenne_aire
    FROM (SELECT DISTINCT CAST(round_even(52 + k * (n_weeks - 9 - 52) / 11.0, 0) AS INT) AS origin FROM extent, range(0, 12) r(k)) o
    CROSS JOIN (SELECT unnest([1, 2, 4, 8]) AS horizon) h
    JOIN panel p ON p.week_index = o.origin JOIN panel t ON t.health_area = p.health_area AND t.week_index = o.origin + h.horizon
    LEFT JOIN panel s ON s.health_area = p.health_area AND s.week_index = o.origin + h.horizon - 52
    JOIN (SELECT a.health_area, a.week_index, avg(a.cases) OVER ({mean}) AS mean FROM panel a) m ON m.health_area = p.health_area AND m.week_index = o.origin),
  long AS (SELECT *, unnest(['persistance', 'saisonnier_naif', 'moyenne_aire']) AS modele, unnest([persistance, saisonnier_naif, moyenne_aire]) AS p FROM truth),
  per_origin AS (SELECT modele, horizon, origin, {m1} FROM long WHERE p IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10),
  pooled AS (SELECT modele, horizon, {m2} FROM long WHERE p IS NOT NULL GROUP BY 1, 2)"""


def _raw_metrics(y: str, p: str) -> str:
    e = f"({p} - {y})"
    return f"""count(*) AS n, avg(abs{e}) AS mae, sqrt(avg({e} * {e})) AS rmse, CASE WHEN var_pop({y}) > 1e-12 THEN 1 - avg({e} * {e}) / var_pop({y}) END AS r2,
    avg(CASE WHEN abs({y}) + abs({p}) > 1e-12 THEN 2 * abs{e} / (abs({y}) + abs({p})) ELSE 0 END) * 100 AS smape, avg{e} AS bias,
    CASE WHEN sum({y}) > 1e-12 THEN sum({p}) / sum({y}) END AS agg_ratio, CASE WHEN avg({y}) > 1e-12 THEN avg(abs{e}) / avg({y}) * 100 END AS mae_pct_mean"""


_MEASURES = ("mae", "rmse", "r2", "smape", "bias", "agg_ratio", "mae_pct_mean")


def _backtest_sql(mean: str) -> str:
    ctes = _ORIGIN_ROWS.format(mean=mean, m1=_raw_metrics("y", "p"), m2=_raw_metrics("y", "p"))
    body = f"""SELECT a.modele, 'baseline' AS type, CAST(a.horizon AS INT) AS horizon, {', '.join(f"{r(f'a.{m}')} AS {m}" for m in _MEASURES)}, a.n,
    {', '.join(f"{r(f'q.{m}')} AS {m}_pool" for m in _MEASURES)}, {r('b.best')} AS best_baseline_mae, {r('1 - q.mae / b.best', 4)} AS skill_mae_vs_baseline
    FROM (SELECT modele, horizon, {', '.join(f'avg({m}) AS {m}' for m in _MEASURES)}, CAST(sum(n) AS BIGINT) AS n FROM per_origin GROUP BY 1, 2) a
    JOIN pooled q USING (modele, horizon) JOIN (SELECT horizon, min(mae) AS best FROM pooled WHERE modele <> 'persistance' GROUP BY 1) b USING (horizon)"""
    return sql("", "panel", "extent").rstrip() + ",\n" + ctes + "\n" + body


@register(_backtest_sql("PARTITION BY a.health_area ORDER BY a.week_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"))
def backtest_baselines(spark, sf):
    return rounded(bl.backtest_baselines(fx.panel(spark, sf)))


@register(_backtest_sql("PARTITION BY a.health_area"))
def backtest_baselines_parity(spark, sf):
    return rounded(bl.backtest_baselines(fx.panel(spark, sf), parity=True))


@register(sql("""SELECT health_area, week_index, cases, cases > 1.5 * avg(cases) OVER (PARTITION BY health_area ORDER BY week_index
    ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS is_peak FROM panel""", "panel"))
def peak_detection(spark, sf):
    peak = metrics.detect_peaks("cases", pn.area_window())
    return fx.panel(spark, sf).select("health_area", "week_index", "cases", peak.alias("is_peak"))


_PEAKS = f"""{r('100.0 * count(*) FILTER (tp AND pp) / nullif(count(*) FILTER (tp), 0)', 1)} AS sensitivity,
    {r('100.0 * count(*) FILTER (NOT tp AND NOT pp) / nullif(count(*) FILTER (NOT tp), 0)', 1)} AS specificity,
    {r('100.0 * count(*) FILTER (NOT tp AND pp) / nullif(count(*) FILTER (NOT tp), 0)', 1)} AS false_alarm_pct,
    count(*) FILTER (tp) AS n_true_peaks, count(*) FILTER (tp AND pp) AS n_detected, count(*) FILTER (tp AND NOT pp) AS n_missed,
    count(*) FILTER (NOT tp AND pp) AS n_false_alarms"""


@register(sql(f"SELECT health_area, {_PEAKS} FROM flagged GROUP BY 1", "flagged"))
def peak_metrics(spark, sf):
    results = fx.validation_results(fx.panel(spark, sf))
    return metrics.compute_peak_detection_metrics(results, by=["health_area"], partition=("fold", "health_area"))


_SAFE_R2 = "CASE WHEN stddev_pop(observed) >= 1e-6 THEN 1 - avg((predicted - observed) * (predicted - observed)) / var_pop(observed) END"
_FOLD = f"""SELECT fold, count(*) AS n_test, concat(min(week_index), '–', max(week_index)) AS test_weeks, {r('avg(abs(predicted - observed))', 2)} AS mae,
    {r('sqrt(avg((predicted - observed) * (predicted - observed)))', 2)} AS rmse, {r(_SAFE_R2, 3)} AS r2, {r('avg(predicted - observed)', 2)} AS bias, {_PEAKS}
    FROM flagged GROUP BY 1"""


@register(sql(_FOLD, "flagged"))
def fold_metrics(spark, sf):
    return metrics.fold_metrics(fx.validation_results(fx.panel(spark, sf)))


_AREA = f"""SELECT *, {r('mae / nullif(mean_observed, 0) * 100', 1)} AS mae_pct_mean,
    CASE WHEN r2 IS NULL THEN '—' WHEN r2 >= 0.80 THEN 'Excellent' WHEN r2 >= 0.65 THEN 'Bon' WHEN r2 >= 0.45 THEN 'Moyen' ELSE 'Faible' END AS quality FROM (
    SELECT health_area, {r('avg(abs(predicted - observed))', 1)} AS mae, {r('sqrt(avg((predicted - observed) * (predicted - observed)))', 1)} AS rmse,
    {r(_SAFE_R2, 3)} AS r2, {r('avg(predicted - observed)', 1)} AS bias, count(*) AS n_weeks, {r('avg(observed)', 1)} AS mean_observed FROM results GROUP BY 1)"""


@register(sql(_AREA, "results"))
def area_metrics(spark, sf):
    return metrics.area_metrics(fx.validation_results(fx.panel(spark, sf)))


@register(sql(f"""SELECT arg_min(health_area, (mae, health_area)) AS best_area, min(mae) AS best_mae,
    arg_min(health_area, (-mae, health_area)) AS worst_area, max(mae) AS worst_mae FROM ({_AREA})""", "results"))
def best_worst_area(spark, sf):
    return metrics.best_and_worst_area(metrics.area_metrics(fx.validation_results(fx.panel(spark, sf))))


@register(sql(_AREA + " ORDER BY mae DESC, health_area LIMIT 20", "results"))
def worst_areas(spark, sf):
    table = metrics.area_metrics(fx.validation_results(fx.panel(spark, sf)))
    return table.orderBy(F.desc("mae"), "health_area").limit(20)


@register(sql("", "flagged").rstrip() + f""",
    f AS ({_FOLD}),
    o AS (SELECT {r('avg(abs(predicted - observed))')} AS mae, {r('sqrt(avg((predicted - observed) * (predicted - observed)))')} AS rmse, {r(_SAFE_R2)} AS r2,
      {r('stddev_pop(predicted - observed)')} AS residual_std, {r('avg(observed)')} AS mean_observed FROM results)
    SELECT o.*, {r('bias')} AS bias, {r('cv')} AS cv_r2_mean, {r('sens')} AS sensitivity_mean, n_peaks, n_detected FROM o, (
      SELECT sum(bias * n_test) / sum(n_test) AS bias, avg(r2) AS cv, avg(sensitivity) AS sens, CAST(sum(n_true_peaks) AS BIGINT) AS n_peaks,
      CAST(sum(n_detected) AS BIGINT) AS n_detected FROM f)""")
def global_metrics(spark, sf):
    return rounded(metrics.global_metrics(fx.validation_results(fx.panel(spark, sf))))


@register(sql(f"""SELECT week_index, observed, predicted,
    observed > 1.5 * avg(observed) OVER (ORDER BY week_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS is_peak,
    {r('predicted + s')} AS pred_upper, {r('greatest(predicted - s, 0)')} AS pred_lower
    FROM (SELECT week_index, sum(observed) AS observed, sum(predicted) AS predicted FROM results GROUP BY 1),
    (SELECT stddev_pop(predicted - observed) AS s FROM results)""", "results"))
def observed_vs_predicted(spark, sf):
    return rounded(metrics.observed_vs_predicted(fx.validation_results(fx.panel(spark, sf))))


@register(sql("""SELECT fold, CAST(least(floor((predicted - observed - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, count(*) AS n
    FROM results, (SELECT min(predicted - observed) AS lo, max(predicted - observed) AS hi FROM results) GROUP BY 1, 2""", "results"))
def residual_histogram(spark, sf):
    return metrics.residual_histogram(fx.validation_results(fx.panel(spark, sf)))


# ---------------------------------------------------------------------------
# diagnostics
# ---------------------------------------------------------------------------
@register(sql("""SELECT health_area, CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n) - count(*) AS BIGINT) AS rows_lost,
    CAST(sum(cases) AS BIGINT) AS cases FROM (SELECT health_area, week_, count(*) AS n, sum(cases) AS cases FROM cases_weekly GROUP BY 1, 2) GROUP BY 1""", "cases_weekly"))
def collapse_report(spark, sf):
    return diagnostics.collapse_report(fx.cases_weekly(spark, sf))


@register(sql(f"""SELECT leak, count(g) AS n, {r('corr(g, y)')} AS corr, {r('max(abs(g - y))')} AS max_abs_error FROM (
    SELECT unnest(['unshifted_mean', 'same_week_rate']) AS leak,
      unnest([CASE WHEN l IS NOT NULL THEN 2 * ma - l END, y / pop_totale * 10000 * pop_totale / 10000]) AS g, y FROM (
      SELECT cases AS y, pop_totale, lag(cases, 1) OVER w AS l, avg(cases) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS ma
      FROM panel JOIN population USING (health_area) WINDOW w AS (PARTITION BY health_area ORDER BY week_index))) GROUP BY 1""", "panel", "population"))
def leak_reconstruction(spark, sf):
    return rounded(diagnostics.leakage_reconstruction(fx.panel(spark, sf), fx.population(spark, sf)))


@register(sql(f"""SELECT variable, {r('t')} AS train_mean, {r('f')} AS forecast_mean,
    f IS NULL OR (abs(t) > 1e-9 AND abs(f - t) / greatest(abs(t), 1e-9) > 0.5) AS flagged FROM (
    SELECT variable, avg(v) FILTER (year < 2001) AS t, avg(v) FILTER (year = 2001) AS f FROM (
      SELECT year, unnest(['cases', 'week_of_year', 'lag_52']) AS variable, unnest([cases, CAST(week_ AS DOUBLE), lag52]) AS v FROM lagged) GROUP BY 1)""", "lagged"))
def skew_report(spark, sf):
    df = bl.baseline_predictions(fx.panel(spark, sf)).withColumns(
        {"week_of_year": F.col("week_").cast("double"), "lag_52": F.col(bl.SEASONAL)})
    report = diagnostics.skew_report(df.where("year < 2001"), df.where("year = 2001"), ["cases", "week_of_year", "lag_52"])
    return rounded(report)


@register(sql(f"""SELECT {r('om')} AS observed_mean, {r('pm')} AS predicted_mean, {r('pm / nullif(om, 0)')} AS ratio, {r('p10')} AS area_ratio_p10, {r('p50')} AS area_ratio_median,
    {r('p90')} AS area_ratio_p90, nz AS n_zero_areas, na AS n_areas FROM (SELECT avg(cases) AS om FROM panel),
    (SELECT avg(predicted_cases) AS pm FROM forecast),
    (SELECT quantile_cont(pred / nullif(obs, 0), 0.1) AS p10, quantile_cont(pred / nullif(obs, 0), 0.5) AS p50, quantile_cont(pred / nullif(obs, 0), 0.9) AS p90,
      count(*) FILTER (total = 0) AS nz, count(*) AS na FROM
      (SELECT health_area, avg(predicted_cases) AS pred, sum(predicted_cases) AS total FROM forecast GROUP BY 1)
      JOIN (SELECT health_area, avg(cases) AS obs FROM panel, extent WHERE week_index >= n_weeks - 30 GROUP BY 1) USING (health_area))""", "forecast"))
def drift_report(spark, sf):
    panel = fx.panel(spark, sf)
    return rounded(diagnostics.drift_report(panel, fx.naive_forecast(panel), n_recent=30))
