"""Individual case lists: completion, expansion, roll-ups and the epidemic curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import isoweek as iso
from ..functions.scalars import number
from .quantiles import exact_quantile
from .ranking import sequential_id

# Labels of the case list.
UNKNOWN, VACCINATED, UNVACCINATED = "Inconnu", "Oui", "Non"
DIED, RECOVERED = "Décédé", "Guéri"
NOTIFICATION_DELAY_DAYS = 3
# Age bands in months, open below and closed above.
AGE_BANDS = ((0, 12, "0-1 an"), (12, 60, "1-5 ans"), (60, 120, "5-10 ans"), (120, 180, "10-15 ans"))


def complete_linelist(df: DataFrame, max_week: int | None = None, calendar_year: bool = False,
                      default_area: str | None = None) -> DataFrame:
    """Case list with every expected column, typed.

    Onset falls back to the Monday of the given week, notification to onset plus
    three days; unknown attributes get their defaults.  The epi week is the ISO week
    of the onset with its ISO year (``calendar_year=True`` and ``max_week=52``
    reproduce the historical pairing with the calendar year and the loss of week 53).
    """
    have = set(df.columns)
    week = number("Semaine_Epi").cast("int") if "Semaine_Epi" in have else F.lit(None).cast("int")
    year = number("Annee").cast("int") if "Annee" in have else F.lit(None).cast("int")
    if "Date_Debut_Eruption" in have:
        onset = F.col("Date_Debut_Eruption").cast("string").try_cast("date")
    elif {"Semaine_Epi", "Annee"} <= have:
        onset = iso.onset_from_week(year, week, 52 if max_week == 52 else None)
    else:
        onset = F.current_date()
    notified = (F.col("Date_Notification").cast("string").try_cast("date") if "Date_Notification" in have
                else F.date_add(onset, NOTIFICATION_DELAY_DAYS))

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(UNKNOWN)

    epi_year = F.year(onset) if calendar_year else iso.iso_year(onset)
    area = F.col("Aire_Sante").cast("string") if "Aire_Sante" in have else F.lit(default_area)
    out = df.select(
        *([F.col("ID_Cas")] if "ID_Cas" in have else []), area.alias("Aire_Sante"),
        onset.alias("Date_Debut_Eruption"), notified.alias("Date_Notification"),
        (number("Age_Mois") if "Age_Mois" in have else F.lit(None).cast("double")).alias("Age_Mois"),
        text("Statut_Vaccinal").alias("Statut_Vaccinal"), text("Sexe").alias("Sexe"), text("Issue").alias("Issue"),
        (week if "Semaine_Epi" in have else iso.iso_week(onset)).alias("Semaine_Epi"),
        F.coalesce(year if "Annee" in have else epi_year, F.year(F.current_date())).alias("Annee"))
    out = out.where(F.col("Semaine_Epi").between(1, max_week or 53))
    out = out.withColumns({"Semaine_Annee": iso.period_label("Annee", "Semaine_Epi"),
                           "sort_key": iso.sort_key("Annee", "Semaine_Epi")})
    return out if "ID_Cas" in have else sequential_id(out, "ID_Cas")


def notification_delay(df: DataFrame) -> DataFrame:
    """Days between onset and notification."""
    return df.withColumn("Delai_Notification", F.datediff("Date_Notification", "Date_Debut_Eruption"))


def expand_counts(weekly: DataFrame, area: str = "health_area", year: str = "year", week: str = "week_",
                  cases: str = "cases", deaths: str = "deaths", chunk: int = 100_000) -> DataFrame:
    """One row per case of an aggregated table; the first ``deaths`` of each cell died.

    Day offsets come from a hash of the case, so a rerun gives the same list.  Huge
    cells are cut into chunks and redistributed before they are unrolled.
    """
    n = F.coalesce(F.greatest(number(cases), F.lit(0.0)), F.lit(0.0)).cast("bigint")
    d = F.coalesce(F.greatest(number(deaths), F.lit(0.0)), F.lit(0.0)).cast("bigint")
    cells = weekly.select(F.col(area).alias("Aire_Sante"), F.col(year).cast("int").alias("Annee"),
                          F.col(week).cast("int").alias("Semaine_Epi"), n.alias("_n"), d.alias("_d")).where(F.col("_n") > 0)
    step = F.lit(chunk).cast("bigint")
    parts = cells.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"), step)))
    parts = parts.repartition("Aire_Sante", "Annee", "Semaine_Epi", "_from")
    rows = parts.withColumn("rang", F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + step - 1))))
    monday = iso.iso_week_to_date("Annee", "Semaine_Epi")
    key = ["Aire_Sante", "Annee", "Semaine_Epi", "rang"]
    offset = F.pmod(F.xxhash64(F.lit("onset"), *key), F.lit(7)).cast("int")
    notified = F.pmod(F.xxhash64(F.lit("notified"), *key), F.lit(10)).cast("int")
    return rows.select(
        *key, F.date_add(monday, offset).alias("Date_Debut_Eruption"), F.date_add(monday, notified).alias("Date_Notification"),
        F.lit(None).cast("double").alias("Age_Mois"), F.lit(UNKNOWN).alias("Statut_Vaccinal"), F.lit(UNKNOWN).alias("Sexe"),
        F.when(F.col("rang") <= F.col("_d"), DIED).otherwise(RECOVERED).alias("Issue"))


# ---------------------------------------------------------------------------
# roll-ups (columns: health_area, year, week_, age_mois, statut_vaccinal, sexe, issue)
# ---------------------------------------------------------------------------
def share_unvaccinated() -> Column:
    return F.avg(F.when(F.col("statut_vaccinal") == UNVACCINATED, 100.0).otherwise(0.0))


def weekly_rollup(cases: DataFrame, by: Sequence[str] = ("health_area", "year", "week_")) -> DataFrame:
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.avg("age_mois").alias("mean_age"))


def area_rollup(cases: DataFrame) -> DataFrame:
    return cases.groupBy("health_area").agg(
        F.count(F.lit(1)).alias("cases"), F.avg("age_mois").alias("mean_age"),
        share_unvaccinated().alias("pct_unvaccinated"))


def epidemic_curve(cases: DataFrame) -> DataFrame:
    """Cases per (year, week) with the label and the sort key."""
    weekly = cases.groupBy("year", "week_").agg(F.count(F.lit(1)).alias("cases"))
    return weekly.withColumns({"label": iso.period_label("year", "week_"), "sort_key": iso.sort_key("year", "week_")})


def unvaccinated_share_of_known(cases: DataFrame) -> DataFrame:
    """Per area: % unvaccinated among the cases whose status is known."""
    known = cases.where(F.col("statut_vaccinal").isin(VACCINATED, UNVACCINATED))
    return known.groupBy("health_area").agg(share_unvaccinated().alias("Part_NonVaccines_Cas"))


def age_band(age: str = "age_mois") -> Column:
    value = F.col(age)
    out = None
    for low, high, label in AGE_BANDS:
        test = (value > low) & (value <= high)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def age_distribution(cases: DataFrame) -> DataFrame:
    """Cases and % unvaccinated per age band; ages outside the bands are left out."""
    return (cases.withColumn("age_band", age_band()).where(F.col("age_band").isNotNull()).groupBy("age_band")
            .agg(F.count(F.lit(1)).alias("cases"), share_unvaccinated().alias("pct_unvaccinated")))


def kpi_measles(cases: DataFrame, layer: DataFrame) -> DataFrame:
    """Cases, % unvaccinated (and its gap to 45 %), median age, lethality, affected areas."""
    median = exact_quantile(cases, "age_mois", 0.5)
    n_areas = layer.select("health_area").distinct().count()
    affected = F.countDistinct("health_area")
    lethality = F.avg(F.when(F.col("issue") == DIED, 100.0).otherwise(0.0))
    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"), share_unvaccinated().alias("pct_unvaccinated"),
        (share_unvaccinated() - 45).alias("delta_45"), F.lit(median).cast("double").alias("median_age"),
        lethality.alias("lethality_pct"), affected.alias("n_areas"),
        (F.try_divide(affected, F.lit(n_areas)) * 100).alias("pct_areas"))


# ---------------------------------------------------------------------------
# curve analysis; the curve has one row per calendar week
# ---------------------------------------------------------------------------
# Quadratic Savitzky-Golay weights, centre rows and the hat-matrix
# rows that serve the first/last points.
SAVGOL = {
    7: ((-2, 3, 6, 7, 6, 3, -2), 21, ((32, 15, 3, -4, -6, -3, 5), (15, 12, 9, 6, 3, 0, -3), (3, 9, 12, 12, 9, 3, -6)), 42),
    5: ((-3, 12, 17, 12, -3), 35, ((31, 9, -3, -5, 3), (9, 13, 12, 6, -5)), 35),
}


def savgol_trend(curve: DataFrame, value: str = "cases", order: str = "sort_key") -> DataFrame:
    """Smoothed curve (``trend``): window 7, quadratic; 5 when only 6 points exist; null below."""
    n = curve.count()
    if n <= 5:
        return curve.withColumn("trend", F.lit(None).cast("double"))
    width = min(7, n if n % 2 else n - 1)
    centre, centre_den, edges, edge_den = SAVGOL[width]
    half, spec = width // 2, Window.orderBy(order)

    def dot(weights, first: int, den: int) -> Column:
        parts = [F.lead(value, first + i).over(spec) * F.lit(float(c)) for i, c in enumerate(weights)]
        return sum(parts[1:], parts[0]) / den

    position = F.row_number().over(spec) - 1
    trend = F.when((position >= half) & (position < n - half), dot(centre, -half, centre_den))
    for i, weights in enumerate(edges):
        trend = trend.when(position == i, dot(weights, -i, edge_den))
        trend = trend.when(position == n - 1 - i, dot(tuple(reversed(weights)), i - (width - 1), edge_den))
    return curve.withColumn("trend", trend)


def curve_summary(curve: DataFrame) -> DataFrame:
    """Peak week, weekly mean and the variation of the last week, one row."""
    step = curve.withColumn("_before", F.lag("cases").over(Window.orderBy("sort_key")))
    peak = F.max(F.struct(F.col("cases").alias("cases"), (-F.col("sort_key")).alias("k"), F.col("label").alias("label")))
    last = F.max(F.struct(F.col("sort_key").alias("k"), F.col("cases").alias("cases"), F.col("_before").alias("before")))
    row = step.agg(peak.alias("p"), last.alias("l"), F.avg("cases").alias("weekly_mean"))
    change = F.col("l.cases") - F.col("l.before")
    pct = F.when(F.col("l.before") > 0, change / F.col("l.before") * 100).when(F.col("l.before").isNotNull(), 0.0)
    return row.select(F.col("p.label").alias("peak_label"), F.col("p.cases").alias("peak_cases"), "weekly_mean",
                      change.alias("last_variation"), pct.alias("last_variation_pct"))
