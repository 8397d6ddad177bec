"""Key indicators, population tables, correlations and top lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.labels import coefficient_label
from ..functions.scalars import clip, finite, number, ratio, settle
from ..session import materialise
from .features import one_row_per_area
from .moments import segment_moments


def kpi_malaria(cases: DataFrame) -> DataFrame:
    """Totals, extent and case fatality (0 when there is no case)."""
    total, dead = F.sum("cases"), F.sum("deaths")
    return cases.agg(total.alias("total_cases"), dead.alias("total_deaths"),
                     F.countDistinct("health_area").alias("n_areas"), F.countDistinct("week_").alias("n_weeks"),
                     F.when(total > 0, dead / total * 100).otherwise(0.0).alias("cfr_pct"))


def kpi_population(cases: DataFrame, population: DataFrame) -> DataFrame:
    """Incidence, child attack rate, incidence per area and population totals, one row.

    ``incidence_per_area`` divides the incidence by the number of areas, as always
    reported; ``mean_area_incidence`` is the true mean over areas.
    """
    totals = cases.groupBy("health_area").agg(F.sum("cases").alias("cases"))
    joined = population.join(totals, "health_area", "full_outer")
    all_cases, pop, kids = F.sum("cases"), F.sum("pop_totale"), F.sum("pop_enfants_0_14")
    areas = F.count("cases")
    density = ratio("pop_totale", "superficie_km2") if "superficie_km2" in population.columns else F.lit(None)
    return joined.agg(
        F.coalesce(ratio(all_cases, pop, 10000), F.lit(0.0)).alias("incidence_10000"),
        F.coalesce(ratio(all_cases, kids, 1000), F.lit(0.0)).alias("child_attack_1000"),
        F.coalesce(F.try_divide(ratio(all_cases, pop, 10000), areas), F.lit(0.0)).alias("incidence_per_area"),
        F.avg(ratio("cases", "pop_totale", 10000)).alias("mean_area_incidence"),
        pop.alias("population"), kids.alias("children"), F.avg(density).alias("mean_density"))


def attack_rate(layer: DataFrame, population: str, cases: str = "cases", per: float = 10000,
                name: str = "attack_rate") -> DataFrame:
    return layer.withColumn(name, ratio(cases, population, per))


def layer_with_cases(layer: DataFrame, cases: DataFrame) -> DataFrame:
    """Every area of the layer with its totals; areas without cases get 0."""
    totals = cases.groupBy("health_area").agg(F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"))
    return layer.join(totals, "health_area", "left").fillna(0, ["cases", "deaths"])


def per_period(cases: DataFrame, by: Sequence[str] = ("year", "week_")) -> DataFrame:
    return cases.groupBy(*by).agg(F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"))


def density_table(population: DataFrame, total: str = "pop_totale", surface: str = "superficie_km2") -> DataFrame:
    """Population per km2; a surface of 0 gives null."""
    return population.withColumn("densite_pop", ratio(total, surface))


def select_vintage(population: DataFrame, year: int | None = None) -> tuple[DataFrame, str | None]:
    """One year of a multi-year population table.

    The requested year, else the latest; when the requested year has no row every
    vintage is returned together with a warning text.
    """
    if "year" not in population.columns:
        return population, None
    wanted = year if year is not None else population.agg(F.max("year")).first()[0]
    chosen = population.where(F.col("year") == F.lit(wanted))
    if chosen.limit(1).count():
        return chosen, None
    return population, f"no population for {wanted}: all vintages are kept"


def enrich_layer(layer: DataFrame, population: DataFrame | None = None, urban: DataFrame | None = None,
                 climate: DataFrame | None = None, vaccination: DataFrame | None = None) -> DataFrame:
    """Layer with population, urban class, climate and coverage (chained left joins)."""
    tables = [t for t in (population, urban, climate, vaccination) if t is not None]
    return reduce(lambda left, t: left.join(one_row_per_area(t), "health_area", "left"), tables, layer)


def vaccination_features(static: DataFrame, coverage: str = "Taux_Vaccination", children: str | None = "Pop_Enfants",
                         urban: str | None = "Urbanisation") -> DataFrame:
    """Immunity gap, below-threshold flag, susceptibles and the urban code; unknown coverage stays null."""
    have = static.columns
    empty = F.lit(None).cast("double")
    cov = number(coverage) if coverage in have else empty
    kids = number(children) if children and children in have else empty
    return static.withColumns({
        coverage: cov, "Gap_Immunite_Collective": scalars.immunity_gap(cov), "Zone_Sous_Seuil": scalars.below_threshold(cov),
        "Susceptibles_Estimes": scalars.susceptibles(cov, kids),
        "UrbanEncoded": scalars.urban_code(urban) if urban and urban in have else empty})


def merge_static_tables(*tables: DataFrame | None, area_col: str = "health_area") -> DataFrame:
    """The first table fixes the rows; later ones fill its nulls and add columns."""
    frames = [one_row_per_area(t, area_col) for t in tables if t is not None and area_col in t.columns]
    out = frames[0]
    for extra in frames[1:]:
        shared = [c for c in extra.columns if c != area_col and c in out.columns]
        joined = out.join(extra.withColumnsRenamed({c: f"_{c}" for c in shared}), area_col, "left")
        out = joined.withColumns({c: F.coalesce(c, f"_{c}") for c in shared}).drop(*[f"_{c}" for c in shared]) if shared else joined
    return out


# Unit and source of the known static covariates.
STATIC_SCHEMA: dict[str, tuple[str, str]] = {
    "Altitude_Moy": ("m", "USGS/SRTMGL1_003"), "Altitude_Max": ("m", "USGS/SRTMGL1_003"),
    "Altitude_Min": ("m", "USGS/SRTMGL1_003"), "Altitude_EcartType": ("m", "USGS/SRTMGL1_003"),
    "Pente_Moy": ("°", "USGS/SRTMGL1_003 + ee.Terrain"), "NDVI_Moy": ("-", "MODIS/061/MOD13A2"),
    "NDVI_Saisonnalite": ("-", "MODIS/061/MOD13A2"), "LST_Jour_Moy": ("°C", "MODIS/061/MOD11A2"),
    "Eau_Pct": ("%", "JRC/GSW1_4/GlobalSurfaceWater"), "Eau_Saison_Pct": ("%", "JRC/GSW1_4/GlobalSurfaceWater"),
    "Dist_Eau_km": ("km", "JRC/GSW1_4 (distance transform)"), "Arbre_Pct": ("%", "ESA/WorldCover/v200"),
    "Culture_Pct": ("%", "ESA/WorldCover/v200"), "Urbain_Pct": ("%", "ESA/WorldCover/v200"),
    "Superficie_km2": ("km²", "géométrie (ESRI:54009)"),
}


def describe_coverage(static: DataFrame, area_col: str = "health_area") -> DataFrame:
    """Per variable: filled rows, share, extent, unit and source."""
    columns = [c for c in static.columns if c != area_col]
    stats = static.agg(F.count(F.lit(1)).alias("_n"), *[
        F.struct(F.count(number(c)).alias("n"), F.min(number(c)).alias("lo"), F.max(number(c)).alias("hi")).alias(f"_{i}")
        for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(
        F.lit(c).alias("variable"), F.col(f"_{i}.n").alias("n_renseigne"),
        settle(F.col(f"_{i}.n") * 100.0 / F.greatest(F.col("_n"), F.lit(1)), 1).alias("pct"),
        settle(F.col(f"_{i}.lo"), 3).alias("min"), settle(F.col(f"_{i}.hi"), 3).alias("max"),
        F.lit(STATIC_SCHEMA.get(c, ("", ""))[0]).alias("unite"), F.lit(STATIC_SCHEMA.get(c, ("", ""))[1]).alias("source"))
        for i, c in enumerate(columns)])
    return stats.select(F.inline(rows))


# ---------------------------------------------------------------------------
# ages
# ---------------------------------------------------------------------------
# Detailed bands, simplified sex split, child bands (start and length in months).
PYRAMID_BANDS = ("0_4", "5_9", "10_14", "15_19", "20_24", "25_29", "30_34")
CHILD_SPLIT, ADULT_SPLIT = (0.51, 0.49), (0.48, 0.52)
CHILD_BANDS = ((0, 12), (12, 48), (60, 48), (120, 60))


def age_pyramid(bands: DataFrame) -> DataFrame:
    """``band, male, female`` from ``band, sex (M/F), population`` rows, with the share of all."""
    wide = bands.groupBy("band").pivot("sex", ["M", "F"]).agg(F.sum("population"))
    return wide.select("band", F.coalesce("M", F.lit(0)).alias("male"), F.coalesce("F", F.lit(0)).alias("female"))


def under_35_share(bands: DataFrame) -> DataFrame:
    young = F.sum(F.when(F.col("band").isin(*PYRAMID_BANDS), F.col("population")).otherwise(0))
    return bands.agg(young.alias("under_35"), F.sum("population").alias("total"),
                     ratio(young, F.sum("population"), 100).alias("pct_under_35"))


def simplified_pyramid(population: DataFrame, total: str = "pop_totale", children: str = "pop_enfants_0_14") -> DataFrame:
    """Two bands with fixed sex shares, for populations without detailed bands."""
    sums = population.agg(F.sum(total).cast("double").alias("t"), F.sum(children).cast("double").alias("c"))
    adults = F.greatest(F.col("t") - F.col("c"), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(label).alias("band"), (value * m).alias("male"), (value * f).alias("female"))
                     for label, value, (m, f) in (("0-14 ans", F.col("c"), CHILD_SPLIT), ("15+ ans", adults, ADULT_SPLIT))])
    return sums.select(F.inline(rows))


def child_pyramid(bands: DataFrame) -> DataFrame:
    """0-4, 5-9 and 10-14 years by sex from month-start bands (0, 12, 60, 120)."""
    label = F.when(F.col("band_start") < 60, "0-4 ans").when(F.col("band_start") < 120, "5-9 ans").otherwise("10-14 ans")
    return age_pyramid(bands.withColumn("band", label))


def grouped_median_age(bands: DataFrame) -> DataFrame:
    """Median age in months, interpolated in the band where half of the population is passed.

    ``bands``: ``band_start, band_months, population`` (four rows after grouping).
    """
    totals = bands.groupBy("band_start", "band_months").agg(F.sum("population").alias("t"))
    order = Window.orderBy("band_start")
    upto = F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0))
    half = F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / 2
    marked = totals.withColumns({"_upto": upto, "_half": half}).where((F.col("_half") > 0) & (F.col("_upto") >= F.col("_half")))
    inside = F.coalesce(F.try_divide(F.col("_half") - (F.col("_upto") - F.col("t")), F.col("t")), F.lit(0.5))
    age = F.col("band_start") + inside * F.col("band_months")
    return marked.agg(F.min_by(age, "band_start").alias("median_age_months"))


# ---------------------------------------------------------------------------
# correlation
# ---------------------------------------------------------------------------
def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations (``variable_1, variable_2, r``, both directions).

    All pairs come from the moments of one scan, whatever the number of columns; values
    are shifted by the column means first.  Rows where either side is missing (null or
    not finite) are skipped; a pair with a side that does not vary has no correlation.
    """
    columns = list(dict.fromkeys(columns))
    table = materialise(df.select(*[finite(c).cast("double").alias(c) for c in columns]))
    means = table.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    parts = segment_moments(table, columns, {}, shift=means, squares=True)
    rows = []
    if parts:
        m = parts[0].pairs()
        with np.errstate(divide="ignore", invalid="ignore"):
            xx, yy = m["xx"] - m["x"] ** 2 / m["n"], m["yy"] - m["y"] ** 2 / m["n"]
            r = (m["xy"] - m["x"] * m["y"] / m["n"]) / np.sqrt(xx * yy)
        varies = (m["n"] > 1) & (xx > 1e-13 * m["xx"]) & (yy > 1e-13 * m["yy"])
        rows = [(a, b, 1.0 if a == b else float(np.clip(r[i, j], -1.0, 1.0)) if varies[i, j] else None) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    else:
        rows = [(a, b, 1.0 if a == b else None) for a in columns for b in columns]
    return df.sparkSession.createDataFrame(rows, "variable_1 string, variable_2 string, r double")


def correlation_screening(matrix: DataFrame, target: str = "cases", weak: float = 0.2, strong: float = 0.3,
                          n_strong: int = 6) -> DataFrame:
    """Correlations with the target: sign class, strong flag (at most ``n_strong``), key variable."""
    rows = matrix.where((F.col("variable_1") == target) & (F.col("variable_2") != target) & F.col("r").isNotNull())
    order = Window.orderBy(F.desc("r"), "variable_2")  # one row per variable
    by_size = Window.orderBy(F.desc(F.when(F.col("variable_2") != "deaths", F.abs("r")).otherwise(-1.0)), "variable_2")
    ranked = rows.withColumns({
        "is_strong": F.abs("r") > strong,
        "_s": F.sum((F.abs("r") > strong).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_k": F.row_number().over(by_size)})
    sign = F.when(F.col("r") > weak, "positive").when(F.col("r") < -weak, "negative").otherwise("weak")
    return ranked.select(F.col("variable_2").alias("variable"), "r", sign.alias("sign"),
                         (F.col("is_strong") & (F.col("_s") <= n_strong)).alias("plotted"),
                         ((F.col("_k") == 1) & (F.col("variable_2") != "deaths")).alias("key_variable"))


def ols_trend(df: DataFrame, columns: Sequence[str], target: str = "cases", min_rows: int = 4) -> DataFrame:
    """Least-squares line of the target on each variable over complete pairs."""
    y = F.col(target).cast("double")
    parts = df.agg(*[F.struct(
        F.count_if(F.col(c).isNotNull() & y.isNotNull()).alias("n"), F.regr_slope(y, F.col(c).cast("double")).alias("slope"),
        F.regr_intercept(y, F.col(c).cast("double")).alias("intercept"), F.regr_r2(y, F.col(c).cast("double")).alias("r2")
    ).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"_{i}")[k].alias(k) for k in ("n", "slope", "intercept", "r2")])
                     for i, c in enumerate(columns)])
    return parts.select(F.inline(rows)).where(F.col("n") >= min_rows)


def adjustment_coefficient(cases: DataFrame, population: DataFrame, pop: str = "pop_totale") -> DataFrame:
    """Static coefficient per area: mean incidence over the overall one, within [0.5, 2], and its label."""
    means = cases.groupBy("health_area").agg(F.avg("cases").alias("m"))
    joined = means.join(population.select("health_area", F.col(pop).cast("double").alias("p")), "health_area", "left")
    total = joined.agg(F.sum("m").alias("sm"), F.sum("p").alias("sp")).first()
    overall = total["sm"] / total["sp"] * 10000 if total["sp"] else 0.0
    own = F.coalesce(ratio("m", "p", 10000), F.lit(0.0))
    coef = clip(own / F.lit(overall), 0.5, 2.0) if overall and overall > 0 else F.lit(1.0)
    return joined.select("health_area", coef.alias("coef_population")).withColumn("label", coefficient_label("coef_population"))


# ---------------------------------------------------------------------------
# tops
# ---------------------------------------------------------------------------
def top_areas(table: DataFrame, value: str = "cases", n: int = 10) -> DataFrame:
    """The ``n`` largest areas (ties: alphabetical)."""
    return table.orderBy(F.desc_nulls_last(value), "health_area").limit(n)


def area_totals(cases: DataFrame, rate: str | None = None) -> DataFrame:
    """Cases and mean attack rate per area with at least one case."""
    extra = [F.avg(rate).alias(rate)] if rate else []
    return cases.groupBy("health_area").agg(F.sum("cases").alias("cases"), *extra).where(F.col("cases") > 0)


def map_counts(layer: DataFrame, threshold: float, cases: str = "cases", density: str = "densite_pop") -> DataFrame:
    """Areas at or above the threshold, areas without cases (with %), mean density."""
    alert, empty, n = F.count_if(F.col(cases) >= threshold), F.count_if(F.col(cases) == 0), F.count(F.lit(1))
    return layer.agg(alert.alias("n_alert"), ratio(alert, n, 100).alias("pct_alert"),
                     empty.alias("n_without_cases"), ratio(empty, n, 100).alias("pct_without_cases"),
                     F.avg(density).alias("mean_density"))


def heat_matrix(cases: DataFrame, n_areas: int = 15, label: str = "period", value: str = "cases") -> DataFrame:
    """Top areas x periods, chronological columns, gaps as 0.

    The period list (calendar-bounded) is read once so that the pivot needs no
    extra pass; only rows of the top areas are pivoted.
    """
    top = top_areas(area_sum(cases, value), "total", n_areas).select("health_area")
    periods = [r[0] for r in cases.select(label).distinct().orderBy(label).collect()]
    return (cases.join(top, "health_area", "left_semi").groupBy("health_area").pivot(label, periods)
            .agg(F.sum(value)).fillna(0))


def area_sum(cases: DataFrame, value: str = "cases") -> DataFrame:
    return cases.groupBy("health_area").agg(F.sum(value).alias("total"))


def heat_cells(cases: DataFrame, n_areas: int = 15, label: str = "period", value: str = "cases") -> DataFrame:
    """Long form of :func:`heat_matrix` (area, period, value)."""
    top = top_areas(area_sum(cases, value), "total", n_areas).select("health_area")
    return (cases.join(top, "health_area", "left_semi").groupBy("health_area", label).agg(F.sum(value).alias(value)))


def area_profile(layer: DataFrame, cases: DataFrame, *attributes: DataFrame, population: str = "pop_totale",
                 children: str = "pop_enfants_0_14") -> DataFrame:
    """One row per area: cases, deaths, rates per 10 000 and every joined attribute."""
    table = layer_with_cases(layer, cases)
    for extra in attributes:
        table = table.join(one_row_per_area(extra), "health_area", "left")
    rates = {}
    if population in table.columns:
        rates["rate_10000"] = ratio("cases", population, 10000)
    if children in table.columns:
        rates["child_rate_10000"] = ratio("cases", children, 10000)
    return table.withColumns(rates) if rates else table
