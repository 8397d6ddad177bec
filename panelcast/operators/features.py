"""Leakage-free feature families and the design matrix.

Every case-derived feature of week t uses weeks < t only.  All per-area windows
share one partitioning and order, so the whole matrix needs a single exchange by
area.  Frames of cases count calendar weeks, so panels may have gaps and null counts;
those of weather, neighbours and baselines count rows of a complete panel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import isoweek as iso
from ..functions.scalars import clip, finite, normal_key, ratio
from ..session import materialise
from .panel import area_window
from .quantiles import exact_quantile

# ---------------------------------------------------------------------------
# Default offsets, widths and the canonical feature order.
# ---------------------------------------------------------------------------
DEFAULT_LAGS = (1, 2, 3, 4, 8, 13, 26, 52)
DEFAULT_WINDOWS = (4, 8, 13)
PRECIP_LAGS = (4, 6, 8)
CLIMATE_COLUMNS = ("temp_api", "precip_api", "humidity_api")
FEATURE_GROUPS: dict[str, list[str]] = {
    "temporal": [*(f"cases_lag_{k}" for k in DEFAULT_LAGS),
                 *(f"cases_ma_{w}" for w in DEFAULT_WINDOWS),
                 "cases_std_4", "cases_max_4", "cases_ewm_4", "growth_rate", "cases_diff_1"],
    "seasonal": ["sin_week_1", "cos_week_1", "sin_week_2", "cos_week_2", "week_of_year", "month"],
    "static": ["Altitude_Moy", "Altitude_Max", "Pente_Moy", "NDVI_Moy", "Eau_Pct", "Urbain_Pct",
               "Dist_Eau_km", "Superficie_km2", "latitude", "longitude"],
    "population": ["Pop_Totale", "Pop_Enfants_0_14", "Densite_Pop", "Densite_Enfants",
                   "incidence_rate", "child_risk", "demo_pressure", "coef_population"],
    "spatial": ["spatial_lag_1", "spatial_cluster"],
    "climate": [*CLIMATE_COLUMNS, *(f"precip_lag_{k}" for k in PRECIP_LAGS), "precip_ma_4_8", "temp_ma_4"],
}
DEFAULT_GROUP_ORDER = tuple(FEATURE_GROUPS)
MEASLES_STATIC = ["Urbanisation", "UrbanEncoded", "Temperature_Moy", "Humidite_Moy", "Taux_Vaccination",
                  "Gap_Immunite_Collective", "Zone_Sous_Seuil", "Susceptibles_Estimes",
                  "Part_NonVaccines_Cas"]
#: history that determines the span-4 exponential mean to double precision (0.6**80 < 2e-18)
EWM_HISTORY = 80
EWM_DECAY = 0.6
#: weeks of a block of running sums: 0.6**-64 < 2e14
EWM_BLOCK = 64


def past_rows(width: int):
    """The ``width`` rows before the current one."""
    return area_window().rowsBetween(-width, -1)


def past_weeks(width: int):
    """The ``width`` calendar weeks before the current one, whichever of them have a row."""
    return area_window().rangeBetween(-width, -1)


def weeks_ago(value: Column, k: int) -> Column:
    """The value of the area exactly ``k`` weeks earlier (one row per area and week), null without that week."""
    return F.max(value).over(area_window().rangeBetween(-k, -k))


def ewm_of(history: Column) -> Column:
    """Adjusted exponential mean (span 4) of an array ordered oldest first."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    return F.aggregate(
        history, start,
        lambda acc, x: F.struct((acc["n"] * EWM_DECAY + x).alias("n"), (acc["d"] * EWM_DECAY + 1.0).alias("d")),
        lambda acc: F.try_divide(acc["n"], acc["d"]))


def ewm_up_to(value: Column) -> Column:
    """The same mean of all weeks up to a row's own, as running sums; a week without a value fades what is before it.

    Sums of values and of weights fade alike, so inside a block of weeks both are running
    sums of terms scaled by the week's place, and a block hands its totals to the next
    one: a row costs a few numbers, not an array.  What lies two blocks back has a weight
    below 1e-14.
    """
    week = F.col("week_index").cast("bigint")
    block = F.floor(week / EWM_BLOCK)
    place = week - block * EWM_BLOCK
    own = Window.partitionBy("health_area", block).orderBy("week_index").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("health_area").orderBy(block).rangeBetween(-1, -1)
    grown, faded = F.pow(F.lit(1 / EWM_DECAY), place), F.pow(F.lit(EWM_DECAY), place)

    def total(term: Column) -> Column:
        before = F.coalesce(F.sum(term).over(earlier), F.lit(0.0)) * EWM_DECAY ** EWM_BLOCK
        return faded * (F.coalesce(F.sum(term).over(own), F.lit(0.0)) + before)
    return F.try_divide(total(value.cast("double") * grown), total(F.when(value.isNotNull(), grown)))


# ---------------------------------------------------------------------------
# temporal
# ---------------------------------------------------------------------------
def growth(last: Column, before: Column) -> Column:
    return clip(F.try_divide(last - before, before), -5.0, 5.0)


def add_temporal_features(panel: DataFrame, lags: Sequence[int] = DEFAULT_LAGS,
                          windows: Sequence[int] = DEFAULT_WINDOWS) -> DataFrame:
    """Lags, shifted moving statistics, exponential mean, growth and difference."""
    y = F.col("cases")
    last, before = weeks_ago(y, 1), weeks_ago(y, 2)
    new = {f"cases_lag_{k}": weeks_ago(y, k) for k in lags}
    new |= {f"cases_ma_{w}": F.avg(y).over(past_weeks(w)) for w in windows}
    new["cases_std_4"] = F.stddev_samp(y).over(past_weeks(4))
    new["cases_max_4"] = F.max(y).over(past_weeks(4))
    new["growth_rate"] = growth(last, before)
    new["cases_diff_1"] = last - before
    # the mean up to a week with a value, which stays the mean until the next one
    df = panel.withColumns(new | {"_ewm": F.when(y.isNotNull(), ewm_up_to(y))})
    earlier = area_window().rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("cases_ewm_4", F.last("_ewm", ignorenulls=True).over(earlier)).drop("_ewm")


def add_extended_temporal_features(panel: DataFrame) -> DataFrame:
    """Acceleration and rolling extremes described in the user manual."""
    y = F.col("cases")
    steps = [weeks_ago(y, k) for k in (1, 2, 3)]
    new = {"acceleration": growth(steps[0], steps[1]) - growth(steps[1], steps[2])}
    for w in (4, 8):
        new[f"cases_min_{w}"] = F.min(y).over(past_weeks(w))
        new[f"cases_max_{w}"] = F.max(y).over(past_weeks(w))
    return panel.withColumns(new)


def add_unshifted_features(panel: DataFrame, lags: Sequence[int] = (1, 2, 4)) -> DataFrame:
    """Feature set of the retrospective-validation page.

    Its moving means include the target week: it leaks by design and serves only to
    measure that leak.
    """
    y = F.col("cases")
    change = clip(F.coalesce(F.try_divide(y - weeks_ago(y, 1), weeks_ago(y, 1)), F.lit(0.0)), -5.0, 5.0)
    angle = F.lit(2 * math.pi) * F.col("week_") / 52
    new = {f"cases_lag_{k}": weeks_ago(y, k) for k in lags}
    new |= {f"cases_ma_{w}": F.avg(y).over(area_window().rangeBetween(1 - w, 0)) for w in (2, 4)}
    return panel.withColumns(new | {"growth_rate": change, "sin_week": F.sin(angle), "cos_week": F.cos(angle)})


def add_measles_original_features(panel: DataFrame) -> DataFrame:
    """Lags 1-4, shifted mean and deviation over 4 weeks, one harmonic on 52 weeks."""
    y = F.col("cases")
    angle = F.lit(2 * math.pi) * F.col("week_") / 52
    new = {f"lag_{k}": weeks_ago(y, k) for k in (1, 2, 3, 4)}
    return panel.withColumns(new | {
        "mean_4": F.avg(y).over(past_weeks(4)), "std_4": F.stddev_samp(y).over(past_weeks(4)),
        "sin_week": F.sin(angle), "cos_week": F.cos(angle)})


def add_seasonality(panel: DataFrame, n_harmonics: int = 2) -> DataFrame:
    """Fourier terms of the position in the year, week number and month."""
    new = {}
    for k in range(1, n_harmonics + 1):
        angle = F.lit(2 * math.pi * k) * (F.col("week_") - 1) / iso.WEEKS_PER_YEAR
        new[f"sin_week_{k}"], new[f"cos_week_{k}"] = F.sin(angle), F.cos(angle)
    month = F.floor(F.col("week_") / iso.WEEKS_PER_YEAR * 12) + 1
    new["week_of_year"] = F.col("week_").cast("double")
    new["month"] = F.least(F.greatest(month, F.lit(1)), F.lit(12)).cast("double")
    return panel.withColumns(new)


# ---------------------------------------------------------------------------
# static, population
# ---------------------------------------------------------------------------
def one_row_per_area(table: DataFrame, key: str = "health_area") -> DataFrame:
    """Normalise the key and keep one row per area (smallest row, so runs agree)."""
    keyed = table.withColumn(key, normal_key(key))
    rest = [c for c in table.columns if c != key]
    if not rest:
        return keyed.distinct()
    return (keyed.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
            .select(key, *[F.col("_row")[c].alias(c) for c in rest]))


def join_attributes(panel: DataFrame, table: DataFrame) -> DataFrame:
    """Left join of per-area attributes; columns of the same name are replaced."""
    table = one_row_per_area(table)
    clash = [c for c in table.columns if c != "health_area" and c in panel.columns]
    return panel.drop(*clash).join(table, "health_area", "left")


def add_static_features(panel: DataFrame, static_df: DataFrame | None = None,
                        geometry: DataFrame | None = None,
                        extra_columns: Sequence[str] | None = None) -> DataFrame:
    """Geometry attributes, static covariates and child density per area.

    ``geometry`` carries ``health_area, latitude, longitude, Superficie_km2``.
    """
    df = panel
    if geometry is not None:
        df = join_attributes(df, geometry.select("health_area", "latitude", "longitude", "Superficie_km2"))
    if static_df is not None:
        df = join_attributes(df, static_df)
    if {"Pop_Enfants_0_14", "Superficie_km2"} <= set(df.columns):
        df = df.withColumn("Densite_Enfants", ratio("Pop_Enfants_0_14", "Superficie_km2"))
    for column in extra_columns or ():
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast("double"))
    return df


def _historic(df: DataFrame) -> Column:
    if "cases_is_forecast" in df.columns:
        return ~F.coalesce(F.col("cases_is_forecast"), F.lit(False))
    return F.lit(True)


def with_population_coefficient(df: DataFrame, parity: bool = False) -> DataFrame:
    """Add ``coef_population``: incidence of the area so far over that of all areas so far.

    Missing leading values are 1, the result is bounded to [0.5, 2].
    ``parity=True`` divides the area's cumulated cases by its *positive* weeks while
    the global side stays a running total, and fills leading gaps backwards.

    The area side is a window of the shared spec; the running total over all areas
    is taken on one row per week and joined back by week.
    """
    historic = _historic(df)
    cases = F.when(historic, F.col("cases"))
    pop = F.col("Pop_Totale").cast("double")
    pop = F.when(pop != 0, pop)
    running = Window.orderBy("week_index").rowsBetween(Window.unboundedPreceding, -1)
    totals = (df.where(historic).groupBy("week_index").agg(F.sum("cases").alias("_all"), F.sum(pop).alias("_pop"))
              .select("week_index", F.try_divide(F.sum("_all").over(running), F.col("_pop")).alias("_global")))
    before = area_window().rowsBetween(Window.unboundedPreceding, -1)
    own = F.sum(cases).over(before)
    if parity:
        own = F.try_divide(own, F.count_if(cases > 0).over(before))
    df = (df.drop("coef_population").join(totals, "week_index", "left")
          .withColumn("_raw", F.when(historic, F.try_divide(F.try_divide(own, pop), F.col("_global")))))
    known = F.last("_raw", ignorenulls=True).over(area_window().rowsBetween(Window.unboundedPreceding, 0))
    if parity:
        later = F.first("_raw", ignorenulls=True).over(area_window().rowsBetween(0, Window.unboundedFollowing))
        known = F.coalesce(known, later)
    filled = clip(F.coalesce(known, F.lit(1.0)), 0.5, 2.0)
    df = df.withColumn("coef_population", F.when(historic, filled)).drop("_raw", "_global")
    if "cases_is_forecast" in df.columns:
        # beyond the history: median over the areas of the last known coefficient
        past = df.where(historic)
        last = past.agg(F.max("week_index")).first()[0]
        edge = 1.0 if last is None else exact_quantile(past.where(F.col("week_index") == last), "coef_population", 0.5)
        df = df.withColumn("coef_population", F.coalesce("coef_population", F.lit(edge)))
    return df


def add_population_rates(df: DataFrame, base: Column) -> DataFrame:
    """Incidence per 10 000, child risk per 1 000 and demographic pressure from ``base`` cases."""
    if "Pop_Totale" in df.columns:
        df = df.withColumn("incidence_rate", ratio(base, "Pop_Totale", 10000))
    if "Pop_Enfants_0_14" in df.columns:
        df = df.withColumn("child_risk", ratio(base, "Pop_Enfants_0_14", 1000))
    if {"Densite_Pop", "incidence_rate"} <= set(df.columns):
        df = df.withColumn("demo_pressure", finite(F.col("Densite_Pop") * F.col("incidence_rate")))
    return df


def add_population_features(panel: DataFrame, parity: bool = False) -> DataFrame:
    """Rates on last week's cases, the cumulative coefficient and the log exposure."""
    if "cases_lag_1" in panel.columns:
        base = F.col("cases_lag_1")
    elif "cases_ma_4" in panel.columns:
        base = F.col("cases_ma_4")
    else:
        panel = panel.withColumn("_base", weeks_ago(F.col("cases"), 1))
        base = F.col("_base")
    df = add_population_rates(panel, base).drop("_base")
    if "Pop_Totale" not in df.columns:
        return df.withColumns({"coef_population": F.lit(1.0), "log_exposure": F.lit(0.0)})
    df = with_population_coefficient(df, parity)
    exposure = F.log(F.greatest(F.col("Pop_Totale").cast("double"), F.lit(1.0)))
    return df.withColumn("log_exposure", F.when(F.col("Pop_Totale").isNotNull(), exposure))


# ---------------------------------------------------------------------------
# spatial, climate
# ---------------------------------------------------------------------------
def spatial_lag(panel: DataFrame, weights: DataFrame, offset: int = 1) -> DataFrame:
    """(health_area, week_index, spatial_lag_<offset>): neighbours' cases ``offset`` weeks earlier.

    The lag is taken inside each area first, so the panel meets the edges on the key
    it is already partitioned by; the weighted mean counts the neighbours present in
    the panel.  Weeks before the first one count as 0.  ``offset=0`` is the
    historical same-week variant, which leaks.
    """
    value = F.lag("cases", offset).over(area_window()) if offset else F.col("cases")
    earlier = panel.select(F.col("health_area").alias("neighbor"), "week_index", F.coalesce(value, F.lit(0.0)).alias("_v"))
    edges = weights.select("health_area", "neighbor", "weight")
    mean = F.try_divide(F.sum(F.col("weight") * F.col("_v")), F.sum("weight"))
    return edges.join(earlier, "neighbor").groupBy("health_area", "week_index").agg(mean.alias(f"spatial_lag_{offset}"))


def add_spatial_features(panel: DataFrame, weights: DataFrame | None = None,
                         clusters: DataFrame | None = None) -> DataFrame:
    """Spatial lag of the previous week and the optional cluster id per area."""
    df = panel.drop("spatial_lag_1", "spatial_cluster")
    if weights is not None:
        df = df.join(spatial_lag(panel, weights), ["health_area", "week_index"], "left")
    else:
        df = df.withColumn("spatial_lag_1", F.lit(None).cast("double"))
    if clusters is not None:
        labels = clusters.select("health_area", F.col("spatial_cluster").cast("double").alias("spatial_cluster"))
        return df.join(one_row_per_area(labels), "health_area", "left")
    return df.withColumn("spatial_cluster", F.lit(None).cast("double"))


def cluster_indicators(df: DataFrame, k: int, column: str = "spatial_cluster") -> DataFrame:
    """0/1 columns ``cluster_0 .. cluster_{k-1}``."""
    return df.withColumns({f"cluster_{i}": F.coalesce((F.col(column) == i).cast("double"), F.lit(0.0))
                           for i in range(k)})


def add_climate_features(panel: DataFrame, climate_df: DataFrame | None = None,
                         precip_lags: Sequence[int] = PRECIP_LAGS, availability_lag: int = 0) -> DataFrame:
    """Weekly climate, delayed by its publication lag, then lagged and averaged."""
    names = [*CLIMATE_COLUMNS, *(f"precip_lag_{k}" for k in precip_lags), "precip_ma_4_8", "temp_ma_4"]
    empty = F.lit(None).cast("double")
    if climate_df is None:
        return panel.withColumns({c: empty for c in names})
    keys = [c for c in ("health_area", "year", "week_") if c in climate_df.columns]
    used = [c for c in CLIMATE_COLUMNS if c in climate_df.columns]
    if not used:
        return panel
    climate = (climate_df.withColumn("health_area", normal_key("health_area"))
               .groupBy(*keys).agg(*[F.avg(c).alias(c) for c in used]))
    df = panel.drop(*used).join(climate, keys, "left")
    if availability_lag > 0:
        df = df.withColumns({c: F.lag(c, availability_lag).over(area_window()) for c in used})
    rain, heat = "precip_api" in used, "temp_api" in used
    new = {f"precip_lag_{k}": F.lag("precip_api", k).over(area_window()) if rain else empty for k in precip_lags}
    if rain:
        new["precip_ma_4_8"] = F.avg("precip_api").over(area_window().rowsBetween(-7, -4))
        new["temp_ma_4"] = F.avg("temp_api").over(past_rows(4)) if heat else empty
    return df.withColumns(new)


# ---------------------------------------------------------------------------
# assembly
# ---------------------------------------------------------------------------
def group_of(variable: str) -> str:
    return next((g for g, members in FEATURE_GROUPS.items() if variable in members), "")


def ordered_candidates(columns: Sequence[str], groups: Sequence[str] = DEFAULT_GROUP_ORDER,
                       extra_static: Sequence[str] | None = None) -> list[str]:
    wanted: list[str] = []
    for group in groups:
        wanted += FEATURE_GROUPS.get(group, [])
        if group == "static":
            wanted += list(extra_static or [])
    return [c for c in dict.fromkeys(wanted) if c in columns]


def feature_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_rows, n_non_null, std) for the given columns in one aggregation."""
    stats = df.agg(F.count(F.lit(1)).alias("n"),
                   *[F.struct(F.count(F.col(c)).alias("n"), F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(f"_{i}")
                     for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("variable"), F.col(f"_{i}")["n"].alias("n_non_null"),
                               F.col(f"_{i}")["s"].alias("std")) for i, c in enumerate(columns)])
    return stats.select(F.col("n").alias("n_rows"), F.inline(pairs)).select(
        "position", "variable", "n_rows", "n_non_null", "std")


def selected_features(df: DataFrame, columns: Sequence[str], min_non_null: float = 0.05) -> DataFrame:
    """Profile plus the ``kept`` decision of each candidate."""
    enough = F.col("n_non_null") >= F.greatest(F.lit(1), F.floor(F.lit(min_non_null) * F.col("n_rows")))
    flat = (F.col("n_non_null") > 1) & (F.coalesce("std", F.lit(0.0)) == 0.0)
    return feature_profile(df, columns).withColumn("kept", enough & ~flat)


def select_features(df: DataFrame, groups: Sequence[str] = DEFAULT_GROUP_ORDER, min_non_null: float = 0.05,
                    extra_static: Sequence[str] | None = None) -> list[str]:
    """Ordered usable features: canonical order, not nearly empty, not constant."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return usable_columns(df, ordered_candidates(numeric, groups, extra_static), min_non_null)


def usable_columns(df: DataFrame, columns: Sequence[str], min_non_null: float = 0.05) -> list[str]:
    """The given columns without the nearly empty and constant ones, order kept."""
    if not columns:
        return []
    rows = selected_features(df, columns, min_non_null).where("kept").orderBy("position").collect()
    return [r["variable"] for r in rows]


def usable_columns_by_origin(df: DataFrame, columns: Sequence[str], origins: Sequence[int],
                             min_non_null: float = 0.05) -> dict[int, list[str]]:
    """:func:`usable_columns` of the rows up to each origin, in one pass.

    The matrix is reduced to one row per week (count and extremes of each column),
    from which every origin is answered.
    """
    weekly = df.groupBy("week_index").agg(F.count(F.lit(1)).alias("_n"), *[
        F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"_{i}")
        for i, c in enumerate(columns)])
    melted = weekly.select("week_index", "_n", F.posexplode(F.array(*[F.col(f"_{i}") for i in range(len(columns))])).alias("position", "s"))
    tagged = melted.withColumn("origin", F.explode(F.array(*[F.lit(int(o)) for o in origins]))).where(F.col("week_index") <= F.col("origin"))
    stats = tagged.groupBy("origin", "position").agg(F.sum("_n").alias("rows"), F.sum("s.n").alias("n"),
                                                     F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"))
    enough = F.col("n") >= F.greatest(F.lit(1), F.floor(F.lit(min_non_null) * F.col("rows")))
    kept = stats.where(enough & ~((F.col("n") > 1) & (F.col("lo") == F.col("hi")))).select("origin", "position").collect()
    found: dict[int, list[int]] = {int(o): [] for o in origins}
    for row in kept:
        found[row["origin"]].append(row["position"])
    return {o: [columns[i] for i in sorted(places)] for o, places in found.items()}


def non_numeric_features(df: DataFrame, feature_cols: Sequence[str]) -> list[tuple[str, str]]:
    """Chosen columns that are absent or not numeric (schema check, no job)."""
    types = dict(df.dtypes)
    return [(c, types.get(c, "missing")) for c in feature_cols
            if types.get(c, "missing") not in ("int", "bigint", "float", "double")]


def build_design_matrix(panel: DataFrame, static_df: DataFrame | None = None, climate_df: DataFrame | None = None,
                        geometry: DataFrame | None = None, neighbour_weights: DataFrame | None = None,
                        clusters: DataFrame | None = None, groups: Sequence[str] = DEFAULT_GROUP_ORDER,
                        lags: Sequence[int] = DEFAULT_LAGS, windows: Sequence[int] = DEFAULT_WINDOWS,
                        extra_static: Sequence[str] | None = None, feature_cols: Sequence[str] | None = None,
                        climate_availability_lag: int = 0, parity: bool = False) -> tuple[DataFrame, list[str]]:
    """All feature families and the ordered feature list."""
    spatial = "spatial" in groups
    df = (panel.transform(add_temporal_features, lags=lags, windows=windows)
          .transform(add_seasonality)
          .transform(add_static_features, static_df=static_df, geometry=geometry)
          .transform(add_population_features, parity=parity)
          .transform(add_spatial_features, weights=neighbour_weights if spatial else None,
                     clusters=clusters if spatial else None)
          .transform(add_climate_features, climate_df=climate_df, availability_lag=climate_availability_lag))
    if feature_cols is None:
        return df, select_features(df, groups, extra_static=extra_static)
    missing = {c: F.lit(None).cast("double") for c in feature_cols if c not in df.columns}
    return (df.withColumns(missing) if missing else df), list(feature_cols)


@dataclass
class DesignBuilder:
    """A reusable ``panel -> (design matrix, features)`` callable with fixed inputs."""

    static_df: DataFrame | None = None
    climate_df: DataFrame | None = None
    geometry: DataFrame | None = None
    neighbour_weights: DataFrame | None = None
    clusters: DataFrame | None = None
    groups: Sequence[str] = DEFAULT_GROUP_ORDER
    lags: Sequence[int] = DEFAULT_LAGS
    windows: Sequence[int] = DEFAULT_WINDOWS
    extra_static: Sequence[str] | None = None
    feature_cols: Sequence[str] | None = None
    climate_availability_lag: int = 0
    parity: bool = False

    def __call__(self, panel: DataFrame) -> tuple[DataFrame, list[str]]:
        return build_design_matrix(panel, **self.__dict__)

    def makes(self, column: str) -> bool:
        """Whether a feature of a fuller builder is one of this builder too."""
        group = group_of(column)
        if column.startswith(("cases_lag_", "cases_ma_")):
            return int(column.rsplit("_", 1)[1]) in (self.lags if "_lag_" in column else self.windows)
        source = {"temporal": True, "seasonal": True, "climate": self.climate_df is not None,
                  "spatial": (self.neighbour_weights if column.startswith("spatial_lag") else self.clusters) is not None}
        return source.get(group, self.static_df is not None or self.geometry is not None) and (not group or group in self.groups)

    def prepared(self) -> DesignBuilder:
        """The same builder with its side tables written once (neighbours, weekly climate, ...)."""
        tables = {k: materialise(v) for k, v in self.__dict__.items() if isinstance(v, DataFrame)}
        return replace(self, **tables)


def written_matrix(panel: DataFrame, builder, feature_cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Design matrix written once, and its features.

    With a :class:`DesignBuilder` the selection reads the written table, so the
    windows are evaluated a single time.
    """
    if isinstance(builder, DesignBuilder) and builder.feature_cols is None and feature_cols is None:
        df, _ = replace(builder, feature_cols=[])(panel)
        wanted = ordered_candidates(df.columns, builder.groups, builder.extra_static)
        df = materialise(df.select("health_area", "week_index", "cases", *wanted,
                                   *[c for c in ("cases_lag_1", "log_exposure") if c in df.columns and c not in wanted]))
        return df, select_features(df, builder.groups, extra_static=builder.extra_static)
    df, columns = builder(panel)
    if feature_cols is not None:
        columns = [c for c in feature_cols if c in df.columns] or columns
    extra = [c for c in ("cases_lag_1", "log_exposure") if c in df.columns and c not in columns]
    return materialise(df.select("health_area", "week_index", "cases", *columns, *extra)), list(columns)


# ---------------------------------------------------------------------------
# diagnostics of the matrix
# ---------------------------------------------------------------------------
def describe_feature_dynamics(df: DataFrame, feature_cols: Sequence[str] | None = None,
                              area_col: str = "health_area") -> DataFrame:
    """Role of each variable: varies in time, level per area, constant or too empty.

    The matrix is melted to (variable, area, value) partials: the first aggregation
    reduces it to one row per variable and area, the second to one row per variable.
    Distinct values inside an area are bounded by its weeks.
    """
    numeric = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")}
    columns = [c for c in (feature_cols or ordered_candidates(df.columns)) if c in numeric]
    per_area = df.groupBy(area_col).agg(*[
        F.struct(F.size(F.collect_set(c)).alias("d"), F.stddev_pop(c).alias("s"), F.count(c).alias("n"),
                 F.sum(F.col(c).cast("double")).alias("t"), F.min(c).cast("double").alias("lo"),
                 F.max(c).cast("double").alias("hi")).alias(f"_{i}") for i, c in enumerate(columns)])
    melted = per_area.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.lit(group_of(c)).alias("groupe"), *[F.col(f"_{i}")[k].alias(k) for k in
                 ("d", "s", "n", "t", "lo", "hi")]) for i, c in enumerate(columns)])))
    # population variance of the whole column from the per-area moments
    mean = F.col("t") / F.when(F.col("n") > 0, F.col("n"))
    second = F.col("n") * (F.col("s") * F.col("s") + mean * mean)
    grouped = melted.groupBy("variable", "groupe").agg(
        F.sum("n").alias("n"), F.max("d").alias("d"), F.avg("s").alias("s"),
        F.sum(second).alias("q"), F.sum("t").alias("t"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    overall = F.col("t") / F.col("n")
    spread = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(
        F.sqrt(F.greatest(F.col("q") / F.col("n") - overall * overall, F.lit(0.0))))
    enough = F.col("n") >= 2
    role = (F.when(~enough, "insuffisante").when(F.col("d") > 1, "temporelle")
            .when(F.col("lo") == F.col("hi"), "constante").otherwise("niveau par aire"))
    return grouped.select(
        "variable", "groupe", F.when(enough, F.col("d")).otherwise(0).alias("n_distinct_intra_aire"),
        F.when(enough, F.col("s")).alias("std_intra_aire"), F.when(enough, spread).alias("std_global"),
        role.alias("role"))


def invariant_climate_variables(df: DataFrame, feature_cols: Sequence[str] | None = None,
                                area_col: str = "health_area") -> list[str]:
    """Climate variables that never move inside an area."""
    columns = [c for c in (feature_cols or df.columns) if group_of(c) == "climate"]
    if not columns:
        return []
    roles = describe_feature_dynamics(df, columns, area_col)
    return [r["variable"] for r in roles.where(F.col("role").isin("niveau par aire", "constante"))
            .orderBy("variable").collect()]
