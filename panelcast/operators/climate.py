"""Daily climate to weekly climate, averages and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import isoweek as iso
from ..functions.scalars import settle
from .quantiles import exact_quantiles

# Fixed value: share of the mean humidity used for the dry season.
DRY_SEASON_SHARE = 0.7
WEEKLY = ("temp_api", "precip_api", "humidity_api")


def daily_for_areas(areas: DataFrame, points: DataFrame, decimals: int = 2) -> DataFrame:
    """Daily series per area from series per rounded coordinate.

    Areas that share a rounded coordinate share the series, so each point is read once.
    """
    keys = {"_lat": F.round("latitude", decimals), "_lon": F.round("longitude", decimals)}
    series = points.withColumns(keys).drop("latitude", "longitude").dropDuplicates(["_lat", "_lon", "date"])
    return (areas.select("health_area", "latitude", "longitude").withColumns(keys)
            .join(series, ["_lat", "_lon"]).drop("_lat", "_lon", "latitude", "longitude"))


def climate_by_week(daily: DataFrame, calendar: str = "iso", years: Sequence[int] | None = None,
                    weeks: Sequence[int] | None = None) -> DataFrame:
    """Weekly climate per area from ``health_area, date, temp, precip, humidity``.

    The week is computed from the date, so the range join of days to week windows
    becomes a plain grouping with partial aggregation.  ``calendar="jan1"`` counts
    seven-day blocks from 1 January instead of ISO weeks.
    """
    if calendar == "iso":
        year, week = iso.iso_year("date"), iso.iso_week("date")
    else:
        year, week = F.year("date"), iso.jan1_week("date")
    days = daily.withColumns({"year": year.cast("int"), "week_": week.cast("int")})
    if years:
        days = days.where(F.col("year").isin([int(y) for y in years]))
    if weeks:
        days = days.where(F.col("week_").isin([int(w) for w in weeks]))

    def r2(expr, name):
        return settle(expr, 2).alias(name)

    return days.groupBy("health_area", "year", "week_").agg(
        F.count(F.lit(1)).alias("nb_days"),
        r2(F.avg("temp"), "temp_api"), r2(F.min("temp"), "temp_api_min"), r2(F.max("temp"), "temp_api_max"),
        r2(F.sum("precip"), "precip_api"), r2(F.max("precip"), "precip_api_max"),
        r2(F.avg("humidity"), "humidity_api"), r2(F.min("humidity"), "humidity_api_min"),
        r2(F.max("humidity"), "humidity_api_max"))


def aggregate_climate_by_week_and_area(areas: DataFrame, cases: DataFrame, points: DataFrame,
                                       years: Sequence[int] | None = None, calendar: str = "iso") -> DataFrame:
    """Weekly climate of the layer restricted to the weeks of the case table."""
    weekly = climate_by_week(daily_for_areas(areas, points), calendar, years)
    return weekly.join(cases.select("week_").distinct(), "week_", "left_semi")


def mean_by(weekly: DataFrame, by: Sequence[str], columns: Sequence[str] = WEEKLY) -> DataFrame:
    """Averages per area or per week."""
    return weekly.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def describe(weekly: DataFrame, columns: Sequence[str] = WEEKLY) -> DataFrame:
    """count, mean, std, min, quartiles and max per variable."""
    basic = weekly.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s"),
                                  F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns])
    quartiles = exact_quantiles(weekly, columns, [0.25, 0.5, 0.75])
    rows = F.array(*[F.struct(
        F.lit(c).alias("variable"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.m").alias("mean"), F.col(f"{c}.s").alias("std"),
        F.col(f"{c}.lo").cast("double").alias("min"), *[F.lit(q).cast("double").alias(name) for name, q in
                                                        zip(("q25", "q50", "q75"), quartiles[c])],
        F.col(f"{c}.hi").cast("double").alias("max")) for c in columns])
    return basic.select(F.inline(rows))


def coverage(weekly: DataFrame, layer: DataFrame, n_requested_weeks: int) -> DataFrame:
    """Share of the areas and of the requested weeks that have climate."""
    n_areas = layer.select("health_area").distinct().count()
    areas, weeks = F.countDistinct("health_area"), F.countDistinct("year", "week_")
    return weekly.agg(areas.alias("n_areas"), weeks.alias("n_weeks"),
                      (F.try_divide(areas, F.lit(n_areas)) * 100).alias("pct_areas"),
                      (F.try_divide(weeks, F.lit(n_requested_weeks)) * 100).alias("pct_weeks"))


def area_climate(daily: DataFrame) -> DataFrame:
    """Mean temperature and humidity per area, and the dry-season humidity."""
    return daily.groupBy("health_area").agg(
        F.avg("temp").alias("Temperature_Moy"), F.avg("humidity").alias("Humidite_Moy"),
        (F.avg("humidity") * DRY_SEASON_SHARE).alias("Saison_Seche_Humidite"))


def climate_map(layer: DataFrame, weekly: DataFrame, year: int, week: int, variable: str) -> DataFrame:
    """One climate variable of one week for every area of the layer."""
    chosen = weekly.where((F.col("year") == year) & (F.col("week_") == week)).select("health_area", variable)
    return layer.select("health_area").join(chosen, "health_area", "left")
