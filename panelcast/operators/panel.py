"""The balanced area x ISO-week panel."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import isoweek as iso
from ..functions.scalars import settle
from ..session import materialise
from .clean import clean_cases, infer_year, select_scope, year_from_clock

KEYS = ["health_area", "year", "week_"]


def area_window() -> Window:
    """The one shared window spec: per-area operators exchange and sort once."""
    return Window.partitionBy("health_area").orderBy("week_index")


def weekly_totals(cases: DataFrame, extras: Sequence[str] = ()) -> DataFrame:
    """Sum cases and deaths per (area, ISO year, ISO week); other numerics are averaged."""
    return cases.groupBy(*KEYS).agg(
        F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"),
        *[F.avg(c).alias(c) for c in extras])


def build_panel(df_cases: DataFrame, years: Sequence[int] | None = None,
                areas: Iterable[str] | None = None, complete_grid: bool = True,
                fill_zero: bool = True, typed: bool = False) -> DataFrame:
    """Weekly case table to a complete panel.

    The raw table is reduced once, with map-side partial sums, to at most
    (areas x observed weeks) rows, which are kept so that the calendar bounds do not
    rescan it.  Gaps are then opened *inside* each area: every observed row
    generates the empty weeks since the row before it, so there is no cross join,
    no distinct and no join, and the rows leave partitioned by area, ready for the
    feature windows.  An area never exceeds the number of calendar weeks, whatever
    the skew of the raw input.

    ``typed=True`` skips the coercions for input that already follows the contract
    (``health_area`` normalised, integer year/week, counts without nulls).
    """
    if not typed:
        had_year = "year" in df_cases.columns
        cases = clean_cases(df_cases)
        cases = infer_year(cases) if had_year else year_from_clock(cases)
    else:
        cases = df_cases
    if years is not None:
        cases = select_scope(cases, years=years) if list(years) else cases.limit(0)
    if areas is not None:
        cases = select_scope(cases, areas=areas) if list(areas) else cases.limit(0)
    extras = [c for c in cases.columns if c not in (*KEYS, "cases", "deaths", "period", "week_index")]
    weekly = weekly_totals(cases, extras)
    if complete_grid:
        # a week number the year does not have has no place in the grid
        weekly = weekly.where(F.col("week_").between(1, iso.weeks_in_year("year")))
    weekly = materialise(weekly)
    bounds = weekly.agg(F.min("year"), F.max("year")).first()
    if bounds[0] is None:
        raise ValueError("no usable case row")
    first, last = int(bounds[0]), int(bounds[1])
    weekly = weekly.withColumn("week_index", iso.iso_week_index("year", "week_", first))
    if complete_grid:
        n_weeks = iso.calendar_length(first, last)
        previous = F.coalesce(F.lag("week_index").over(area_window()), F.lit(-1))
        is_last = F.lead("week_index").over(area_window()).isNull()
        span = weekly.select("*", (previous + 1).alias("_from"),
                             F.when(is_last, F.lit(n_weeks - 1)).otherwise(F.col("week_index")).alias("_to"))
        opened = span.withColumn("_slot", F.explode(F.sequence("_from", "_to")))
        here = F.col("_slot") == F.col("week_index")
        empty = F.lit(0.0) if fill_zero else F.lit(None).cast("double")
        year, week = iso.week_index_to_iso("_slot", first)
        panel = opened.select(
            "health_area", year.alias("year"), week.alias("week_"), F.col("_slot").alias("week_index"),
            *[F.when(here, F.col(c).cast("double")).otherwise(empty).alias(c) for c in ("cases", "deaths")],
            *[F.when(here, F.col(c)).alias(c) for c in extras])
    else:
        panel = weekly.select(*KEYS, "week_index", F.col("cases").cast("double").alias("cases"),
                              F.col("deaths").cast("double").alias("deaths"), *extras)
    return panel.withColumns({"period": iso.period_label("year", "week_"),
                              "week_frac": iso.week_frac("week_")})


def origin_of(panel: DataFrame) -> int:
    """ISO year whose week 1 is week index 0: the first year of the panel."""
    return int(panel.agg(F.min("year")).first()[0])


def panel_summary(panel: DataFrame) -> DataFrame:
    """Quality-control figures of a panel, one row."""
    n = F.count(F.lit(1))
    expected = F.countDistinct("health_area") * F.countDistinct("week_index")
    zero = F.count_if(F.col("cases") == 0)
    return panel.agg(
        F.countDistinct("health_area").alias("n_areas"), F.countDistinct("week_index").alias("n_weeks"),
        n.alias("n_rows"), expected.alias("n_rows_expected"),
        settle(F.try_divide(n * 100.0, F.greatest(expected, F.lit(1))), 2).alias("completeness_pct"),
        zero.alias("n_zero_rows"), settle(F.try_divide(zero * 100.0, n), 2).alias("zero_pct"),
        F.sum("cases").alias("total_cases"),
        F.min("week_index").alias("week_index_min"), F.max("week_index").alias("week_index_max"),
        F.array_sort(F.collect_set("year")).alias("years"))
