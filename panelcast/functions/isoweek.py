"""ISO-8601 week arithmetic as Spark column expressions.

Everything here is codegen-friendly: no UDF, no lookup table.  ``Col`` arguments
accept a column name or a Column.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Col = Column | str

# Fixed value: mean number of weeks in a year, 365.2425 / 7.
WEEKS_PER_YEAR = 52.1775


def _c(value: Col) -> Column:
    return F.col(value) if isinstance(value, str) else value


def weeks_in_year(year: Col) -> Column:
    """52 or 53: the ISO week that holds 28 December."""
    return F.weekofyear(F.make_date(_c(year).cast("int"), F.lit(12), F.lit(28)))


def first_monday(year: Col) -> Column:
    """Monday of ISO week 1, i.e. of the week that holds 4 January."""
    return F.trunc(F.make_date(_c(year).cast("int"), F.lit(1), F.lit(4)), "week")


def iso_week_to_date(year: Col, week: Col) -> Column:
    """Monday of the given ISO week; the week is clamped to 1..last of that year."""
    clamped = F.greatest(F.lit(1), F.least(_c(week).cast("int"), weeks_in_year(year)))
    # least/greatest skip nulls, the guard keeps null in -> null out
    monday = F.date_add(first_monday(year), (clamped - 1) * 7)
    return F.when(_c(week).isNotNull() & _c(year).isNotNull(), monday)


def iso_year(day: Col) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(day)).cast("int")


def iso_week(day: Col) -> Column:
    return F.weekofyear(_c(day)).cast("int")


def iso_week_index(year: Col, week: Col, origin_year: int | Col) -> Column:
    """Whole weeks between week 1 of ``origin_year`` and the given ISO week."""
    origin = first_monday(F.lit(origin_year) if isinstance(origin_year, int) else origin_year)
    return (F.datediff(iso_week_to_date(year, week), origin) / 7).cast("int")


def with_week_index(df: DataFrame, year: str = "year", week: str = "week_",
                    origin_year: int | None = None, name: str = "week_index") -> DataFrame:
    """Add the continuous week index; without an origin the earliest Monday is 0."""
    if origin_year is not None:
        return df.withColumn(name, iso_week_index(year, week, origin_year))
    first = df.agg(F.min(iso_week_to_date(year, week))).first()[0]
    return df.withColumn(name, (F.datediff(iso_week_to_date(year, week), F.lit(first)) / 7).cast("int"))


def index_to_monday(index: Col, origin_year: int, origin_week: int = 1) -> Column:
    origin = iso_week_to_date(F.lit(origin_year), F.lit(origin_week))
    return F.date_add(origin, F.round(_c(index)).cast("int") * 7)


def week_index_to_iso(index: Col, origin_year: int, origin_week: int = 1) -> tuple[Column, Column]:
    """Inverse of :func:`iso_week_index`: (ISO year, ISO week)."""
    monday = index_to_monday(index, origin_year, origin_week)
    return iso_year(monday), iso_week(monday)


def week_frac(week: Col) -> Column:
    """Position of the week in the year, 0 for week 1."""
    return (_c(week) - 1) / F.lit(WEEKS_PER_YEAR)


def period_label(year: Col, week: Col) -> Column:
    """``YYYY-Snn``."""
    return F.format_string("%d-S%02d", _c(year).cast("int"), _c(week).cast("int"))


def sort_key(year: Col, week: Col) -> Column:
    return (_c(year) * 100 + _c(week)).cast("int")


def jan1_week_start(year: Col, week: Col) -> Column:
    """Start of week ``w`` counted in blocks of seven days from 1 January (not ISO)."""
    return F.date_add(F.make_date(_c(year).cast("int"), F.lit(1), F.lit(1)),
                      (_c(week).cast("int") - 1) * 7)


def jan1_week(day: Col) -> Column:
    """Number of the seven-day block from 1 January that holds ``day``."""
    return (F.floor((F.dayofyear(_c(day)) - 1) / 7) + 1).cast("int")


def onset_from_week(year: Col, week: Col, max_week: int | None = None) -> Column:
    """Monday used as onset date when a line list only gives a week.

    ``max_week=52`` reproduces the historical clamp that never yields week 53.
    """
    week = _c(week).cast("int")
    if max_week is not None:
        week = F.when(week.isNotNull(), F.greatest(F.lit(1), F.least(week, F.lit(max_week))))
    return iso_week_to_date(year, week)


def future_weeks(last: DataFrame, n_weeks: int, year: str = "year", week: str = "week_",
                 wrap: int | None = None) -> DataFrame:
    """The ``n_weeks`` week labels that follow each row of ``last``.

    By default weeks follow the ISO calendar; ``wrap=52`` restarts at 1 after
    week 52 whatever the year.
    """
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n_weeks))))
    if wrap is None:
        monday = F.date_add(iso_week_to_date(year, week), F.col("step") * 7)
        new_year, new_week = iso_year(monday), iso_week(monday)
    else:
        position = F.col(week) - 1 + F.col("step")
        new_week = (F.pmod(position, F.lit(wrap)) + 1).cast("int")
        new_year = (F.col(year) + F.floor(position / wrap)).cast("int")
    return steps.select("*", new_year.alias("future_year"), new_week.alias("future_week")).select(
        *[c for c in steps.columns], "future_year", "future_week",
        period_label("future_year", "future_week").alias("label"),
        sort_key("future_year", "future_week").alias("sort_key"))


def last_observed_week(df: DataFrame, year: str = "year", week: str = "week_") -> DataFrame:
    """One row: the latest (year, week) present."""
    top = F.max(F.struct(F.col(year).alias("y"), F.col(week).alias("w")))
    return df.agg(top.alias("t")).select(F.col("t.y").alias(year), F.col("t.w").alias(week))


def calendar(first_year: int, last_year: int) -> list[tuple[int, int]]:
    """All (ISO year, ISO week) pairs of the given years (a few hundred pairs)."""
    return [(y, w) for y in range(first_year, last_year + 1)
            for w in range(1, date(y, 12, 28).isocalendar()[1] + 1)]


def calendar_length(first_year: int, last_year: int) -> int:
    return (date.fromisocalendar(last_year + 1, 1, 1) - date.fromisocalendar(first_year, 1, 1)).days // 7
