"""Null-safe scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .isoweek import Col, _c


def clip(value: Col, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null (``least``/``greatest`` alone skip nulls)."""
    value = _c(value)
    out = value
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(value.isNotNull(), out)


def finite(value: Col) -> Column:
    """NaN and infinities become null."""
    value = _c(value).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def ratio(num: Col, den: Col, scale: float = 1.0) -> Column:
    """``num / den * scale``, null when the denominator is 0 or null."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double")) * F.lit(float(scale))


def settle(value: Col, digits: int) -> Column:
    """Round to ``digits`` after removing last-bit noise, so equal sums round equally."""
    return F.round(F.round(_c(value).cast("double"), 10), digits)


def number(value: Col) -> Column:
    """Coercing numeric parse: anything unreadable is null."""
    return _c(value).try_cast("double")


def normal_key(value: Col) -> Column:
    """Join key of an area name."""
    return F.lower(F.trim(_c(value).cast("string")))


# Accented Latin letters and their base letters.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_BASE = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_accents(value: Col) -> Column:
    """Lower-case and strip Latin accents without leaving the JVM."""
    return F.translate(F.lower(_c(value)), _ACCENTED, _BASE)


def match_key(value: Col) -> Column:
    """Strong normal form used before fuzzy matching (punctuation becomes one space)."""
    return F.trim(F.regexp_replace(fold_accents(F.trim(_c(value))), r"[\s\-_/']+", " "))


def pearson(x: Col, y: Col) -> Column:
    """Aggregate: correlation over complete pairs, null when a side does not vary.

    The built-in ``corr`` raises on a constant column under ANSI mode.
    """
    x, y = _c(x).cast("double"), _c(y).cast("double")
    full = x.isNotNull() & y.isNotNull()
    scale = F.stddev_pop(F.when(full, x)) * F.stddev_pop(F.when(full, y))
    return F.try_divide(F.covar_pop(x, y), scale)


# --- environment and vaccination ------------------------------------------------

def flood_risk(flood: Col, river_distance: Col) -> Column:
    return ratio(flood, _c(river_distance) + F.lit(0.1))


def climate_suitability(temperature: Col, humidity: Col) -> Column:
    """Gaussian around 27.5 degrees, weighted by relative humidity."""
    t = _c(temperature)
    return F.exp(-((t - 27.5) * (t - 27.5)) / 50.0) * _c(humidity) / 100.0


def heat_rain(temperature: Col, precipitation: Col) -> Column:
    return _c(temperature) * _c(precipitation)


def immunity_gap(coverage: Col, target: float = 95.0) -> Column:
    return clip(F.lit(target) - _c(coverage), 0.0)


def below_threshold(coverage: Col, target: float = 95.0) -> Column:
    """1.0 / 0.0, null when coverage is unknown."""
    return (_c(coverage) < F.lit(target)).cast("double")


def susceptibles(coverage: Col, population: Col) -> Column:
    return (F.lit(1.0) - _c(coverage) / 100.0) * _c(population)


def urban_code(label: Col) -> Column:
    """rural 0, semi-urban 1, urban 2, anything else null."""
    key = normal_key(label)
    return (F.when(key == "rural", 0.0)
            .when(key.isin("semi-urbain", "semi urbain"), 1.0)
            .when(key == "urbain", 2.0))


def urban_class(land_class: Col) -> Column:
    """Settlement grid code to label."""
    code = _c(land_class)
    return F.when(code >= 30, "Urbain").when(code == 23, "Semi-urbain").when(code.isNotNull(), "Rural")


def skill_score(model: Col, baseline: Col) -> Column:
    """1 - model / baseline, null when the baseline error is (nearly) zero."""
    return F.when(_c(baseline) > 1e-12, 1.0 - _c(model) / _c(baseline))
