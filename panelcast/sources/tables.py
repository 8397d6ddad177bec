"""Tolerant CSV readers.

The separator and the encoding are sniffed on the first lines; the file itself is
read by Spark's CSV source with every column as text, so that typing is done by the
null-safe coercions of ``clean`` instead of a schema-inference pass.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normal_key, number
from ..operators.clean import (clean_cases, harmonise_cases, harmonise_linelist, infer_year, normalise_week_labels,
                               valid_domain, year_from_clock)
from ..operators.features import one_row_per_area

# Separators in order of precedence, accepted area headers.
CASE_SEPARATORS = ("\t", ";", ",")
LINELIST_SEPARATORS = (",", ";", "\t", "|")
AREA_ALIASES = ("health_area", "aire_sante", "aire", "name_fr", "health_are", "nom", "name")


def first_lines(spark: SparkSession, path: str, n: int = 6) -> list[str]:
    """The first non-empty lines (a limit on the text source reads one split)."""
    rows = spark.read.text(path).where(F.trim("value") != "").limit(n).collect()
    return [r[0].lstrip("﻿") for r in rows]


def sniff_case_separator(lines: Sequence[str]) -> str:
    """Separator present in the header: TAB before ``;`` before ``,``."""
    header = lines[0] if lines else ""
    return next((s for s in CASE_SEPARATORS if s in header), ",")


def sniff_linelist_separator(lines: Sequence[str]) -> str:
    """Separator with the highest mean count over the first lines of the first 4096 characters."""
    kept, used = [], 0
    for line in lines[:6]:
        kept.append(line[:max(0, 4096 - used)])
        used += len(line) + 1
    scores = {s: sum(line.count(s) for line in kept) / max(len(kept), 1) for s in LINELIST_SEPARATORS}
    best = max(LINELIST_SEPARATORS, key=scores.__getitem__)
    return best if scores[best] > 0 else ","


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line cannot be decoded, then Latin-1.

    The check is one extra pass over the text; give the readers an ``encoding`` to
    skip it on large extracts.
    """
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def read_text_table(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> DataFrame:
    df = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
          .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
    return df.withColumnsRenamed({c: re.sub("^﻿", "", c) for c in df.columns})


def read_cases(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Weekly case CSV to the typed contract (aliases resolved, weeks parsed, years inferred)."""
    df = harmonise_cases(read_text_table(spark, path, sniff_case_separator(first_lines(spark, path, 1)), encoding or encoding_of(spark, path)))
    absent = {"health_area", "week_", "cases"} - set(df.columns)
    if absent:
        raise ValueError(f"columns not found: {sorted(absent)}")
    had_year = "year" in df.columns
    df = clean_cases(normalise_week_labels(df), keep_extras=False)
    return valid_domain(infer_year(df) if had_year else year_from_clock(df))


def read_linelist(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Case-list CSV with harmonised headers; values stay text until ``complete_linelist``."""
    sep = sniff_linelist_separator(first_lines(spark, path))
    return harmonise_linelist(read_text_table(spark, path, sep, encoding or encoding_of(spark, path)))


def read_static(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Static covariates: one row per area, numeric columns where every value is a number."""
    df = read_text_table(spark, path, sniff_linelist_separator(first_lines(spark, path)), encoding or encoding_of(spark, path))
    area = next((c for a in AREA_ALIASES for c in df.columns if c.strip().lower() == a), None)
    if area is None:
        raise ValueError("no area column")
    rest = [c for c in df.columns if c != area]
    typed = df.select(normal_key(F.col(f"`{area}`")).alias("health_area"), *[number(F.col(f"`{c}`")).alias(c) for c in rest])
    return one_row_per_area(typed)


def read_vaccination(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """``health_area, Taux_Vaccination``; decimal commas accepted, one row per area."""
    df = read_text_table(spark, path, sniff_linelist_separator(first_lines(spark, path)), encoding or encoding_of(spark, path))
    if len(df.columns) == 1:
        df = read_text_table(spark, path, ";", encoding or encoding_of(spark, path))
    df = harmonise_linelist(df)
    area = "health_area" if "health_area" in df.columns else "Aire_Sante"
    if area not in df.columns or "Taux_Vaccination" not in df.columns:
        raise ValueError("the vaccination table needs an area and Taux_Vaccination")
    rate = number(F.trim(F.regexp_replace("Taux_Vaccination", ",", ".")))
    return one_row_per_area(df.select(F.col(area).alias("health_area"), rate.alias("Taux_Vaccination")))
