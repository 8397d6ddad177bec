"""Cleaning, schema harmonisation and selection of raw case tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isoweek as iso
from ..functions.scalars import finite, normal_key, number
from .ranking import global_rank

# ---------------------------------------------------------------------------
# Accepted header spellings per role (order = priority).
# ---------------------------------------------------------------------------
CASE_ROLES: dict[str, list[str]] = {
    "health_area": ["health_area", "aire_de_sante", "aire_sante", "aire", "aire_de_santé",
                    "aire_sanitaire", "zone_sanitaire", "district"],
    "week_": ["week_", "week", "semaine", "semaine_epi", "epiweek", "epi_week",
              "semaine_epidemio", "semaine_epid", "semaine_epidemiologique"],
    "cases": ["cases", "nb_cas", "nombre_de_cas", "n_cas", "cas", "cas_palu", "cases_palu",
              "cas_paludisme"],
    "deaths": ["deaths", "death", "deces", "décès", "nb_deces", "nombre_de_deces",
               "nb_deces_palu", "deaths_palu"],
    "year": ["year", "annee", "année", "annee_epi", "annee_epid", "year_epi", "epi_year"],
}

# Compared after folding case, accents, blanks and hyphens.
LINELIST_ROLES: dict[str, list[str]] = {
    "Aire_Sante": ["aire_sante", "health_area", "name_fr", "name", "nom", "aire_de_sante",
                   "zone_sante", "district", "area", "localite", "locality", "nom_aire", "aire",
                   "fosa", "nom_fosa", "fosa_name"],
    "Date_Debut_Eruption": ["date_debut_eruption", "date_debut", "date_onset", "symptom_onset",
                            "date_eruption", "datedebut"],
    "Date_Notification": ["date_notification", "date_notif", "notification_date", "datenotif"],
    "ID_Cas": ["id_cas", "id", "case_id", "identifiant", "idcas", "id_case"],
    "Age_Mois": ["age_mois", "age", "age_months", "age_en_mois"],
    "Statut_Vaccinal": ["statut_vaccinal", "vaccin", "vaccination_status", "vacc_statut",
                        "statut_vaccination", "vaccinated", "non_vaccine"],
    "Sexe": ["sexe", "sex", "gender"],
    "Issue": ["issue", "outcome", "issue_cas", "resultat"],
    "Semaine_Epi": ["semaine_epi", "semaine", "week", "epi_week", "epiweek", "se", "s_epi",
                    "sem_epi", "semaine_epidemiologique", "epid_week", "week_number", "no_semaine",
                    "numero_semaine", "n_semaine", "wk", "sw"],
    "Annee": ["annee", "year", "an", "yr", "annee_epi", "epi_year", "epiyear",
              "annee_epidemiologique"],
    "Cas_Total": ["cas_total", "cas", "cases", "nb_cas", "nombre_cas", "nbcas", "nbre_cas",
                  "count", "total_cas", "confirmed"],
    "Deces": ["deces", "deaths", "nb_deces", "mort", "morts", "dead", "nb_morts"],
}

FORECAST_ROLES: dict[str, list[str]] = {
    "week_num": ["week_num", "weeknum", "week_num_", "weeknum_"],
    "predicted_cases": ["predicted_cases", "predictedcases"],
    "health_area": ["health_area", "healtharea", "Aire_Sante", "aire_sante", "area", "name"],
}

# Retrospective-validation input: folded aliases first, then keywords.
VALIDATION_ROLES: dict[str, list[str]] = {
    "health_area": ["health_area", "aire_sante", "aire_de_sante", "name_fr", "name", "nom", "aire",
                    "zone_sante", "district", "localite", "nom_aire", "fosa", "nom_fosa"],
    "week_num": ["week_num", "week_", "semaine_epi", "semaine", "week", "epi_week", "se", "s_epi",
                 "sem_epi", "no_semaine", "numero_semaine", "week_number", "wk"],
    "cases": ["cases", "casobserves", "cas_observes", "cas_total", "cas", "nb_cas", "nombre_cas",
              "nbcas", "nbre_cas", "count", "total_cas", "confirmed", "cas_confirmes"],
}
VALIDATION_KEYWORDS: dict[str, list[str]] = {
    "week_num": ["week", "semai", "se_", "_se", "epi"],
    "cases": ["cas", "case", "count", "confirm"],
}


def fold_header(name: str) -> str:
    """Header without case, accents, blanks and hyphens."""
    text = unicodedata.normalize("NFD", str(name).strip().lower())
    text = "".join(ch for ch in text if unicodedata.category(ch) != "Mn")
    return re.sub(r"[\s\-]", "_", text)


def simple_header(name: str) -> str:
    return re.sub(r"\s+", "_", str(name).strip().lower())


def role_renames(columns: Sequence[str], roles: Mapping[str, Sequence[str]], *,
                 contains: bool = False, fold: bool = False) -> dict[str, str]:
    """Map existing columns to role names; metadata only, no job.

    Exact aliases win over ``contains`` matches; a column serves one role.
    """
    fix = fold_header if fold else str
    seen = {fix(c): c for c in reversed(list(columns))}
    taken: set[str] = {c for c in columns if c in roles}
    renames: dict[str, str] = {}
    for role, aliases in roles.items():
        if role in columns:
            continue
        hit = next((seen[fix(a)] for a in aliases if seen.get(fix(a), role) not in taken
                    and fix(a) in seen), None)
        if hit is None and contains:
            hit = next((c for c in columns if c not in taken
                        and any(a in fix(c) for a in aliases)), None)
        if hit is not None:
            renames[hit] = role
            taken.add(hit)
    return renames


def harmonise_cases(df: DataFrame) -> DataFrame:
    """Strip/lower/underscore headers, then rename to the weekly-case roles."""
    df = df.withColumnsRenamed({c: simple_header(c) for c in df.columns})
    return df.withColumnsRenamed(role_renames(df.columns, CASE_ROLES, contains=True))


def harmonise_linelist(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(role_renames(df.columns, LINELIST_ROLES, fold=True))


def harmonise_forecast(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed({c: c.strip() for c in df.columns})
    return df.withColumnsRenamed(role_renames(df.columns, FORECAST_ROLES))


def harmonise_validation(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed(role_renames(df.columns, VALIDATION_ROLES, fold=True))
    df = df.withColumnsRenamed(role_renames(df.columns, VALIDATION_KEYWORDS, contains=True, fold=True))
    missing = [r for r in VALIDATION_ROLES if r not in df.columns]
    if missing:
        raise ValueError(f"no column found for {missing} among {df.columns}")
    return df


# ---------------------------------------------------------------------------
# values
# ---------------------------------------------------------------------------
def parse_week_label(label: iso.Col, parity: bool = False) -> Column:
    """Week number held by a label such as ``2019-W01``, ``S07`` or ``12``.

    The digits after the last ``W``/``S`` (or after the last ``-``) count.
    ``parity=True`` keeps *all* digits of an ``S`` label, as the original did.
    Labels without digits give null, see :func:`normalise_week_labels`.
    """
    text = F.upper(F.col(label).cast("string") if isinstance(label, str) else label.cast("string"))
    tail = F.regexp_replace(F.element_at(F.split(text, "-"), -1), r"\D", "")
    if parity:
        every = F.regexp_replace(text, r"\D", "")
        tail = F.when(text.contains("W"), tail).when(text.contains("S"), every).otherwise(tail)
    return tail.try_cast("int")


def normalise_week_labels(df: DataFrame, label: str = "week_", parity: bool = False) -> DataFrame:
    """Replace week labels by numbers.

    A label without digits becomes its rank among the sorted distinct labels.  The
    rank is computed on the distinct labels only (at most a few per calendar week).
    """
    week = parse_week_label("_label", parity)
    labels = df.select(F.col(label).alias("_label")).where(F.col(label).isNotNull()).distinct()
    if labels.where(week.isNull()).limit(1).count() == 0:
        return df.withColumn(label, parse_week_label(label, parity))
    ranked = global_rank(labels, ["_label"], "_rank").select(
        "_label", F.coalesce(week, F.col("_rank").cast("int")).alias("_week"))
    return (df.join(ranked, F.col(label) == F.col("_label"), "left")
            .drop(label, "_label").withColumnRenamed("_week", label))


def clean_cases(df: DataFrame, keep_extras: bool = True) -> DataFrame:
    """Typed weekly case table: normal key, integer week, counts never null.

    Rows without a readable week are dropped; a missing ``deaths`` column is 0.
    Numeric extra columns are kept as doubles.
    """
    columns = df.columns
    core = ["health_area", "week_", "year", "cases", "deaths", "period", "week_index"]
    out = [normal_key("health_area").alias("health_area"),
           number("week_").cast("int").alias("week_"),
           F.coalesce(number("cases"), F.lit(0.0)).alias("cases"),
           (F.coalesce(number("deaths"), F.lit(0.0)) if "deaths" in columns else F.lit(0.0)).alias("deaths"),
           (number("year").cast("int") if "year" in columns else F.lit(None).cast("int")).alias("year")]
    if "period" in columns:
        out.append(F.col("period").cast("string").alias("period"))
    if keep_extras:
        numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
        out += [F.col(c).cast("double").alias(c) for c, t in df.dtypes
                if c not in core and (t in numeric or t.startswith("decimal"))]
    return df.select(*out).where(F.col("week_").isNotNull())


def infer_year(df: DataFrame, default: int = 2024) -> DataFrame:
    """Fill a missing year from ``period``, then from the most frequent year.

    The per-year counts are a handful of rows; ties go to the smallest year.
    """
    year = F.col("year")
    if "period" in df.columns:
        year = F.coalesce(year, F.substring("period", 1, 4).try_cast("int"))
    df = df.withColumn("year", year)
    if df.where(F.col("year").isNull()).limit(1).count() == 0:
        return df
    top = (df.where(F.col("year").isNotNull()).groupBy("year").count()
           .orderBy(F.desc("count"), "year").limit(1).first())
    return df.fillna({"year": int(top["year"]) if top else default})


def year_from_clock(df: DataFrame) -> DataFrame:
    """A table that never had a year column gets the current year."""
    return df.withColumn("year", F.year(F.current_date()))


def valid_domain(df: DataFrame, max_week: int | None = None) -> DataFrame:
    """``cases >= 0`` and ``week > 0``; ``max_week=52`` is the measles rule."""
    keep = (F.col("week_") > 0)
    if "cases" in df.columns:
        keep &= F.col("cases") >= 0
    if max_week is not None:
        keep &= F.col("week_") <= max_week
    return df.where(keep)


def select_scope(df: DataFrame, years: Iterable[int] | None = None, weeks: Iterable[int] | None = None,
                 areas: Iterable[str] | None = None) -> DataFrame:
    """Keep the given years, weeks and areas; an empty or missing list keeps all."""
    for column, wanted in (("year", years), ("week_", weeks)):
        wanted = list(wanted or [])
        if wanted:
            df = df.where(F.col(column).isin([int(v) for v in wanted]))
    wanted = sorted({str(a).strip().lower() for a in (areas or [])})
    return df.where(F.col("health_area").isin(wanted)) if wanted else df


def scrub(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and NaN values of the given columns become null."""
    return df.withColumns({c: finite(c) for c in columns})


def first_date_column(df: DataFrame, min_share: float = 0.5) -> str | None:
    """First column whose values read as a date in more than half of the rows (one job)."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").cast("string").try_cast("date").isNotNull().cast("double")).alias(c)
                      for c in df.columns]).first()
    return next((c for c in df.columns if (shares[c] or 0.0) > min_share), None)


def first_area_column(df: DataFrame, layer: DataFrame, layer_key: str = "health_area") -> str | None:
    """First string column that shares a value with the layer's names."""
    names = layer.select(F.col(layer_key).alias("_name")).distinct()
    for column in [c for c, t in df.dtypes if t == "string"]:
        values = df.select(F.col(f"`{column}`").alias("_name")).distinct()
        if values.join(names, "_name", "left_semi").limit(1).count():
            return column
    return None


def availability(df: DataFrame, *, any_value: Sequence[str] = (), positive: Sequence[str] = (),
                 known: Sequence[str] = (), unknown: str = "Inconnu") -> DataFrame:
    """One row of booleans: column has a value / a positive value / a known label."""
    flags = [F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(f"has_{c}") for c in any_value]
    flags += [F.coalesce(F.bool_or(F.col(c) > 0), F.lit(False)).alias(f"has_{c}") for c in positive]
    flags += [F.coalesce(F.bool_or(F.col(c) != unknown), F.lit(False)).alias(f"has_{c}") for c in known]
    return df.agg(*flags)


def quality_score(cases: DataFrame, has_climate: bool, has_static: bool) -> DataFrame:
    """0..100 readiness score of the loaded data."""
    bonus = (40 if has_climate else 0) + (20 if has_static else 0)
    weeks = F.countDistinct("week_")
    return cases.agg(weeks.alias("n_weeks"),
                     F.least(F.lit(100.0), weeks * 1.5 + bonus).alias("quality"))


def series_statistics(cases: DataFrame) -> DataFrame:
    """Extent and totals of a weekly case table, one row."""
    return cases.agg(
        F.min("period").alias("first_period"), F.max("period").alias("last_period"),
        F.countDistinct("period").alias("n_periods"), F.countDistinct("year").alias("n_years"),
        F.countDistinct("health_area").alias("n_areas"),
        F.sum("cases").alias("total_cases"), F.sum("deaths").alias("total_deaths"))
