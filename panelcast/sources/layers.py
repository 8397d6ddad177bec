"""GeoJSON layers and landed climate documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalars import normal_key
from ..operators.ranking import sequential_id

# Where a layer keeps its country code and its names.
COUNTRY_FIELDS = ("iso3", "iso3_code", "iso_3", "country_iso3")
NAME_FIELDS = ("health_area", "health_are", "name_fr", "name", "nom", "aire_sante")

_FEATURE = "properties: map<string,string>, geometry: struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: ``properties`` map, geometry type and coordinates text.

    Text with one Feature or FeatureCollection per line is split among tasks.  Anything
    else is read as one document per file, many files (one per district, say) in
    parallel.  A document that is neither raises; blank text holds no feature.
    """
    lines = _features_of(spark.read.text(path))
    if lines.where("not known").isEmpty():
        found = lines
    else:
        found = _features_of(spark.read.text(path, wholetext=True))
        if not found.where("not known").isEmpty():
            raise ValueError(f"neither Feature nor FeatureCollection in {path}")
    return found.select(F.explode("found").alias("f")).select("f.properties", "f.geometry")


def _features_of(docs: DataFrame) -> DataFrame:
    """(found, known): the features of every text that is not blank, and whether it is a Feature or FeatureCollection."""
    parsed = docs.where(F.trim("value", F.lit(" \t\r\n")) != "").select(F.from_json("value", f"struct<type:string, {_FEATURE}, features:array<struct<{_FEATURE}>>>").alias("d"))
    own = F.array(F.struct("d.properties", "d.geometry"))
    found = F.when(F.col("d.features").isNotNull(), F.col("d.features")).when(F.col("d.type") == "Feature", own)
    return parsed.select(found.alias("found"), found.isNotNull().alias("known"))


def _first(properties: Column, names) -> Column:
    lowered = F.transform_keys(properties, lambda k, _: F.lower(k))
    return F.coalesce(*[F.try_element_at(lowered, F.lit(n)) for n in names])


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _polygons(geometry: Column) -> Column:
    """Multipolygon coordinates of a Polygon or MultiPolygon, else null."""
    multi = F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>")
    single = F.array(F.from_json(geometry["coordinates"], "array<array<array<double>>>"))
    raw = F.when(geometry["type"] == "MultiPolygon", multi).when(geometry["type"] == "Polygon", single)
    return F.transform(raw, lambda polygon: F.transform(polygon, _points))


def flatten_geometry(features: DataFrame) -> DataFrame:
    """Add ``polygons``: Polygon, MultiPolygon or the polygons inside a GeometryCollection, with holes."""
    nested = F.flatten(F.filter(F.transform("geometry.geometries", _polygons), lambda p: p.isNotNull()))
    own = F.when(F.col("geometry.type") == "GeometryCollection", nested).otherwise(_polygons(F.col("geometry")))
    return features.withColumn("polygons", F.when(F.size(own) > 0, own))


def rejected_features(features: DataFrame) -> DataFrame:
    """Features that hold no polygon, for the load report."""
    return flatten_geometry(features).where(F.col("polygons").isNull()).select("properties", F.col("geometry.type").alias("type"))


def read_layer(spark: SparkSession, path: str, iso3: str | None = None) -> DataFrame:
    """``health_area, polygons`` of a GeoJSON layer in WGS84, optionally of one country.

    Features without any name are called ``aire_1``, ``aire_2``, ...
    """
    rows = flatten_geometry(read_features(spark, path)).where(F.col("polygons").isNotNull())
    if iso3:
        rows = rows.where(normal_key(_first(F.col("properties"), COUNTRY_FIELDS)) == iso3.strip().lower())
    named = rows.select(normal_key(_first(F.col("properties"), NAME_FIELDS)).alias("health_area"), "polygons")
    if named.where("health_area is null").limit(1).count() == 0:
        return named
    text = named.where("health_area is null").select(F.to_json("polygons").alias("_p"))
    numbered = sequential_id(text, "_n").select(
        F.format_string("aire_%d", "_n").alias("health_area"), F.from_json("_p", geo.MULTIPOLYGON_TYPE).alias("polygons"))
    return named.where("health_area is not null").unionByName(numbered)


def read_rivers(spark: SparkSession, path: str) -> DataFrame:
    """Segments ``x1, y1, x2, y2`` of the lines of a GeoJSON layer."""
    rows = read_features(spark, path)
    single = F.array(F.from_json("geometry.coordinates", "array<array<double>>"))
    multi = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    lines = rows.select(F.explode(F.when(F.col("geometry.type") == "MultiLineString", multi)
                                  .when(F.col("geometry.type") == "LineString", single)).alias("line"))
    steps = F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))
    return lines.where(F.size("line") > 1).select(F.explode(steps).alias("s")).select(
        F.col("s.a")[0].alias("x1"), F.col("s.a")[1].alias("y1"), F.col("s.b")[0].alias("x2"), F.col("s.b")[1].alias("y2"))


# ---------------------------------------------------------------------------
# landed climate documents
# ---------------------------------------------------------------------------
def climate_from_maps(docs: DataFrame, text: str = "value") -> DataFrame:
    """Documents with one date-to-value map per variable; keys are ``yyyyMMdd``.

    Other columns of ``docs`` (coordinates, say) are kept.
    """
    maps = "map<string,double>"
    parsed = docs.withColumn("_d", F.from_json(text, f"properties struct<parameter:struct<T2M:{maps},PRECTOTCORR:{maps},RH2M:{maps}>>"))
    p = "_d.properties.parameter"
    days = parsed.withColumn("_day", F.explode(F.map_keys(f"{p}.T2M")))
    return days.select(
        *[c for c in docs.columns if c != text], F.try_to_timestamp("_day", F.lit("yyyyMMdd")).cast("date").alias("date"),
        *[F.try_element_at(F.col(f"{p}.{code}"), F.col("_day")).alias(name)
          for code, name in (("T2M", "temp"), ("PRECTOTCORR", "precip"), ("RH2M", "humidity"))])


def climate_from_arrays(docs: DataFrame, text: str = "value") -> DataFrame:
    """Documents with parallel arrays (``daily.time`` and one array per variable)."""
    schema = ("daily struct<time:array<string>,temperature_2m_mean:array<double>,precipitation_sum:array<double>,"
              "relative_humidity_2m_mean:array<double>>")
    parsed = docs.withColumn("_d", F.from_json(text, schema))
    zipped = F.arrays_zip(F.col("_d.daily.time").alias("t"), F.col("_d.daily.temperature_2m_mean").alias("a"),
                          F.col("_d.daily.precipitation_sum").alias("b"), F.col("_d.daily.relative_humidity_2m_mean").alias("c"))
    return parsed.withColumn("_z", F.explode(zipped)).select(
        *[c for c in docs.columns if c != text], F.col("_z.t").try_cast("date").alias("date"),
        F.col("_z.a").alias("temp"), F.col("_z.b").alias("precip"), F.col("_z.c").alias("humidity"))


def read_climate(spark: SparkSession, path: str, layout: str = "map") -> DataFrame:
    """Landed documents of one folder, one document per file."""
    docs = spark.read.text(path, wholetext=True)
    return climate_from_maps(docs) if layout == "map" else climate_from_arrays(docs)
