"""Writers: CSV, GeoJSON and the export bundle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Header CSV, one file per partition; array and struct columns as JSON text."""
    flat = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    (df.withColumns(flat) if flat else df).write.mode(mode).option("header", True).option("sep", sep).csv(path)


def _coordinates(polygons: Column) -> Column:
    return F.transform(polygons, lambda polygon: F.transform(polygon, lambda ring: F.transform(
        ring, lambda p: F.array(p["x"], p["y"]))))


def geojson_features(layer: DataFrame, geometry: str = "polygons") -> DataFrame:
    """One GeoJSON Feature per row, every other column as a property."""
    properties = F.struct(*[c for c in layer.columns if c != geometry])
    shape = F.struct(F.lit("MultiPolygon").alias("type"), _coordinates(F.col(geometry)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties"))
    return layer.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(layer: DataFrame, path: str, geometry: str = "polygons", mode: str = "errorifexists") -> None:
    """Newline-delimited Features, written in parallel (GeoJSON text sequence without a wrapper)."""
    geojson_features(layer, geometry).write.mode(mode).text(path)


def write_feature_collections(layer: DataFrame, path: str, geometry: str = "polygons", parts: int = 16,
                              mode: str = "errorifexists") -> None:
    """Complete FeatureCollection documents, ``parts`` of them (fewer if some would be empty).

    Every area goes to a document by a hash of its Feature.  A task assembles a whole
    document, so very large layers take more parts, or ``write_geojson``.
    """
    features = geojson_features(layer, geometry)
    parts = features.groupBy(F.pmod(F.xxhash64("value"), F.lit(parts)).alias("_part")).agg(F.array_sort(F.collect_list("value")).alias("f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("f", ","), F.lit("]}"))
    parts.select(text.alias("value")).write.mode(mode).text(path)


def write_bundle(tables: Mapping[str, DataFrame | None], path: str, fmt: str = "parquet", mode: str = "errorifexists") -> list[str]:
    """Every table that exists, side by side under one path; returns the written names."""
    written = []
    for name, df in tables.items():
        if df is None:
            continue
        target = f"{path.rstrip('/')}/{name}"
        if fmt == "csv":
            write_csv(df, target, mode=mode)
        else:
            df.write.mode(mode).format(fmt).save(target)
        written.append(name)
    return written
