"""Quadtree cover of areas and the zonal join on it, against the plain ray cast of every pair."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import geo
from panelcast.operators import spatial


def star(rng, x, y, size, corners):
    angles = np.sort(rng.random(corners)) * 2 * math.pi
    points = [{"x": float(x + size * r * math.cos(a)), "y": float(y + size * r * math.sin(a))} for a, r in zip(angles, rng.uniform(0.3, 1, corners), strict=True)]
    return [*points, points[0]]


def box(x0, y0, x1, y1):
    return [{"x": float(a), "y": float(b)} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


@pytest.fixture(scope="module")
def layer(spark):
    rng = np.random.default_rng(6)
    rows = [(f"a{i}", [[star(rng, *rng.uniform(-20, 20, 2), rng.uniform(0.05, 0.6), int(rng.integers(3, 40)))]]) for i in range(40)]
    rows += [("large", [[star(rng, 0, 0, 300, 60), star(rng, 1, 1, 40, 12)]]),        # a thousand times the others, with a hole
             ("parts", [[box(-8, -8, -7, -7)], [box(7, 7, 9, 9), box(7.5, 7.5, 8, 8)]]),  # two polygons, one with a hole
             ("grid", [[box(0, 0, 4, 4)]]), ("grid", [[box(4, 0, 8, 4)]]),            # borders on the leaves' own
             ("flat", [[box(1, 1, 1, 5)]]), ("point", [[box(2, 2, 2, 2)]]), ("none", []), ("null", None)]
    return spark.createDataFrame(rows, f"health_area string, polygons {geo.MULTIPOLYGON_TYPE}")


def test_join_equals_ray_cast_of_all_pairs(spark, layer):
    rng = np.random.default_rng(7)
    at = [*rng.uniform(-25, 25, (3000, 2)).tolist(), *rng.uniform(-400, 400, (300, 2)).tolist(),
          *[[a, b] for a in (0.0, 2.0, 4.0, 7.0, 8.0) for b in (0.0, 4.0, 7.5, 9.0, -7.0)],
          [None, 1.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    cells = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "cell bigint, x double, y double")
    pairs = cells.where("not isnan(x) and not isnan(y)").crossJoin(layer).where(geo.contains("polygons", "x", "y"))
    want = sorted((r.cell, r.health_area.upper()) for r in pairs.select("cell", "health_area").collect())
    out = spatial.cells_in_areas(cells, layer)
    assert out.columns == ["cell", "x", "y", "health_area"]
    assert sorted((r.cell, r.health_area.upper()) for r in out.collect()) == want and len(want) > 1000


def test_cover_is_bounded_and_has_full_leaves(layer):
    leaves = spatial.area_cover(layer).groupBy("health_area").agg(F.count(F.lit(1)).alias("n"), F.count_if("_full").alias("full")).collect()
    most = 4 ** spatial.DEPTH
    assert all(0 < r.n <= 2 * most * (2 if r.health_area.lower() == "grid" else 1) for r in leaves) and {r.health_area.lower() for r in leaves}.isdisjoint({"point", "none", "null"})
    assert sum(r.full for r in leaves) > sum(r.n for r in leaves) / 4


def test_border_leaves_keep_few_edges(spark):
    rng = np.random.default_rng(8)
    layer = spark.createDataFrame([("round", [[star(rng, 3.0, 3.0, 5.0, 2000)]])], f"health_area string, polygons {geo.MULTIPOLYGON_TYPE}")
    kept = spatial.area_cover(layer).where("not _full").select(F.size(F.col("_shape")[0]).alias("n")).agg(F.avg("n")).first()[0]
    assert kept < 500


def test_hot_area_is_spread_over_leaves(spark, layer):
    cells = spark.range(20_000).select((F.rand(1) * 2).alias("x"), (F.rand(2) * 2).alias("y"))
    small = layer.where("health_area = 'grid'")
    side = 2.0 ** (spatial.area_cover(small).agg(F.max("_level")).first()[0] - spatial.DEPTH)
    leaves = cells.groupBy(F.floor(F.col("x") / side), F.floor(F.col("y") / side)).count().agg(F.max("count")).first()[0]
    assert leaves < 20_000 / 20 and spatial.cells_in_areas(cells, small).count() == 20_000 - cells.where("x = 0 or y = 0").count()


def test_empty_layer(spark, layer):
    cells = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    assert spatial.cells_in_areas(cells, layer.limit(0)).count() == 0
