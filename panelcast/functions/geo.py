"""Planar geometry as column expressions on rings of ``{x, y}`` points.

A polygon is ``array<array<struct<x,y>>>``: exterior ring first, then holes.  A
multipolygon is an array of polygons.  All functions are row-local.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .isoweek import Col, _c

# WGS84 equatorial radius in metres, kilometres per degree.
EARTH_RADIUS = 6_378_137.0
KM_PER_DEGREE = 111.0

RING_TYPE = "array<struct<x:double,y:double>>"
POLYGON_TYPE = f"array<{RING_TYPE}>"
MULTIPOLYGON_TYPE = f"array<{POLYGON_TYPE}>"


def point(x: Col, y: Col) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def box_ring(x0: Col, y0: Col, x1: Col, y1: Col) -> Column:
    """Closed counter-clockwise ring of an axis-parallel box."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def _edges(ring: Column) -> Column:
    """Array of (start, end) pairs of a closed ring."""
    return F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))


def ring_moments(ring: Column) -> Column:
    """Signed area and first moments of a ring (shoelace)."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    origin = ring[0]

    def add(acc: Column, edge: Column) -> Column:
        # relative to the first vertex, so large projected coordinates do not cancel
        ax, ay = edge["a"]["x"] - origin["x"], edge["a"]["y"] - origin["y"]
        bx, by = edge["b"]["x"] - origin["x"], edge["b"]["y"] - origin["y"]
        cross = ax * by - bx * ay
        return F.struct((acc["s"] + cross).alias("s"), (acc["mx"] + (ax + bx) * cross).alias("mx"),
                        (acc["my"] + (ay + by) * cross).alias("my"))

    def finish(acc: Column) -> Column:
        area = acc["s"] / 2
        return F.struct(area.alias("area"), (acc["mx"] / 6 + area * origin["x"]).alias("mx"),
                        (acc["my"] / 6 + area * origin["y"]).alias("my"))

    return F.aggregate(_edges(ring), start, add, finish)


def polygon_measures(multipolygon: Col) -> Column:
    """``{area, cx, cy}`` of a multipolygon; holes count negatively whatever their direction."""
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def of_polygon(polygon: Column) -> Column:
        return F.transform(polygon, lambda ring, i: _signed(ring_moments(ring), F.when(i == 0, 1.0).otherwise(-1.0)))

    def _signed(m: Column, sign: Column) -> Column:
        factor = sign * F.signum(m["area"])
        return F.struct((m["area"] * factor).alias("area"), (m["mx"] * factor).alias("mx"), (m["my"] * factor).alias("my"))

    parts = F.flatten(F.transform(_c(multipolygon), of_polygon))
    return F.aggregate(
        parts, zero,
        lambda acc, m: F.struct((acc["area"] + m["area"]).alias("area"), (acc["mx"] + m["mx"]).alias("mx"),
                                (acc["my"] + m["my"]).alias("my")),
        lambda acc: F.struct(acc["area"].alias("area"), F.try_divide(acc["mx"], acc["area"]).alias("cx"),
                             F.try_divide(acc["my"], acc["area"]).alias("cy")))


def _odd_crossings(x: Column, y: Column, edges: Column) -> Column:
    """Whether the ray to the right of a point crosses an odd number of edges."""
    def crossing(inside: Column, edge: Column) -> Column:
        ax, ay, bx, by = edge["a"]["x"], edge["a"]["y"], edge["b"]["x"], edge["b"]["y"]
        spans = (ay > y) != (by > y)
        at = ax + F.try_divide((y - ay) * (bx - ax), by - ay)
        return F.when(spans & (x < at), ~inside).otherwise(inside)

    return F.aggregate(edges, F.lit(False), crossing)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring."""
    return _odd_crossings(x, y, _edges(ring))


def contains(multipolygon: Col, x: Col, y: Col) -> Column:
    """Point in any polygon and outside its holes: parity over all rings of a polygon."""
    x, y = _c(x), _c(y)
    return F.exists(_c(multipolygon), lambda polygon: F.aggregate(
        polygon, F.lit(False), lambda inside, ring: inside != in_ring(x, y, ring)))


def outline(multipolygon: Col) -> Column:
    """The edges of each polygon, those of all its rings together: ``array<array<{a, b}>>``."""
    return F.transform(_c(multipolygon), lambda polygon: F.flatten(F.transform(polygon, _edges)))


def outline_contains(shape: Col, x: Col, y: Col) -> Column:
    """:func:`contains` on an outline."""
    return F.exists(_c(shape), lambda edges: _odd_crossings(_c(x), _c(y), edges))


def outline_beside(shape: Col, box: Column) -> Column:
    """The edges that a ray to the right can cross from within ``box`` (``{x0, y0, x1, y1}``)."""
    return F.transform(_c(shape), lambda edges: F.filter(edges, lambda e: (
        (F.greatest(e["a"]["y"], e["b"]["y"]) >= box["y0"]) & (F.least(e["a"]["y"], e["b"]["y"]) <= box["y1"])
        & (F.greatest(e["a"]["x"], e["b"]["x"]) >= box["x0"]))))


def outline_touches(shape: Col, box: Column) -> Column:
    """Whether an edge comes into ``box``: their extents overlap and the corners are not all on one side of it."""
    def side(e: Column, x: Column, y: Column) -> Column:
        return (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])

    def meets(e: Column) -> Column:
        corners = [side(e, box[x], box[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
        return ((F.greatest(e["a"]["x"], e["b"]["x"]) >= box["x0"]) & (F.least(e["a"]["x"], e["b"]["x"]) <= box["x1"])
                & (F.greatest(e["a"]["y"], e["b"]["y"]) >= box["y0"]) & (F.least(e["a"]["y"], e["b"]["y"]) <= box["y1"])
                & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))

    return F.exists(_c(shape), lambda edges: F.exists(edges, meets))


def bounds(multipolygon: Col) -> Column:
    """``{x0, y0, x1, y1}`` of a multipolygon."""
    points = F.flatten(F.flatten(_c(multipolygon)))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


# ---------------------------------------------------------------------------
# Mollweide (equal-area) projection, metres
# ---------------------------------------------------------------------------
def _mollweide_angle(lat: Column) -> Column:
    """Solve 2t + sin 2t = pi sin(lat); twelve Newton steps, exact at the poles."""
    target = F.lit(math.pi) * F.sin(lat)

    def step(t: Column, _: Column) -> Column:
        slope = 2 + 2 * F.cos(2 * t)
        return F.when(slope < 1e-12, t).otherwise(t - (2 * t + F.sin(2 * t) - target) / slope)

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), lat * 0.9, step)


def to_mollweide(lon: Col, lat: Col) -> Column:
    """``{x, y}`` in metres of a WGS84 position in degrees."""
    lam, phi = F.radians(_c(lon).cast("double")), F.radians(_c(lat).cast("double"))
    t = _mollweide_angle(phi)
    return F.struct((lam * F.cos(t) * (EARTH_RADIUS * 2 * math.sqrt(2) / math.pi)).alias("x"),
                    (F.sin(t) * (EARTH_RADIUS * math.sqrt(2))).alias("y"))


def from_mollweide(x: Col, y: Col) -> Column:
    """``{x: longitude, y: latitude}`` in degrees of projected metres."""
    t = F.asin(_c(y) / (EARTH_RADIUS * math.sqrt(2)))
    lat = F.asin((2 * t + F.sin(2 * t)) / math.pi)
    lon = _c(x) / (F.cos(t) * (EARTH_RADIUS * 2 * math.sqrt(2) / math.pi))
    return F.struct(F.degrees(lon).alias("x"), F.degrees(lat).alias("y"))


def project(multipolygon: Col) -> Column:
    return F.transform(_c(multipolygon), lambda polygon: F.transform(
        polygon, lambda ring: F.transform(ring, lambda p: to_mollweide(p["x"], p["y"]))))


# ---------------------------------------------------------------------------
# distances
# ---------------------------------------------------------------------------
def segment_distance(px: Col, py: Col, x1: Col, y1: Col, x2: Col, y2: Col) -> Column:
    """Distance of a point to a segment (a point when both ends coincide)."""
    px, py, x1, y1, x2, y2 = map(_c, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ox, oy = px - (x1 + along * dx), py - (y1 + along * dy)
    return F.sqrt(ox * ox + oy * oy)


def haversine_km(lon1: Col, lat1: Col, lon2: Col, lat2: Col) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = a2 - a1, F.radians(_c(lon2) - _c(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS / 1000) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
