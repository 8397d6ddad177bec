"""Spatial joins: cells in polygons (quadtree leaves), nearest lines and points, neighbours, clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalars import normal_key, urban_class
from ..session import materialise

# ---------------------------------------------------------------------------
# layer geometry
# ---------------------------------------------------------------------------
def area_geometry(layer: DataFrame) -> DataFrame:
    """Area in km2, projected centroid and centroid in degrees of each polygon (row-local)."""
    measured = layer.withColumn("_m", geo.polygon_measures(geo.project("polygons")))
    back = geo.from_mollweide(F.col("_m.cx"), F.col("_m.cy"))
    return measured.select(
        normal_key("health_area").alias("health_area"), (F.col("_m.area") / 1e6).alias("Superficie_km2"),
        back["x"].alias("longitude"), back["y"].alias("latitude"),
        F.col("_m.cx").alias("proj_x"), F.col("_m.cy").alias("proj_y"))


def layer_centre(geometry: DataFrame) -> DataFrame:
    """Mean of the centroids, for centring a map."""
    return geometry.agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def heat_points(layer: DataFrame, weight: str) -> DataFrame:
    """(latitude, longitude, weight) of the areas with a positive weight."""
    return layer.where(F.col(weight) > 0).select("latitude", "longitude", F.col(weight).cast("double").alias("weight"))


# ---------------------------------------------------------------------------
# point in polygon
# ---------------------------------------------------------------------------
DEPTH = 4          # splits of an area's tiles, so a leaf is a 4th to a 16th of the area across
FINEST = -30       # exponent of the smallest tile; leaf numbers of coordinates up to 1e8 fit 64 bits
MARGIN = 1e-6      # of a node, by which it is widened against rounding


def area_cover(layer: DataFrame) -> DataFrame:
    """Quadtree leaves of every area: ``health_area, _level, _ix, _iy, _full, _shape``.

    Sides are powers of two, every second one, so an area lies in at most four tiles of
    its own level whatever the other areas are like, and the number of leaves of an area
    is bounded.  A node is split with the edges that matter within it; a node without an
    edge is full or is dropped.  ``_full`` leaves lie inside the area; the others keep the
    edges that a ray cast from within them can cross.  All of it is row-local.
    """
    extent = F.greatest(F.col("_b.x1") - F.col("_b.x0"), F.col("_b.y1") - F.col("_b.y0"))
    nodes = (layer.select(normal_key("health_area").alias("health_area"), geo.outline("polygons").alias("_shape"), geo.bounds("polygons").alias("_b"))
             .where((extent > 0) & (extent < F.lit(float("inf"))))  # an area without extent holds no cell
             .withColumn("_level", F.greatest(F.lit(FINEST), 2 * F.ceil(F.log2(extent) / 2)).cast("int")))
    side = lambda depth: F.pow(F.lit(2.0), F.col("_level") - depth)
    span = lambda axis: F.sequence(F.floor(F.col(f"_b.{axis}0") / side(0)), F.floor(F.col(f"_b.{axis}1") / side(0)))
    nodes = nodes.withColumn("_ix", F.explode(span("x"))).withColumn("_iy", F.explode(span("y"))).drop("_b").withColumn("_full", F.lit(False))
    for depth in range(0, DEPTH + 1, 2):
        if depth:  # two levels of the tree at once
            part = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in range(4) for j in range(4)]))
            nodes = nodes.withColumn("_part", part).withColumns({"_ix": F.col("_ix") * 4 + F.col("_part.x"), "_iy": F.col("_iy") * 4 + F.col("_part.y")}).drop("_part")
        s, x, y = side(depth), F.col("_ix"), F.col("_iy")
        box = F.struct(((x - MARGIN) * s).alias("x0"), ((y - MARGIN) * s).alias("y0"), ((x + 1 + MARGIN) * s).alias("x1"), ((y + 1 + MARGIN) * s).alias("y1"))
        nodes = nodes.withColumn("_box", box).withColumn("_shape", F.when(~F.col("_full"), geo.outline_beside("_shape", F.col("_box"))))
        nodes = nodes.withColumn("_edge", F.coalesce(geo.outline_touches("_shape", F.col("_box")), F.lit(False)))
        nodes = nodes.withColumn("_full", F.col("_full") | (~F.col("_edge") & F.coalesce(geo.outline_contains("_shape", (x + 0.5) * s, (y + 0.5) * s), F.lit(False))))
        nodes = nodes.where("_full or _edge").drop("_box", "_edge")
    return nodes.withColumn("_shape", F.when(~F.col("_full"), F.col("_shape")))


def cells_in_areas(cells: DataFrame, layer: DataFrame) -> DataFrame:
    """Cells (``x, y, ...``) with the ``health_area`` whose polygon contains them.

    Areas are cut to quadtree leaves (:func:`area_cover`), a cell lies in one leaf of each
    level in use, and the two meet by an equi-join.  A leaf inside its area takes its cells
    as they are, one at the border casts rays at its own edges.  An area that holds a third
    of all cells is spread over its leaves; a single crowded leaf is left to the skew
    handling of adaptive execution.  Cells without a position lie nowhere.
    """
    cover = materialise(area_cover(layer))
    levels = sorted(r[0] for r in cover.select("_level").distinct().collect())  # a few exponents
    if not levels:
        return cells.withColumn("health_area", F.lit(None).cast("string")).limit(0)
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(2.0 ** (n - DEPTH)).alias("side")) for n in levels]))
    known = ~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull()
    placed = cells.where(known).withColumn("_grid", grid).withColumns({
        "_level": F.col("_grid.level"), "_ix": F.floor(F.col("x") / F.col("_grid.side")), "_iy": F.floor(F.col("y") / F.col("_grid.side"))})
    joined = placed.join(cover, ["_level", "_ix", "_iy"]).where(F.col("_full") | geo.outline_contains("_shape", "x", "y"))
    return joined.drop("_level", "_ix", "_iy", "_grid", "_full", "_shape")


def _all_areas(layer: DataFrame, stats: DataFrame) -> DataFrame:
    """Areas without any cell keep a row of nulls."""
    return layer.select(normal_key("health_area").alias("health_area")).distinct().join(stats, "health_area", "left")


# Fixed names of the zonal statistics.
ZONAL = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop, "sum": F.sum, "count": F.count}


def zonal_statistics(cells: DataFrame, layer: DataFrame, stats: Sequence[str] = ("mean",), value: str = "value",
                     scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Statistics of ``value * scale + offset`` per area; no-data (null) cells do not count."""
    scaled = F.col(value) * scale + offset
    inside = cells_in_areas(cells.where(F.col(value).isNotNull()), layer)
    table = inside.groupBy("health_area").agg(*[ZONAL[s](scaled).alias(s) for s in stats])
    return _all_areas(layer, table)


def zonal_band_totals(cells: DataFrame, layer: DataFrame, band: str = "band", value: str = "value") -> DataFrame:
    """Sum of population cells per (area, band)."""
    return cells_in_areas(cells, layer).groupBy("health_area", band).agg(F.sum(value).alias("population"))


def zonal_majority(cells: DataFrame, layer: DataFrame, value: str = "value") -> DataFrame:
    """Most frequent class per area (ties: smallest) and its settlement label.

    Classes are counted before the mode is taken, so an area is never collected.
    """
    counts = (cells_in_areas(cells.where(F.col(value).isNotNull()), layer)
              .groupBy("health_area", value).agg(F.count(F.lit(1)).alias("n")))
    top = counts.groupBy("health_area").agg(F.max(F.struct(F.col("n"), (-F.col(value)).alias("neg"))).alias("t"))
    majority = top.select("health_area", (-F.col("t.neg")).alias("majority"))
    return _all_areas(layer, majority).withColumn("Urbanisation", urban_class("majority"))


def zonal_share(cells: DataFrame, layer: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Percentage of cells per area for each named condition."""
    table = cells_in_areas(cells, layer).groupBy("health_area").agg(*[
        (F.avg(F.when(mask, 1.0).when(mask.isNotNull(), 0.0)) * 100).alias(name) for name, mask in masks.items()])
    return _all_areas(layer, table)


def zonal_fraction(cells: DataFrame, layer: DataFrame, divisor: float, value: str = "value", name: str = "pct") -> DataFrame:
    """Mean of ``value / divisor`` as a percentage (water occurrence / 100, seasonality / 12)."""
    table = cells_in_areas(cells.where(F.col(value).isNotNull()), layer).groupBy("health_area").agg(
        (F.avg(F.col(value) / divisor) * 100).alias(name))
    return _all_areas(layer, table)


def seasonal_statistics(images: DataFrame, layer: DataFrame, scale: float = 1.0, offset: float = 0.0,
                        value: str = "value") -> DataFrame:
    """Mean level and seasonal amplitude from a stack of dated cells.

    Per cell over its images first (partial aggregation), then per area.
    Scale 1e-4 suits vegetation indices, 0.02 with offset -273.15 surface temperature.
    """
    scaled = F.col(value) * scale + offset
    per_cell = images.where(F.col(value).isNotNull()).groupBy("x", "y").agg(
        F.avg(scaled).alias("level"), (F.max(scaled) - F.min(scaled)).alias("amplitude"))
    table = cells_in_areas(per_cell, layer).groupBy("health_area").agg(
        F.avg("level").alias("mean"), F.avg("amplitude").alias("seasonality"))
    return _all_areas(layer, table)


# ---------------------------------------------------------------------------
# nearest neighbours
# ---------------------------------------------------------------------------
LEAF = 16          # targets a finest cell should hold
MAX_DEPTH = 12     # 4096 x 4096 cells
HOME = 64          # points that a cell of points should hold
CROWD = 1024       # points that are compared together at most
BLOCK = 4_000_000  # distances that a task holds at once


def _apart(edges: Sequence[str]) -> tuple[Column, Column]:
    """Smallest and largest distance between the box of a cell (x0, y0, x1, y1) and another box."""
    near, far = F.lit(0.0), F.lit(0.0)
    for low, high, other_low, other_high in (("x0", "x1", edges[0], edges[2]), ("y0", "y1", edges[1], edges[3])):
        gap = F.greatest(F.col(low) - F.col(other_high), F.col(other_low) - F.col(high), F.lit(0.0))
        reach = F.greatest(F.col(other_high) - F.col(low), F.col(high) - F.col(other_low))
        near, far = near + gap * gap, far + reach * reach
    return F.sqrt(near), F.sqrt(far)


def k_nearest(points: DataFrame, targets: DataFrame, k: int = 1, exclude_self: bool = False) -> DataFrame:
    """The ``k`` targets nearest to each point, exactly and without a cross join.

    ``points``: ``pid, px, py``.  ``targets``: ``tid, x1, y1, x2, y2`` (segments; a
    point has both ends equal).  Result: ``pid, tid, distance, rank``.

    Long segments are cut to pieces of about a finest cell.  Pieces are filed by midpoint
    into a pyramid of grid cells, each with the true bounding box of its pieces and the
    number of its targets (a target counts where its middle piece is).  Points are filed
    by cells of the same grid, and these cells, not the points, descend the pyramid two
    levels per join.  At each stop the largest distance to the boxes that together hold
    ``k`` targets bounds the k-th distance, and boxes that start beyond it are dropped.
    The targets of the surviving finest cells meet the points of a cell in one bounded
    group, by their whole segments.  Ties go to the smaller ``tid``; rows without a position come last.
    """
    copies = Window.partitionBy("x1", "y1", "x2", "y2", "tid").orderBy("tid")
    spots = Window.partitionBy("x1", "y1", "x2", "y2").orderBy("tid")
    ends = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    # of targets in one place only the first can be among the nearest, however many there are
    placed = targets.select("tid", *ends).withColumns({"_copy": F.row_number().over(copies), "_same": F.dense_rank().over(spots)})
    placed = placed.where((F.col("_copy") <= k) & (F.col("_same") <= (k + 1 if exclude_self else k)))
    mid = materialise(placed.select("tid", "x1", "y1", "x2", "y2", ((F.col("x1") + F.col("x2")) / 2).alias("_mx"), ((F.col("y1") + F.col("y2")) / 2).alias("_my"),
                                    F.monotonically_increasing_id().alias("_row")))
    known = mid.where(F.col("_mx").isNotNull() & F.col("_my").isNotNull())
    frame = known.agg(F.count(F.lit(1)), F.min("_mx"), F.min("_my"), F.max("_mx"), F.max("_my")).first()
    n, left, low = frame[0], frame[1] or 0.0, frame[2] or 0.0
    side = max((frame[3] or 0.0) - left, (frame[4] or 0.0) - low) or 1.0
    wanted = k
    if exclude_self:
        wanted = k + (mid.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
    depth = 1
    while depth < MAX_DEPTH and n > LEAF * 4 ** depth:
        depth += 1
    # clustered targets leave most cells empty: refine until the fullest cell is small
    while depth < MAX_DEPTH and n > LEAF * 4:
        fullest = (known.groupBy(*_cell(left, low, side, depth)).count().agg(F.max("count")).first()[0] or 0)
        if fullest <= LEAF * 4:
            break
        depth += 2
    depth = min(depth, MAX_DEPTH)
    pieces = F.least(F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / (side / 2 ** depth)), F.lit(2 ** depth))
    cut = known.withColumn("_cut", F.greatest(pieces, F.lit(1))).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cut") - 1)))

    def along(c: str, i: Column) -> Column:
        # both ends of a segment stay as they are
        return F.when(i == F.col("_cut"), F.col(c + "2")).otherwise(F.col(c + "1") + (F.col(c + "2") - F.col(c + "1")) * (i / F.col("_cut")))

    cut = cut.withColumns({"_fx": along("x", F.col("_i")), "_fy": along("y", F.col("_i")), "_tx": along("x", F.col("_i") + 1), "_ty": along("y", F.col("_i") + 1)})
    cut = cut.withColumns({"_mx": (F.col("_fx") + F.col("_tx")) / 2, "_my": (F.col("_fy") + F.col("_ty")) / 2, "held": (F.col("_i") == F.floor(F.col("_cut") / 2)).cast("bigint")})
    ix, iy = _cell(left, low, side, depth)
    filed = materialise(cut.select(ix.alias("_ix"), iy.alias("_iy"), "tid", "_row", "held", "x1", "y1", "x2", "y2", "_fx", "_fy", "_tx", "_ty"))
    finest = materialise(filed.groupBy("_ix", "_iy").agg(F.min(F.least("_fx", "_tx")).alias("x0"), F.min(F.least("_fy", "_ty")).alias("y0"),
                                                         F.max(F.greatest("_fx", "_tx")).alias("x1"), F.max(F.greatest("_fy", "_ty")).alias("y1"), F.sum("held").alias("held")))
    again = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("held").alias("held")]
    # copies of a point have the same neighbours, and only k rows of a key are returned
    spot = points.select("pid", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).groupBy("pid", "px", "py").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_times"))
    lost = F.col("px").isNull() | F.col("py").isNull()
    spot = materialise(spot)
    rows, home = spot.count(), 0
    while home < depth and rows > HOME * 4 ** home:
        home += 1
    spot = spot.withColumns(dict(zip(("_cx", "_cy"), _cell(left, low, side, home, "px", "py"))))
    homes = spot.where(~lost).groupBy("_cx", "_cy").agg(F.min("px").alias("a0"), F.min("py").alias("b0"), F.max("px").alias("a1"), F.max("py").alias("b1"), F.count(F.lit(1)).alias("_n"))
    homes = homes.select("_cx", "_cy", F.struct("a0", "b0", "a1", "b1", "_n").alias("_home"))
    alive = homes.withColumns({"_ix": F.lit(0).cast("bigint"), "_iy": F.lit(0).cast("bigint")})
    by_far = Window.partitionBy("_cx", "_cy").orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)
    levels = sorted({*range(2, depth + 1, 2), depth})  # two levels per join: 16 children at a time
    near, far = _apart([f"_home.{c}" for c in ("a0", "b0", "a1", "b1")])
    for above, level in zip([0, *levels], levels):
        shrink, fan = 2 ** (depth - level), 2 ** (level - above)
        cells = finest.select(F.floor(F.col("_ix") / shrink).alias("_ix"), F.floor(F.col("_iy") / shrink).alias("_iy"),
                              "x0", "y0", "x1", "y1", "held").groupBy("_ix", "_iy").agg(*again)
        cells = cells.withColumns({"_px": F.floor(F.col("_ix") / fan), "_py": F.floor(F.col("_iy") / fan)})
        if level <= 6:
            cells = F.broadcast(cells)  # at most 4**6 = 4096 rows, whatever the number of targets
        parents = alive.select("_cx", "_cy", "_home", F.col("_ix").alias("_px"), F.col("_iy").alias("_py"))
        scored = parents.join(cells, ["_px", "_py"]).withColumns({"_near": near, "_far": far})
        reach = scored.withColumn("_upto", F.sum("held").over(by_far))
        limit = F.min(F.when(F.col("_upto") >= wanted, F.col("_far"))).over(Window.partitionBy("_cx", "_cy"))
        # the slack covers the rounding of cut segments and of distances
        alive = (reach.withColumn("_limit", limit)
                 .where(F.col("_limit").isNull() | (F.col("_near") <= F.col("_limit") * (1 + 1e-9) + side * 1e-12))
                 .select("_cx", "_cy", "_home", "_ix", "_iy"))
    # crowded cells are cut to groups of points
    slices = F.ceil(F.col("_home._n") / CROWD)
    edges = alive.select("_cx", "_cy", "_ix", "_iy", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)).alias("_s"))
    near_by = edges.join(filed.select("_ix", "_iy", "_row", "x1", "y1", "x2", "y2"), ["_ix", "_iy"]).select("_cx", "_cy", "_s", "_row", "x1", "y1", "x2", "y2")
    own = spot.where(~lost).join(homes.select("_cx", "_cy", slices.alias("_slices")), ["_cx", "_cy"])
    own = own.select("_cx", "_cy", F.pmod(F.xxhash64("pid", "px", "py"), "_slices").alias("_s"), "pid", "px", "py", "_times")
    numbered = materialise(own.withColumn("_point", F.monotonically_increasing_id()))
    found = (numbered.select("_cx", "_cy", "_s", "_point", "px", "py").groupBy("_cx", "_cy", "_s").cogroup(near_by.groupBy("_cx", "_cy", "_s"))
             .applyInPandas(_nearest_rows(wanted), "_point bigint, _row bigint, distance double"))
    some = numbered.select("_point", "pid", "_times").join(found, "_point").join(mid.select("_row", "tid"), "_row")
    # points without a position take the first targets, as do all where fewer than k targets have one
    first = mid.orderBy("tid").limit(wanted).select("tid")
    nowhere = spot.where(lost).select("pid", "_times").join(F.broadcast(first)).withColumn("distance", F.lit(None).cast("double"))
    pairs = some.select("pid", "_times", "tid", "distance").unionByName(nowhere.select("pid", "_times", "tid", "distance"))
    if n < wanted:
        unplaced = mid.where(F.col("_mx").isNull() | F.col("_my").isNull()).orderBy("tid").limit(wanted).select("tid")
        pairs = pairs.unionByName(spot.where(~lost).select("pid", "_times").join(F.broadcast(unplaced)).withColumn("distance", F.lit(None).cast("double")))
    if exclude_self:
        pairs = pairs.where(F.col("pid") != F.col("tid"))
    pairs = pairs.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).drop("_times")
    order = Window.partitionBy("pid").orderBy(F.asc_nulls_last("distance"), "tid")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("pid", "tid", "distance", "rank")


def _nearest_rows(wanted: int):
    """Function of a group's points and targets: the ``wanted`` nearest of each point, and all as near as the last of them."""
    def nearest(points: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        targets = targets.drop_duplicates("_row")
        x1, y1, x2, y2 = (targets[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
        dx, dy = x2 - x1, y2 - y1
        square = dx * dx + dy * dy
        whole = np.where(square == 0, 1.0, square)
        px, py, point, row = points["px"].to_numpy(), points["py"].to_numpy(), points["_point"].to_numpy(), targets["_row"].to_numpy()
        out = []
        step = max(1, BLOCK // max(1, len(row)))
        for at in range(0, len(point) if len(row) else 0, step):
            qx, qy = px[at:at + step, None], py[at:at + step, None]
            if square.any():
                share = np.where(square == 0, 0.0, ((qx - x1) * dx + (qy - y1) * dy) / whole)
                share = np.minimum(np.maximum(share, 0.0), 1.0)
                ox, oy = qx - (x1 + share * dx), qy - (y1 + share * dy)
            else:
                ox, oy = qx - x1, qy - y1
            distance = np.sqrt(ox * ox + oy * oy)
            last = np.partition(distance, wanted - 1, axis=1)[:, wanted - 1:wanted] if wanted < len(row) else np.inf
            i, j = np.nonzero(distance <= last)
            out.append((point[at + i], row[j], distance[i, j]))
        columns = [np.concatenate([o[c] for o in out]) if out else np.empty(0, t) for c, t in enumerate(("int64", "int64", "float64"))]
        return pd.DataFrame(dict(zip(("_point", "_row", "distance"), columns)))
    return nearest


def _cell(left: float, low: float, side: float, depth: int, x: str = "_mx", y: str = "_my") -> list[Column]:
    cells = 2 ** depth
    top = F.lit(cells - 1).cast("bigint")
    return [F.least(F.greatest(F.floor((F.col(c) - start) / side * cells), F.lit(0)), top).alias(name)
            for c, start, name in ((x, left, "_ix"), (y, low, "_iy"))]


def as_targets(points: DataFrame, tid: str, x: str, y: str) -> DataFrame:
    """Points in the segment form :func:`k_nearest` reads."""
    return points.select(F.col(tid).alias("tid"), *[F.col(c).cast("double").alias(n)
                                                    for c, n in ((x, "x1"), (y, "y1"), (x, "x2"), (y, "y2"))])


def build_neighbour_weights(centroids: DataFrame, k: int = 5, x: str = "proj_x", y: str = "proj_y") -> DataFrame:
    """Edges to the ``k`` nearest areas, inverse-distance weights summing to 1 per area."""
    near = k_nearest(centroids.select(F.col("health_area").alias("pid"), F.col(x).alias("px"), F.col(y).alias("py")),
                     as_targets(centroids, "health_area", x, y), k, exclude_self=True)
    raw = F.lit(1.0) / (F.col("distance") + 1e-6)
    share = raw / F.sum(raw).over(Window.partitionBy("pid"))
    return near.select(F.col("pid").alias("health_area"), F.col("tid").alias("neighbor"), share.alias("weight"))


def distance_to_lines(areas: DataFrame, segments: DataFrame, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Kilometres (degrees x 111) from each area's centroid to the nearest line segment."""
    targets = segments.distinct().select(F.xxhash64("x1", "y1", "x2", "y2").alias("tid"), "x1", "y1", "x2", "y2")
    near = k_nearest(areas.select(F.col("health_area").alias("pid"), F.col(x).alias("px"), F.col(y).alias("py")), targets)
    return near.select(F.col("pid").alias("health_area"), (F.col("distance") * geo.KM_PER_DEGREE).alias("distance_km"))


def distance_to_water(cells: DataFrame, layer: DataFrame, is_water: Column) -> DataFrame:
    """Mean distance per area from its cells to the nearest water cell, in km (one cell per position)."""
    keyed = (cells.groupBy("x", "y").agg(F.coalesce(F.bool_or(is_water), F.lit(False)).alias("_water"))
             .withColumn("pid", F.xxhash64("x", "y")))
    water = as_targets(keyed.where("_water"), "pid", "x", "y")
    near = k_nearest(keyed.select("pid", F.col("x").alias("px"), F.col("y").alias("py")), water)
    located = cells_in_areas(keyed.select("pid", "x", "y"), layer).join(near.select("pid", "distance"), "pid")
    table = located.groupBy("health_area").agg((F.avg("distance") * geo.KM_PER_DEGREE).alias("Dist_Eau_km"))
    return _all_areas(layer, table)


def within_radius(areas: DataFrame, alerts: DataFrame, radius_km: float = 30.0, x: str = "longitude",
                  y: str = "latitude") -> DataFrame:
    """Every area with its nearest alerting area, the distance and whether it is in the response radius."""
    source = areas.join(alerts.select("health_area").distinct(), "health_area", "left_semi")
    near = k_nearest(areas.select(F.col("health_area").alias("pid"), F.col(x).alias("px"), F.col(y).alias("py")),
                     as_targets(source, "health_area", x, y))
    distance = F.col("distance") * geo.KM_PER_DEGREE
    return near.select(F.col("pid").alias("health_area"), F.col("tid").alias("alert_area"), distance.alias("distance_km"),
                       (distance <= radius_km).alias("in_radius"))


# ---------------------------------------------------------------------------
# clusters
# ---------------------------------------------------------------------------
def spatial_clusters(centroids: DataFrame, k: int = 5, seed: int = 42, x: str = "proj_x", y: str = "proj_y") -> DataFrame:
    """k-means on the centroids: ``health_area, spatial_cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=[x, y], outputCol="_xy").transform(centroids.dropna(subset=[x, y]))
    model = KMeans(k=k, seed=seed, featuresCol="_xy", predictionCol="spatial_cluster").fit(data)
    return model.transform(data).select("health_area", "spatial_cluster")
