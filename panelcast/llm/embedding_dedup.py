"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one vector with a number of copies.  A pass hashes every vector to
the signs of its projections on 124 random directions, two words of 62.  The vectors of
all passes are ordered lexicographically by pass, width and concatenated signs, and every
vector meets its next ``WINDOW`` neighbours and the rest of its run (the vectors that
agree with it in the leading signs).  The order is cut into chunks of equal length, each
with the beginning of the next one, so no neighbour is lost at a border.

Only signs and ids are sorted.  Neighbours whose signs differ too often to be linked are
passed over; vectors with a neighbour left are joined to their numbers and compared in
double precision, in the same order, within the same bounds.  A chunk reports one edge
for each linked vector (to the smallest one that it is connected with), never all pairs,
and the edges of all passes are united to components.

Two vectors at the threshold agree in a sign with probability 1 - acos(t)/pi.  A run has
so many signs that evenly spread vectors would leave it half a window to a window of
rows; the number of passes follows from that, from the chance that the signs of a link
differ too often, and from the accepted chance to miss such a pair (closer pairs are
missed far less).  Nothing else is assumed about the spread.  A run with more rows than
all passes together may cost (vectors in a narrow cone share their signs) is longer than
a neighbourhood may be; its vectors are crowded, and crowded vectors are compared with
each other exactly, block against block, once.  So each pair that agrees in the signs of
a pass is compared, however crowded its surroundings are; the price is one comparison of
every two crowded vectors.

All links of a vector lie in its component, so the direct links are then counted
inside components, block against block, without listing pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..session import materialise
from .common import connected_components, partitions

WINDOW, MISS, SIGNS, BLOCK = 512, 1e-6, 62, 1024
#: Chance that the signs of a pair at the threshold differ in more places than are looked at, for one word and for both.
BLUR = 1e-3
#: Runs of up to so many rows are compared in their pass at any number of rows.
CROWD = 1024
#: Rows of one chunk of the order, and numbers that a chunk's vectors may hold.
CHUNK, ROOM = 1 << 15, 1 << 24
#: Numbers that a task holds of one block, or of one slice of products.
HELD = 1 << 22
#: A component (or a width) and two of its blocks.
TILE = ("component", "i", "j")


def passes_needed(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has been side by side with probability 1 - miss."""
    agree = 1 - math.acos(threshold) / math.pi
    met = agree ** max(1.0, math.log2(max(n, 2) / window) + 1) * (1 - 2 * BLUR)
    return max(4, math.ceil(math.log(miss) / math.log(1 - met)))


def signs_needed(n: int, window: int = WINDOW) -> int:
    """Signs that two vectors of a run agree in, never more than ``passes_needed`` counts on."""
    return min(SIGNS, int(max(1.0, math.log2(max(n, 2) / window) + 1)))


def signs_apart(threshold: float, signs: int) -> int:
    """Signs in which a pair at the threshold differs at most, but for a chance of ``BLUR``."""
    apart, left = math.acos(threshold) / math.pi, 1.0
    for k in range(signs):
        left -= math.comb(signs, k) * apart ** k * (1 - apart) ** (signs - k)
        if left <= BLUR:
            return k
    return signs


def directions(number: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, number, width]).standard_normal((width, 2 * SIGNS))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _keyed(passes: int, seed: int):
    """The signs of every vector in every pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(SIGNS - 1, -1, -1)).astype(np.int64)
        planes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            widths = np.asarray(batch.column("width"))
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width)) if len(np.unique(widths)) > 1 else batch
                x = _vectors(part.column("v"), int(width))
                if int(width) not in planes:
                    planes[int(width)] = [directions(p, int(width), seed) for p in range(passes)]
                for p in range(passes):
                    signs = ((x @ planes[int(width)][p]) > 0).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(x), p, np.int32)), part.column("width"), pa.array(signs[:, :SIGNS] @ weights),
                                           pa.array(signs[:, SIGNS:] @ weights), part.column("id")], names=["pass", "width", "run", "more", "id"])
    return run


def _neighbours(run: np.ndarray, more: np.ndarray, lead: np.ndarray, window: int, crowd: int, one: int, both: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of signs: those with a neighbour that may be linked, and those of runs beyond ``crowd``."""
    n = len(run)
    rows, hit = np.arange(n), np.zeros(n, bool)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(lead)) + 1, [n]])
    length, stop = np.repeat(np.diff(cuts), np.diff(cuts)), np.repeat(cuts[1:], np.diff(cuts))
    crowded = length > crowd
    reach = np.where(crowded, window, np.maximum(window, stop - 1 - rows))

    def meet(i: np.ndarray, step: int) -> None:
        j = i + step
        close = np.bitwise_count(run[i] ^ run[j]) + np.bitwise_count(more[i] ^ more[j]) <= both
        close &= ~(crowded[i] & crowded[j])
        hit[i[close]] = hit[j[close]] = True

    for step in range(1, min(window, n - 1) + 1):
        meet(np.flatnonzero(np.bitwise_count(run[:-step] ^ run[step:]) <= one), step)
    live = np.flatnonzero(reach > window)
    for step in range(window + 1, n):
        live = live[reach[live] >= step]
        if not len(live):
            break
        meet(live[np.bitwise_count(run[live] ^ run[live + step]) <= one], step)
    return hit, crowded


def _candidates(signs: int, window: int, crowd: int, threshold: float):
    """Rows to be compared (id, place), and runs beyond ``crowd`` (lead)."""
    one, both = signs_apart(threshold, SIGNS), signs_apart(threshold, 2 * SIGNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk, number, width), at, first, more, ids in _groups(batches, ("chunk", "pass", "width"), "at", "run", "more", "id"):
            lead = first >> (SIGNS - signs)
            hit, crowded = _neighbours(first, more, lead, window, crowd, one, both)
            runs = np.unique(lead[crowded])
            n, m = int(hit.sum()), len(runs)
            if n + m:
                none = lambda k: pa.nulls(k, pa.int64())
                yield pa.record_batch([pa.array(np.full(n + m, chunk, np.int64)), pa.array(np.full(n + m, number, np.int32)), pa.array(np.full(n + m, width, np.int32)),
                                       pa.concat_arrays([pa.array(at[hit]), none(m)]), pa.concat_arrays([pa.array(ids[hit]), none(m)]),
                                       pa.concat_arrays([none(n), pa.array(runs)])], names=["chunk", "pass", "width", "at", "id", "lead"])
    return run


def _united(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index connected with each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], *columns: str):
    """(key, columns, vectors if there are any) of the rows of each key; the rows of a key follow each other, over batches too."""
    held = None
    for batch in batches:
        at, given = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in keys]), [np.asarray(batch.column(c)) for c in columns]
        cuts = [0, *(np.flatnonzero((np.diff(at) != 0).any(0)) + 1), at.shape[1]]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if start == stop:
                continue
            group = (tuple(at[:, start].tolist()), *(c[start:stop] for c in given))
            if "v" in batch.schema.names:
                column = batch.column("v").slice(start, stop - start)
                group = (*group, _vectors(column, len(column[0])))
            if held is not None and held[0] == group[0]:
                held = (held[0], *(np.concatenate(x) for x in zip(held[1:], group[1:], strict=True)))
            else:
                if held is not None:
                    yield held
                held = group
    if held is not None:
        yield held


def _table(names: list[str], groups):
    """Record batches of two columns of whole numbers from pairs of arrays."""
    done, rows = [], 0
    for pair in groups:
        if len(pair[0]):
            done.append(pair)
            rows += len(pair[0])
        if rows > 100_000:
            yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*done, strict=True)], names=names)
            done, rows = [], 0
    if done:
        yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*done, strict=True)], names=names)


def _stars(ids: np.ndarray, x: np.ndarray, threshold: float, left: int | None = None, until: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the linked vectors to the smallest they are connected with: all rows (each as far as ``until``), or the first ``left`` against the others."""
    n, last = len(ids), len(ids) if left is None else left
    pairs, many, step = [], 0, max(1, HELD // max(len(ids), 1))
    order = np.argsort(ids, kind="stable")  # indices in the order of ids, so the smallest index is the smallest id
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)

    def united():
        root = _united(*np.concatenate(pairs, axis=1), n)
        moved = np.flatnonzero(root != np.arange(n))
        return np.stack([root[moved], moved])

    for start in range(0, last, step):
        base = start if left is None else left
        stop = min(start + step, last)
        end = n if until is None else int(until[stop - 1])
        i, j = np.nonzero(x[start:stop] @ x[base:end].T >= threshold)
        i, j = i + start, j + base
        apart = i < j
        if apart.any():
            pairs.append(np.stack([place[i[apart]], place[j[apart]]]))
            many += pairs[-1].shape[1]
            if many > HELD:
                pairs = [united()]
                many = pairs[0].shape[1]
    if not pairs:
        return ids[:0], ids[:0]
    low, moved = united()
    return ids[order][low], ids[order][moved]


def _chunk_edges(threshold: float, reach: int):
    """Rows of a chunk against those at most ``reach`` places further in the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _table(["a", "b"], (_stars(ids, x, threshold, until=np.searchsorted(at, at + reach, "right"))
                                       for _, at, ids, x in _groups(batches, ("chunk", "pass", "width"), "at", "id") if len(ids) > 1))
    return run


def _tile_edges(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _table(["a", "b"], (_stars(ids, x, threshold, None if key[1] == key[2] else int((side == 0).sum()))
                                       for key, ids, side, x in _groups(batches, TILE, "id", "side")))
    return run


def _tiles(members: DataFrame, unit: DataFrame) -> DataFrame:
    """(component, id, blocks) -> the vectors of every two blocks of a component, a tile's first block before its second."""
    against = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), (F.col("own") > o).cast("int").alias("side")))
    rows = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(unit.select("id", "copies", "v"), "id")
    rows = rows.withColumn("at", F.explode(against)).select("component", "at.*", "id", "copies", "v")
    return rows.repartition(partitions(unit.sparkSession), *TILE).sortWithinPartitions(*TILE, "side")


def _counted(threshold: float):
    def links(key, ids, side, copies, x):
        if key[1] == key[2]:  # a block with itself
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            return ids, near @ copies
        left, right = side == 0, side == 1
        near = x[left] @ x[right].T >= threshold
        return np.concatenate([ids[left], ids[right]]), np.concatenate([near @ copies[right], near.T @ copies[left]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _table(["id", "links"], (links(*group) for group in _groups(batches, TILE, "id", "side", "copies")))
    return run


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, window: int = WINDOW,
                 miss: float = MISS, seed: int = 3) -> DataFrame:
    """(key, n_links, component_id, kept) of every row by cosine >= threshold, in double precision.

    Vectors that are null, empty, zero or hold a null or a non-finite number link with
    nothing, nor do vectors of different lengths or null keys (their component is
    null).  Rows of one key count as one vector (the smallest of them) and all get its
    result.  Other columns are not looked at; no rows give no rows.
    """
    spark = rows.sparkSession
    every = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = every.where("id is not null and v is not null and size(v) > 0").where(F.forall("v", finite))
    sound = sound.withColumn("square", square).where((F.col("square") > 0) & (F.col("square") < F.lit(float("inf"))))
    unit = sound.select("id", F.size("v").alias("width"), "v")
    unit = materialise(unit.groupBy("id").agg(F.min(F.struct("width", "v")).alias("u")).select("id", "u.*"))
    one = materialise(unit.groupBy("width", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "width", "v", "copies"))
    equal = one.where("copies > 1").select("v", F.col("id").alias("first"))
    copies = materialise(unit.join(equal, "v").where("id != first").select("id", "first"))
    n, widest = one.agg(F.count(F.lit(1)), F.coalesce(F.max("width"), F.lit(1))).first()
    passes, signs = passes_needed(n, threshold, window, miss), signs_needed(n, window)
    # all passes together never compare more than every two vectors once
    crowd = max(CROWD, window, min(n // passes, HELD // widest))
    length = max(2 * crowd, min(CHUNK, ROOM // widest))
    ordered = global_rank(one.mapInArrow(_keyed(passes, seed), "pass int, width int, run bigint, more bigint, id bigint"), ["pass", "width", "run", "id"], "at")
    chunk, inside = F.expr(f"(at - 1) div {length}"), F.expr(f"(at - 1) % {length}")
    placed = ordered.withColumn("chunk", F.explode(F.when((inside < crowd) & (chunk > 0), F.array(chunk - 1, chunk)).otherwise(F.array(chunk))))
    place = ["chunk", "pass", "width"]
    chunks = placed.repartition(partitions(spark), "chunk").sortWithinPartitions(*place, "at")
    near = materialise(chunks.mapInArrow(_candidates(signs, window, crowd, threshold), "chunk bigint, pass int, width int, at bigint, id bigint, lead bigint"))
    met = near.where("id is not null").select(*place, "at", "id").join(one.select("id", "v"), "id")
    edges = met.repartition(partitions(spark), "chunk").sortWithinPartitions(*place, "at").mapInArrow(_chunk_edges(threshold, crowd), "a bigint, b bigint")
    large = near.where("id is null").select("pass", "width", "lead").distinct()
    if not large.isEmpty():
        runs = ordered.withColumn("lead", F.shiftright("run", SIGNS - signs))
        dense = materialise(runs.join(large, ["pass", "width", "lead"], "left_semi").select(F.col("width").alias("component"), "id").distinct())
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) * F.col("component") / HELD), F.least(F.lit(8), F.ceil(F.count(F.lit(1)) / BLOCK)))
        dense = dense.join(dense.groupBy("component").agg(blocks.cast("int").alias("blocks")), "component")
        edges = edges.unionByName(_tiles(dense, one).mapInArrow(_tile_edges(threshold), "a bigint, b bigint"))
    found = materialise(connected_components(edges.distinct()))
    sizes = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    links = _tiles(found.join(sizes, "component"), one).mapInArrow(_counted(threshold), "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))
    known = one.select("id", "copies").join(found, "id", "left").join(links, "id", "left").where("component is not null or copies > 1")
    known = materialise(known.select("id", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    again = copies.join(known.withColumnRenamed("id", "first"), "first").select("id", "component", "n_links")
    known = known.unionByName(again).withColumnRenamed("id", "member")
    out = every.select("id").join(known, F.col("id") == F.col("member"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
