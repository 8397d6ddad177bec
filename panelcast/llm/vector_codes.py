"""Vector codes from Hilbert-sorted flat blocks with boxes and sums, exact in whole numbers.

Vectors are scaled, floored to whole numbers and cut into equal parts; each part has a
codebook that a few rounds of nearest-entry assignment and floored means refine.  The
table is laid out once: a task takes chunks of vectors, sorts each part of a chunk along
a Hilbert curve, and stores it as flat blocks of 32 neighbours, each with the smallest
and largest value of every component (its box) and their sums.  A round reads these
chunks.  The least distance of an entry to a box and the greatest of the nearest entry
leave a shortlist per block; a block with one entry left adds its stored sums without
its vectors being looked at, and the others are compared with the entries of their
shortlist only.  What leaves a task are sums per entry, so a round moves a few thousand
numbers whatever the size of the table; a codebook is a few thousand numbers as well.

Everything is whole numbers, so sums do not depend on the order of their terms: results
are the same however rows are dealt over tasks.  Sums of large numbers travel as limbs of
30 bits.  Chunks are a written table: a lost executor costs its tasks, not the layout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 8, 16, 6, 4096, 32
#: Components that a chunk holds.
HELD = 1 << 20
LIMB = 30


def narrow(length: int) -> int:
    """Below this size of components, squared distances of parts of so many components fit 64 bits."""
    return math.isqrt((1 << 61) // length)


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of each point (n, d) on a Hilbert curve over the points' own box, by Skilling's transform of the axes."""
    n, d = points.shape
    d = min(d, 62)
    bits = max(1, min(16, 62 // d))
    low, high = points[:, :d].min(0), points[:, :d].max(0)
    span = np.where(high > low, high - low, 1)
    x = ((points[:, :d] - low) / span * ((1 << bits) - 1)).astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            on, t = (x[i] & q) != 0, (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(on, q - 1, t)
            x[i] ^= np.where(on, 0, t)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros(n, np.int64), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    keys = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            keys = (keys << 1) | ((x[i] >> bit) & 1)
    return keys


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers held in doubles, exact for a scale that is a power of two."""
    return np.floor(values.astype(np.float64) * scale)


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles that hold whole numbers as integers: 64 bits where distances fit, else of any size."""
    if not values.size or np.abs(values).max() < narrow(values.shape[-1]):
        return values.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(values)


def cut(values: np.ndarray, parts: int) -> np.ndarray:
    """(n, width) -> (parts, n, length); parts that the width does not fill end in zeros."""
    n, width = values.shape
    length = -(-width // parts)
    full = np.zeros((n, parts * length))
    full[:, :width] = values
    return full.reshape(n, parts, length).transpose(1, 0, 2)


def _chunks(width: int, parts: int, scale: int, names: Sequence[str], types: Sequence[pa.DataType]):
    """Rows (id, label, v) -> chunks: identities in order of arrival, and per part the sorted values, their order, boxes and sums."""
    many = max(LEAF, HELD // width)

    def laid(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole_table = pa.Table.from_batches(batches).combine_chunks()
        given = whole_table.column("v").combine_chunks()
        data = cut(scaled(given.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale), parts)
        n = data.shape[1]
        starts = np.arange(0, n, LEAF)
        order = np.stack([np.argsort(hilbert_keys(p), kind="stable") for p in data]).astype(np.int32)
        data = np.stack([p[o] for p, o in zip(data, order, strict=True)])
        low, high = np.minimum.reduceat(data, starts, axis=1), np.maximum.reduceat(data, starts, axis=1)
        peak = np.abs(data).max(initial=0)
        kind = "i2" if peak < 1 << 15 else "i4" if peak < min(1 << 31, narrow(data.shape[2])) else "f8"
        blobs = [order.tobytes(), data.astype(kind).tobytes(), low.astype(kind).tobytes(), high.astype(kind).tobytes()]
        sums = b"" if kind == "f8" else np.add.reduceat(data.astype(np.int64), starts, axis=1).tobytes()
        identities = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), whole_table.column(c).combine_chunks().cast(t)) for c, t in zip(("id", "label"), types, strict=True)]
        return pa.record_batch([*identities, pa.array([n], pa.int32()), pa.array([kind]), *(pa.array([b], pa.binary()) for b in (*blobs, sums))], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, many - rows)
                held.append(piece)
                rows, at = rows + piece.num_rows, at + piece.num_rows
                if rows == many:
                    yield laid(held)
                    held, rows = [], 0
        if rows:
            yield laid(held)
    return run


class Chunk:
    """One row of the chunk table."""

    def __init__(self, row: dict, parts: int, length: int):
        self.n, kind = row["n"], row["kind"]
        shape = (parts, -1, length)
        numbers = lambda name: whole(np.frombuffer(row[name], kind).reshape(shape).astype(np.float64))
        self.order = np.frombuffer(row["orders"], np.int32).reshape(parts, -1)
        self.data, self.low, self.high = numbers("data"), numbers("low"), numbers("high")
        self.starts = np.arange(0, self.n, LEAF)
        self.sums = np.add.reduceat(self.data, self.starts, axis=1) if kind == "f8" else np.frombuffer(row["sums"], np.int64).reshape(shape)
        self.sizes = np.diff(np.append(self.starts, self.n))


def fitting(chunk: Chunk, entries: np.ndarray) -> np.ndarray:
    """Entries as 64-bit numbers if they and the chunk are small enough, else of any size."""
    small = chunk.data.dtype != object and max(abs(v) for v in entries.ravel()) < narrow(entries.shape[1])
    return entries.astype(np.int64) if small else entries


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether an entry can be nearest to a vector of the block; distances in whole numbers."""
    below, above = low[:, None, :] - entries[None], entries[None] - high[:, None, :]
    outside = np.maximum(np.maximum(below, above), 0)
    least = (outside * outside).sum(-1)
    far = np.maximum(np.abs(below), np.abs(above))
    return least <= (far * far).sum(-1).min(1)[:, None]


def nearest(chunk: Chunk, part: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the entry of each vector, whether its block had one entry left); equal distances go to the lower index."""
    listed = shortlists(chunk.low[part], chunk.high[part], entries)
    single = listed.sum(1) == 1
    chosen = np.repeat(listed.argmax(1), chunk.sizes)
    if not single.all():
        rows = np.flatnonzero(np.repeat(~single, chunk.sizes))
        among = np.repeat(listed, chunk.sizes, axis=0)[rows]
        values, at = chunk.data[part][rows], np.zeros(len(rows), np.int64)
        best = np.full(len(rows), -1, entries.dtype)
        for e in range(len(entries)):
            on = np.flatnonzero(among[:, e])
            gap = values[on] - entries[e]
            far = (gap * gap).sum(1)
            better = (best[on] < 0) | (far < best[on])
            best[on[better]], at[on[better]] = far[better], e
        chosen[rows] = at
    return chosen, single


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from batch.to_pylist()


TOTALS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def _totals(books: list[np.ndarray], length: int):
    """Chunks -> sums and counts (position -1) per entry, one set for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        for row in _rows(batches):
            chunk = Chunk(row, len(books), length)
            for part, entries in enumerate(fitting(chunk, b) for b in books):
                chosen, single = nearest(chunk, part, entries)
                of_block, loose = chosen[chunk.starts], np.repeat(~single, chunk.sizes)
                for e in range(len(entries)):
                    blocks, vectors = single & (of_block == e), loose & (chosen == e)
                    many = int(chunk.sizes[blocks].sum()) + int(vectors.sum())
                    if many:
                        total = chunk.sums[part][blocks].sum(0) + chunk.data[part][vectors].sum(0)
                        held = sums.setdefault((part, e), [0] * (length + 1))
                        sums[part, e] = [a + int(b) for a, b in zip(held, [many, *total], strict=True)]
        out = []
        for (part, e), values in sums.items():
            for position, value in enumerate(values, -1):
                limb, sign, size = 0, -1 if value < 0 else 1, abs(value)
                while size:
                    out.append((part, e, position, limb, sign * (size & ((1 << LIMB) - 1))))
                    size, limb = size >> LIMB, limb + 1
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TOTALS.types, strict=True)], names=TOTALS.names)
    return run


def refined(chunks: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """One round: every entry becomes the floored mean of its parts; entries that nothing is nearest to stay."""
    totals = chunks.mapInArrow(_totals(books, length), "part int, entry int, position int, limb int, value bigint")
    totals = totals.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value"))
    sums: dict[tuple[int, int, int], int] = {}
    for r in totals.collect():  # one row per number of the codebooks and limb
        at = (r.part, r.entry, r.position)
        sums[at] = sums.get(at, 0) + (r.value << (LIMB * r.limb))
    out = [b.copy() for b in books]
    for part, entries in enumerate(out):
        for e in range(len(entries)):
            count = sums.get((part, e, -1), 0)
            if count:
                entries[e] = [sums.get((part, e, p), 0) // count for p in range(length)]
    return out


def _coded(books: list[np.ndarray], length: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, len(books), length)
            fitted = [fitting(chunk, b) for b in books]
            codes, errors = np.zeros((chunk.n, len(books)), np.uint8), np.zeros(chunk.n, np.result_type(*fitted))
            for part, entries in enumerate(fitted):
                chosen, _ = nearest(chunk, part, entries)
                gap = chunk.data[part] - entries[chosen]
                codes[chunk.order[part], part] = chosen
                errors[chunk.order[part]] += (gap * gap).sum(1)
            text = codes.tobytes().hex()
            step = 2 * len(books)
            fits = [int(e) if int(e) < 1 << 63 else None for e in errors]
            yield pa.record_batch([pa.array(row["ids"], schema.types[0]), pa.array(row["labels"], schema.types[1]),
                                   pa.array([text[i:i + step] for i in range(0, len(text), step)]), pa.array(fits, pa.int64())], names=schema.names)
    return run


def _sound(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def books_digest(books: list[np.ndarray], width: int) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas; zeros that only fill up a part are left out."""
    length = books[0].shape[1]
    numbers = [str(int(v)) for part, entries in enumerate(books) for entry in entries for p, v in enumerate(entry) if part * length + p < width]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray], int]:
    """(chunk table, codebook of each part, width); no chunks, no codebooks and width 0 if no row is left."""
    sound = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(_sound(F.col("v")))
    first = sound.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(1).collect()
    width = len(first[0].v) if first else 0
    sound = sound.where(F.size("v") == width)
    ends = sound.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    kinds = dict(sound.dtypes)
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, n int, kind string, orders binary, data binary, low binary, high binary, sums binary"
    names = ("ids", "labels", "n", "kind", "orders", "data", "low", "high", "sums")
    arrow = sound.limit(0).toArrow().schema
    chunks = materialise(sound.mapInArrow(_chunks(max(width, 1), parts, scale, names, [arrow.field("id").type, arrow.field("label").type]), schema))
    if not ends:
        return chunks, [], 0
    start = cut(scaled(np.array([r.v for r in ends], dtype=np.float64), scale), parts)
    books = [np.frompyfunc(int, 1, 1)(p) for p in start]
    for _ in range(rounds):
        books = refined(chunks, books, start.shape[2])
    return chunks, books, width


def coded_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                  rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row with a sound vector.

    Rows whose vector is null, empty or holds a null or a non-finite number are dropped,
    and so are vectors of another width than the smallest key's.  Codebooks start from
    the smallest keys (null keys last, equal keys by their vectors), fewer than
    ``entries`` if there are fewer rows.  A width that is no multiple of ``parts`` leaves
    the last parts shorter.  Errors beyond 64 bits are null, as is their label's sum.
    Repeated rows each count.  Other columns are not looked at; no rows give no rows.
    """
    chunks, books, width = fit(rows, key, vector, label, parts, entries, rounds, scale)
    kinds = dict(chunks.dtypes)
    kind, label_kind = kinds["ids"][6:-1], kinds["labels"][6:-1]
    arrow = chunks.limit(0).toArrow().schema
    schema = pa.schema([("id", arrow.field("ids").type.value_type), ("label", arrow.field("labels").type.value_type), ("code", pa.string()), ("error", pa.int64())])
    length = books[0].shape[1] if books else 1
    coded = materialise(chunks.mapInArrow(_coded(books, length, schema), f"id {kind}, label {label_kind}, code string, error bigint"))
    total = F.when(F.count(F.lit(1)) == F.count("error"), F.try_sum("error"))
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(books_digest(books, width) if books else None).cast("string").alias("codebooks_sha256"))
