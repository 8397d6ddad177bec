"""MinHash near-duplicates: one permutation, optimal densification, banded buckets, star edges.

A document is the set of its distinct word shingles, hashed to 64 bits.  One hash of
every shingle serves all minima: its leading bits choose a bin, and each bin keeps its
smallest.  An empty bin takes the value of a full one that a fixed sequence of probes
meets first, which makes two sets agree in a bin with the probability of their
likeness.  Bands of bins are bucket keys.

Sets that are equal are one node from the start, however many documents share them.
In a bucket only edges to its smallest member are proposed (rows, not pairs), which
connects a group of copies at once.  What then lies in another class than its centre
is compared with the whole bucket if the bucket is small, and by further stars among
such members if it is large.  Stars that connect a large bucket leave one class that
holds most of it; the members outside are compared with all others of the bucket, as
matrix products over the shingles of both, but for those that a bound on their likeness
rules out.  So every two members of a bucket
end in one class, are compared or cannot be linked, without all pairs of a group.
Every proposed edge is confirmed on full sets.  A pair shares about ten buckets at a
likeness of 0.8 and is lost only if it shares none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ..session import materialise
from .common import connected_components

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: With 5 rows and 32 bands a pair of likeness 0.8 shares no bucket with probability 3e-6.
PROBES = 4096
#: Buckets of at most so many members are compared in full across classes at once; larger ones after so many further stars.
SMALL, STARS = 32, 3
#: Shingles of members of a large bucket that one task compares with those outside the bucket's greatest class.
PART = 1 << 19
#: Members outside and columns of a matrix that are compared at a time.
OUTER, COLUMNS = 256, 4096
#: How often members that can have no link are looked for before the others are compared.
ROUNDS = 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that looks random (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of UTF-8 text; only A-Z are lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    size = min(k, n)
    acc = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + w[j:n - size + 1 + j]
    return np.unique(mixed(acc))


def _probes() -> np.ndarray:
    """The bins that each empty bin looks at, in order."""
    at = np.arange(PROBES, dtype=np.uint64)[None, :] + np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(PROBES)
    return (mixed(at + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


PROBED = _probes()


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of the bins of a non-empty sorted set, densified."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    full, first = np.unique(bins.astype(np.int64), return_index=True)  # sorted: the first of a bin is its minimum
    out = np.zeros(BINS, np.uint64)
    out[full] = hashes[first]
    if len(full) < BINS:
        has = np.zeros(BINS, bool)
        has[full] = True
        empty = np.flatnonzero(~has)
        hit = has[PROBED[empty]]
        found = PROBED[empty, hit.argmax(1)]
        found[~hit.any(1)] = full[0]
        out[empty] = out[found]
    return out


SALT = mixed(np.arange(1, BINS + 1, dtype=np.uint64)).reshape(BANDS, ROWS)


def bands(sig: np.ndarray) -> np.ndarray:
    """One bucket key per band (the band is mixed into the key)."""
    acc = SALT[:, 0].copy()
    for r, column in enumerate(sig.reshape(BANDS, ROWS).T):
        acc = mixed(acc ^ (column * (SALT[:, r] | np.uint64(1))))
    return acc


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, d1, d2, keys, offsets = [], [], [], [], [], [0]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py() or b"", k)
                digest = np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64)
                ids.append(key)
                n.append(len(s))
                d1.append(digest[0])
                d2.append(digest[1])
                if len(s):
                    keys.append(bands(signature(s)).view(np.int64))
                offsets.append(offsets[-1] + BANDS * bool(len(s)))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                                   pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["id", "n", "d1", "d2", "keys"])
    return run


def _confirmed(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, of = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            out_a, out_b, ok = [], [], []
            for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                if x != centre:
                    centre, of = x, shingles(ta[i].as_py() or b"", k)
                s = shingles(tb[i].as_py() or b"", k)
                both = len(np.intersect1d(of, s, assume_unique=True))
                out_a.append(x)
                out_b.append(y)
                ok.append(100 * both >= percent * (len(of) + len(s) - both) and both > 0)
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])
    return run


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int, share: int = 256) -> DataFrame:
    """(a, b, ok) of distinct pairs (a: centre).  A centre's text is sent once for each ``share`` of its partners."""
    pairs = materialise(pairs)
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("fan"))
    left = fans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).join(texts.withColumnRenamed("id", "a"), "a")
    right = (pairs.join(fans, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int")).drop("fan")
             .join(texts.select(F.col("id").alias("b"), F.col("text").alias("other")), "b"))
    joined = left.select("a", "salt", "text").join(right, ["a", "salt"]).select("a", "b", "text", "other")
    return joined.mapInArrow(_confirmed(k, percent), "a bigint, b bigint, ok boolean")


def _alike(met: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of centres and members whose sizes allow a link."""
    near = met.where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    return near.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def _hashed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingles(text.as_py() or b"", k).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(h), key)), pa.array(h)], names=["id", "h"])
    return run


def _lonely(ids: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(id, lone): how many shingles of a text are in no text of another class; ``ids`` has (id, c), ids without any are absent."""
    hashed = materialise(texts.join(ids.select("id"), "id").select("id", "text").mapInArrow(_hashed(k), "id bigint, h bigint").join(ids, "id"))
    own = hashed.groupBy("h").agg(F.min("c").alias("c"), F.max("c").alias("most")).where("c = most").select("h")
    return hashed.join(own, "h").groupBy("id").agg(F.count(F.lit(1)).alias("lone"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) sizes of the intersections of sets of hashes, as products of 0/1 matrices over the hashes that occur on both sides."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate([*side, np.zeros(0, np.int64)]) for side in (left, right)]
    both = np.intersect1d(*flat)
    owner = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    at = [np.minimum(np.searchsorted(both, f), max(len(both) - 1, 0)) for f in flat]
    hit = [both[p] == f if len(both) else np.zeros(len(f), bool) for p, f in zip(at, flat, strict=True)]
    for start in range(0, len(both), COLUMNS):
        sides = []
        for side in (0, 1):
            some = hit[side] & (at[side] >= start) & (at[side] < start + COLUMNS)
            m = np.zeros((len((left, right)[side]), min(COLUMNS, len(both) - start)), np.float32)
            m[owner[side][some], at[side][some] - start] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _meetings(percent: int):
    """Parts of buckets, inner members before those outside the greatest class -> links across classes, one for each outer member and class."""
    def done(inner, outer):
        inter = shared_counts([r["hashes"] for r in inner], [r["hashes"] for r in outer])
        sizes = [np.array([len(r["hashes"]) for r in side]) for side in (inner, outer)]
        ok = 100 * inter >= percent * (sizes[0][:, None] + sizes[1][None, :] - inter)
        c = [np.array([r["c"] for r in side]) for side in (inner, outer)]
        ok &= (inter > 0) & (c[0][:, None] != c[1][None, :])
        i, j = np.nonzero(ok)
        _, first = np.unique(np.stack([c[0][i], j]), axis=1, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
        ids = [np.array([r["id"] for r in side], np.int64) for side in (inner, outer)]
        x, y = ids[0][i[first]], ids[1][j[first]]
        return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inner, outer = None, [], []
        for batch in batches:
            lists = batch.column("hashes")
            flat, stops = np.asarray(lists.values), np.asarray(lists.offsets)
            for i, row in enumerate(batch.select(["bucket", "part", "side", "id", "c"]).to_pylist()):
                if (key := (row["bucket"], row["part"])) != now:
                    if outer:
                        yield done(inner, outer)
                    now, inner, outer = key, [], []
                row["hashes"] = flat[stops[i]:stops[i + 1]]
                (outer if row["side"] else inner).append(row)
                if len(outer) == OUTER:
                    yield done(inner, outer)
                    outer = []
        if outer:
            yield done(inner, outer)
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                found = [shingles(t.as_py() or b"", k).view(np.int64) for t in some.column(1)]
                stops = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.record_batch([some.column(0), pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))], names=["id", "hashes"])
    return run


def _across(large: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between members of a bucket outside its greatest class and its members of other classes, confirmed on full sets.

    A shingle that only one class holds is in no intersection across classes.  With s
    shared and u lone shingles a likeness is at most min(s, s') / (max(s, s') + u + u'),
    so members with too many of their own meet no one, and what only they share becomes
    lone in the next round; nothing that could be a link is left out.  A bucket is cut
    by a hash of its members into parts of about ``PART`` shingles, each of which meets
    the members outside in a task of its own, where intersections are matrix products
    over the shingles of both sides: no pair becomes a row but a link, and of links of a
    member to one class a single one.
    """
    now = classes.select(F.col("id").alias("member"), F.col("component").alias("now"))
    several = materialise(large.join(now, F.col("id") == F.col("member"), "left").select("bucket", "id", "n", F.coalesce("now", "id").alias("c")))
    for _ in range(ROUNDS):
        shown = several.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("bucket")
        several = materialise(several.select("bucket", "id", "n", "c").join(shown, "bucket"))
        if several.isEmpty():  # every large bucket is one class
            return several.select(F.col("id").alias("a"), F.col("id").alias("b"))
        lone = _lonely(several.select("id", "c").distinct(), texts, k)
        several = materialise(several.join(lone, "id", "left").withColumn("u", F.coalesce("lone", F.lit(0))).withColumn("s", F.col("n") - F.col("u")).drop("lone"))
        least = several.groupBy("bucket").agg(F.min("u").alias("least"))
        several = materialise(several.join(least, "bucket").where(f"100 * s >= {percent} * (s + u + least)").drop("least"))
    sizes = several.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("held"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("size", "c")).alias("t"), F.sum("held").alias("held"))
    several = several.join(top.select("bucket", F.col("t.c").alias("top"), F.ceil(F.col("held") / PART).cast("int").alias("parts")), "bucket")
    several = materialise(several.select("bucket", "id", "c", "top", "parts"))
    sets = materialise(texts.join(several.select("id").distinct(), "id").select("id", "text").mapInArrow(_sets(k), "id bigint, hashes array<bigint>"))
    outside = several.where("c != top").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "c")
    inside = several.select("bucket", F.pmod(F.xxhash64("id", "bucket"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "c")
    met = inside.unionByName(outside).join(sets, "id").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "side")
    return materialise(met.mapInArrow(_meetings(percent), "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept): classes of documents that links of likeness >= percent/100 connect.

    Links are between sets of distinct ``k``-word shingles (a shorter text is one
    shingle); null, empty and blank texts have none and stand alone.  Rows of one key
    are one document each with the same key: their class is that of the key, and all
    of them are ``kept`` if it is its class's smallest.  Null keys stand alone with a
    null component.  Other columns are not looked at; no rows give no rows.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    signed = materialise(rows.mapInArrow(_signed(k), "id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>"))
    live = signed.where("n > 0 and id is not null")
    reps = materialise(live.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    copies = live.join(reps.select("d1", "d2", F.col("id").alias("rep")), ["d1", "d2"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    every = reps.select("id", "n", F.explode("keys").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("bucket")
    shelved = materialise(every.join(shared, "bucket"))
    texts = materialise(rows.join(shelved.select("id").distinct(), "id"))
    # first every bucket's smallest member is the centre of a star over the others
    centre = shelved.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("c")).select("bucket", F.col("c.id").alias("a"), F.col("c.n").alias("m"))
    met = shelved.join(centre, "bucket").where("id != a")
    tried = materialise(confirm(_alike(met, percent), texts, k, percent))
    # what one star has connected need not be compared again; members outside their centre's class become centres themselves
    classes = connected_components(tried.where("ok")).select(F.col("id").alias("member"), "component")
    shelved = materialise(shelved.join(classes, F.col("id") == F.col("member"), "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("c")))
    first = shelved.groupBy("bucket").agg(F.min(F.struct("id", "c")).alias("f"), F.count(F.lit(1)).alias("many")).select("bucket", "many", F.col("f.c").alias("fc"))
    shelved = materialise(shelved.join(first, "bucket"))
    rest = materialise(shelved.where("c != fc").drop("fc"))
    # small buckets: all their members against those of other classes
    centre = rest.where(F.col("many") <= SMALL).select("bucket", F.col("id").alias("a"), F.col("n").alias("m"), F.col("c").alias("d"))
    pairs = _alike(shelved.join(centre, "bucket").where("c != d"), percent).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    tried = materialise(tried.unionByName(confirm(pairs, texts, k, percent)))
    # large ones: stars over the members that are still without a like centre
    rest = rest.where(F.col("many") > SMALL).drop("many")
    for _ in range(STARS):
        if rest.isEmpty():
            break
        # another one in every bucket, so that two sets meet more centres the more buckets they share
        centre = rest.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", "bucket"), "id", "n", "c")).alias("f")).select("bucket", F.col("f.id").alias("a"), F.col("f.n").alias("m"), F.col("f.c").alias("d"))
        met = materialise(rest.join(centre, "bucket").where("id != a"))
        pairs = _alike(met.where("c != d"), percent).join(tried.select("a", "b"), ["a", "b"], "left_anti")
        tried = materialise(tried.unionByName(confirm(pairs, texts, k, percent)))
        like = tried.where("ok").select("a", F.col("b").alias("id"))
        rest = materialise(met.where("c != d").join(like, ["a", "id"], "left_anti").select("bucket", "id", "n", "c"))
    # what the stars leave: in every large bucket, members outside its greatest class against those of other classes
    more = _across(shelved.where(F.col("many") > SMALL), connected_components(tried.where("ok")), texts, k, percent)
    found = connected_components(copies.unionByName(tried.where("ok").select("a", "b")).unionByName(more))
    out = signed.join(found.withColumnRenamed("id", "member"), F.col("id") == F.col("member"), "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
                      F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))
