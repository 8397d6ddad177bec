"""Removal of byte strings that an earlier document has, by longest-previous-factor arrays.

A window (a string of ``size`` bytes) is removed if it also starts in a document with a
smaller key.  Equal windows have the same smallest hash among the grams inside them, so
this hash, the window's mark, decides which windows have to meet.  Consecutive windows
with one mark form a stretch, one for about fourteen bytes.

1.  Stretches with equal bytes are reduced to the smallest key, first among the texts that
    a task holds at a time, then across tasks in buckets of marks.  Stretches of later
    documents are removed as a whole: this settles copies of documents and the inside of
    common passages, however often they occur.
2.  What is left of a mark are different stretches that may share windows (the borders of
    common passages, the surroundings of edits).  Only where two documents share a mark,
    these stretches become a suffix array: the suffixes are put in order, eight bytes at a time, and
    the previous and the next entry of this order that belong to a smaller key give the
    longest earlier match of each; a match of ``size`` bytes removes the window.

Neither step holds a group that grows with the table.  A passage in a third of all
documents is one stretch for each slice of texts after the first reduction; a mark with many
different stretches in one slice is dealt by content, and two rows of it stay behind to
keep the mark known.  In the second step a mark with more than a few megabytes of
stretches is dealt over several arrays, and the windows that none of them removes
meet in the order of their bytes.  Texts longer than a few megabytes are worked on piece
by piece (pieces overlap by a window, and what a border cuts is settled by the second
step).  Hashes of 96 bits (mark and content) stand for equal stretches; windows of the
second step are compared by their bytes.  Texts travel compressed, and stretches as
packed columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import materialise
from .common import partitions

SIZE = 50
#: Stretches of one mark that a slice may hold before they are dealt by content.
CROWD = 16
#: Stretches that a bucket is meant to hold, and bytes of stretches that one suffix array takes.
BUCKET, ARRAY = 1 << 19, 1 << 21
LOW = np.uint64((1 << 48) - 1)
#: Bytes of text that a task works on at a time.
SLICE = 1 << 21
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def gram_of(size: int) -> int:
    """Bytes of the grams that mark windows of this size."""
    if size < 25:
        raise ValueError("windows of fewer than 25 bytes are not supported")
    return 12 * size // 25


def _words(text: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes at every place of a padded text as one number."""
    return np.ndarray((len(text) - 7,), kind, text, strides=(1,))


def marks(text: np.ndarray, size: int) -> np.ndarray:
    """Smallest hash of the grams inside each window of the text."""
    gram, n = gram_of(size), len(text)
    words = _words(text, "<u8")
    count = n - gram + 1
    value = np.zeros(count, np.uint64)
    for turn, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        value += words[at:at + count]
        value *= np.uint64(ODD[turn % 3])
        value ^= value >> np.uint64(32 - turn % 3)
    value *= np.uint64(ODD[1])
    value ^= value >> np.uint64(29)
    wide, reach = size - gram + 1, 1
    while 2 * reach <= wide:
        value = np.minimum(value[:len(value) - reach], value[reach:])
        reach *= 2
    left = wide - reach
    return np.minimum(value[:len(value) - left], value[left:]) if left else value


def _joined(lengths: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Places of all windows of texts that lie at ``starts`` in one buffer."""
    many = np.maximum(lengths - size + 1, 0)
    return np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())


def _pieces(batches: Iterator[pa.RecordBatch], size: int):
    """Slices of texts: lists of (key, part, offset of the piece, bytes)."""
    held, total = [], 0
    for batch in batches:
        for doc, part, text in zip(batch.column("doc").to_pylist(), batch.column("part").to_pylist(), batch.column("bytes"), strict=True):
            data = memoryview(text.as_buffer())
            for at in range(0, max(len(data) - size + 1, 1), SLICE):
                piece = data[at:at + SLICE + size - 1]
                held.append((doc, part, at, piece))
                total += len(piece)
                if total >= SLICE:
                    yield held
                    held, total = [], 0
    if held:
        yield held


def _spans(doc, part, pos, length):
    """Joins spans of windows that follow each other: (first row of each joined span, its end)."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = pos + length
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (pos[1:] > end[:-1]) | (pos[1:] < pos[:-1])
    first = np.flatnonzero(new)
    return first, np.maximum.reduceat(end, first)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, all first bytes before all second ones."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


#: Bytes of a stretch's columns after mark and content: key, part, place and length.
TAIL = (8, 8, 5, 4)


def packed(mark: np.ndarray, content: np.ndarray, *tail: np.ndarray) -> bytes:
    """Columns of stretches in the order of their marks: steps between marks, contents, and the rest, which compresses well."""
    n = len(mark)
    steps = _planes(np.diff(mark, prepend=np.uint64(0)), 6)
    tail = (tail[0] - tail[0].min(), *tail[1:])
    rest = pa.compress(steps[4 * n:] + b"".join(_planes(c.view(np.uint64), w) for c, w in zip(tail, TAIL, strict=True)), codec="zstd", asbytes=True)
    return steps[:4 * n] + _planes(content, 6) + rest


def unpacked(blob: memoryview, n: int, least: int) -> list[np.ndarray]:
    """mark, content, key, part, place, length."""
    rest = memoryview(pa.decompress(blob[10 * n:], (2 + sum(TAIL)) * n, codec="zstd", asbytes=True))
    mark = np.cumsum(_numbers(bytes(blob[:4 * n]) + bytes(rest[:2 * n]), n, 6), dtype=np.uint64)
    out, at = [mark, _numbers(blob[4 * n:10 * n], n, 6)], 2 * n
    for width in TAIL:
        out.append(_numbers(rest[at:at + width * n], n, width).view(np.int64))
        at += width * n
    out[2] = out[2] + least
    return out


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, length) of each run of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _first_keys(mark: np.ndarray, content: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by mark, content and key; smallest key of the same mark and content, in that order)."""
    order = np.lexsort((doc, content, mark))
    first, many = _runs(mark[order], content[order])
    return order, np.repeat(doc[order][first], many)


BLOBS = ("bucket", "n", "least", "blob")
SETTLED = ("doc", "part", "pos", "len", "mark")


def _stretches(size: int, buckets: int):
    """Texts -> packed stretches by bucket of marks, without those that a slice's smaller key has too; these are spans (bucket -1)."""
    def blobs(bucket, columns):
        order = np.lexsort((columns[0], bucket))
        columns, bucket = [c[order] for c in columns], bucket[order]
        first, many = _runs(bucket)
        cut = [[c[a:a + n] for c in columns] for a, n in zip(first, many, strict=True)]
        return pa.record_batch([pa.array(bucket[first]), pa.array(many.astype(np.int32)), pa.array([int(c[2].min()) for c in cut], pa.int64()),
                                pa.array([packed(*c) for c in cut], pa.binary())], names=BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _pieces(batches, size):
            lengths = np.array([len(p[3]) for p in held])
            starts = np.cumsum(lengths) - lengths
            text = np.frombuffer(b"".join([*(p[3] for p in held), b"\0" * 8]), np.uint8)
            places = _joined(lengths, starts, size)
            if not len(places):
                continue
            value = marks(text, size)[places]
            first, many = _runs(value, places - np.arange(len(places)))
            at, length, mark = places[first], many + size - 1, value[first] & LOW
            whole = memoryview(text)
            content = np.array([xxh3_64_intdigest(whole[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)], np.uint64) & LOW
            own = np.searchsorted(starts, at, side="right") - 1
            doc, part, base = (np.array([p[i] for p in held], np.int64)[own] for i in range(3))
            pos = at - starts[own] + base
            order, smallest = _first_keys(mark, content, doc)
            lost = np.zeros(len(order), bool)
            lost[order] = doc[order] > smallest
            heads, end = _spans(*(c[lost] for c in (doc, part, pos, length)))
            gone = np.flatnonzero(lost)[heads]
            zero = np.zeros(len(gone), np.uint64)
            if len(gone):
                yield blobs(np.full(len(gone), -1 - int(mark[0] % np.uint64(buckets)), np.int64), [zero, zero, doc[gone], part[gone], pos[gone], end - pos[gone]])
            order = order[~lost[order]]
            columns = [c[order] for c in (mark, content, doc, part, pos, length)]
            bucket = (((columns[0] >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            first, many = _runs(columns[0])
            crowded = np.repeat(many > CROWD, many)
            if crowded.any():  # dealt by content; the smallest and the greatest key stay behind with length 0
                low, high = np.minimum.reduceat(columns[2], first), np.maximum.reduceat(columns[2], first)
                for key in (low, high):
                    some = first[many > CROWD]
                    kept = [columns[0][some], columns[1][some], key[many > CROWD], *(np.zeros(len(some), np.int64) for _ in range(3))]
                    columns, crowded = [np.concatenate(c) for c in zip(columns, kept, strict=True)], np.append(crowded, np.zeros(len(some), bool))
                    bucket = np.append(bucket, bucket[some])
                bucket[crowded] = buckets + (((columns[0] ^ columns[1]) * np.uint64(ODD[0]) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)[crowded]
            yield blobs(bucket, columns)
    return run


def settle(columns: list[np.ndarray], crowded: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(removed spans, open stretches with their marks) of all stretches of a bucket."""
    order, smallest = _first_keys(*columns[:3])
    mark, _, doc, part, pos, length = (c[order] for c in columns)
    # a key that stays behind for a crowded mark counts for the mark, not for its content
    real = length > 0
    lost = real & (doc > smallest)
    if not real.all():
        again, least = _first_keys(mark[real], columns[1][order][real], doc[real])
        at = np.flatnonzero(real)[again]
        lost[at] = doc[at] > least
    left = ~lost
    first, many = _runs(mark[left])
    keys = doc[left]
    shared = np.repeat(crowded | (np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first)), many) if len(first) else np.zeros(0, bool)
    still = np.flatnonzero(left)[shared & real[left]]
    return [c[lost] for c in (doc, part, pos, length)], [c[still] for c in (doc, part, pos, length, mark)]


def _settled(buckets: int):
    """Packed stretches, bucket after bucket -> removed spans (without a mark) and open stretches."""
    def rows(lost, still):
        for columns, mark in ((lost, None), (still[:4], still[4] if still else None)):
            if columns and len(columns[0]):
                last = pa.nulls(len(columns[0]), pa.int64()) if mark is None else pa.array(mark.astype(np.int64))
                yield pa.record_batch([*map(pa.array, columns), last], names=SETTLED)

    def done(bucket, held):
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield from rows(*(settle(columns, bucket >= buckets) if bucket >= 0 else (columns[2:], [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, n, least, blob in zip(*(batch.column(c).to_pylist() for c in BLOBS[:3]), batch.column("blob"), strict=True):
                if held and (bucket != now or bucket < 0):
                    yield from done(now, held)
                    held = []
                now = bucket
                held.append(unpacked(memoryview(blob.as_buffer()), n, least))
        if held:
            yield from done(now, held)
    return run


def suffix_order(text: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Place in suffix order of the ``size`` bytes at each place, equal strings sharing the first; refined eight bytes at a time among what is still equal."""
    words, rank, open_ = _words(text, ">u8"), np.zeros(len(places), np.int64), np.arange(len(places))
    for at in [*range(0, size - 8, 8), size - 8]:
        value, old = words[places[open_] + at].astype(np.uint64), rank[open_]
        order = np.lexsort((value, old))
        value, old = value[order], old[order]
        groups, members = _runs(old)
        first, many = _runs(old, value)
        start = np.repeat(groups, members)[first]
        new = np.repeat(old[first] + first - start, many)
        rank[open_[order]] = new
        open_ = open_[order[np.repeat(many > 1, many)]]
        if not len(open_):
            break
    return rank


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it that is smaller, -1 without one; steps are doubled until they end."""
    at = np.arange(-1, len(values) - 1)
    while True:
        far = np.flatnonzero(at >= 0)
        far = far[values[at[far]] >= values[far]]
        if not len(far):
            return at
        at[far] = at[at[far]]


def has_earlier(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of a suffix has the full size: the nearest entry of a smaller key, before or after it in suffix order, has its rank."""
    order = np.argsort(rank, kind="stable")
    _, many = _runs(rank[order])
    out = np.zeros(len(rank), bool)
    order = order[np.repeat(many > 1, many)]  # a string that occurs once has no earlier one
    ranks, docs, n = rank[order], doc[order], len(order)
    if not n:
        return out
    before, after = previous_smaller(docs), n - 1 - previous_smaller(docs[::-1])[::-1]
    found = (before >= 0) & (ranks[before] == ranks)
    found |= (after < n) & (ranks[np.minimum(after, n - 1)] == ranks)
    out[order] = found
    return out


OPEN = ("mark", "salt", "salts", "doc", "part", "pos", "bytes")
FOUND = ("window", "doc", "part", "pos", "len")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts with their open stretches -> the bytes of these."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, part, n, data, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "part", "n")), batch.column("z"), batch.column("open").to_pylist(), strict=True):
            text = pa.decompress(data.as_buffer(), n, codec="zstd", asbytes=True)
            for s in spans:
                salts = s["salts"]
                rows.append((s["mark"], xxh3_64_intdigest(f"{doc} {s['pos']}") % salts, salts, doc, part, s["pos"], text[s["pos"]:s["pos"] + s["len"]]))
            if len(rows) > 20_000:
                yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True))), names=OPEN)
                rows = []
        if rows:
            yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True))), names=OPEN)


def factors(held: list[dict], size: int) -> tuple[np.ndarray, ...]:
    """(window starts, stretch of each, whether an earlier document has it, text) of open stretches, by their suffix array."""
    lengths = np.array([len(h["bytes"]) for h in held])
    starts = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"".join([*(h["bytes"] for h in held), b"\0" * (size + 8)]), np.uint8)
    places = _joined(lengths, starts, size)
    own = np.searchsorted(starts, places, side="right") - 1
    doc = np.array([h["doc"] for h in held], np.int64)[own]
    return places - starts[own], own, has_earlier(suffix_order(text, places, size), doc), text[places[:, None] + np.arange(size)] if any(h["salts"] > 1 for h in held) else None


def _factored(size: int):
    """Open stretches, mark after mark -> spans that an earlier document has, and, of marks in several arrays, the other windows."""
    def done(held):
        start, own, earlier, windows = factors(held, size)
        doc, part, pos = (np.array([h[c] for h in held], np.int64)[own] for c in ("doc", "part", "pos"))
        pos = pos + start
        gone = np.flatnonzero(earlier)
        heads, end = _spans(doc[gone], part[gone], pos[gone], np.full(len(gone), size))
        gone = gone[heads]
        if len(gone):
            yield pa.record_batch([pa.nulls(len(gone), pa.binary()), *(pa.array(c[gone]) for c in (doc, part, pos)), pa.array(end - pos[gone])], names=FOUND)
        several = np.array([h["salts"] > 1 for h in held])[own] & ~earlier
        for some in np.array_split(np.flatnonzero(several), 1 + several.sum() // 20_000):
            if len(some):
                yield pa.record_batch([pa.array([w.tobytes() for w in windows[some]], pa.binary()), *(pa.array(c[some]) for c in (doc, part, pos)), pa.array(np.full(len(some), size))], names=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, total = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["mark"], row["salt"])
                if total >= ARRAY and key != now:
                    yield from done(held)
                    held, total = [], 0
                now = key
                held.append(row)
                total += len(row["bytes"])
        if held:
            yield from done(held)
    return run


def without(text: bytes | memoryview, spans) -> tuple[int, list[tuple[int, int]], bytes]:
    """(removed bytes, maximal removed runs, remaining bytes) of a text for spans of (pos, len) in any order."""
    runs: list[list[int]] = []
    for start, end in sorted((s["pos"], s["pos"] + s["len"]) for s in spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return sum(b - a for a, b in runs), [(a, b) for a, b in runs], b"".join(kept)


RESULT = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    ("kept", pa.binary()), ("kept_sha256", pa.string())])
#: Rows of texts that a task holds unpacked.
ROWS = 200


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> compressed texts and their lengths."""
    for batch in batches:
        texts = batch.column("bytes")
        yield pa.record_batch([batch.column("doc"), batch.column("part"), pa.array([len(t.as_buffer()) for t in texts], pa.int64()),
                               pa.array([pa.compress(t.as_buffer(), codec="zstd", asbytes=True) for t in texts], pa.binary())], names=["doc", "part", "n", "z"])


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = []
                some = batch.slice(at, ROWS)
                for doc, n, z, spans in zip(some.column("doc").to_pylist(), some.column("n").to_pylist(), some.column("z"), some.column("spans").to_pylist(), strict=True):
                    removed, runs, kept = without(memoryview(pa.decompress(z.as_buffer(), n, codec="zstd", asbytes=True)), spans or [])
                    rows.append((doc, n, removed, [{"start": a, "stop": b} for a, b in runs], kept if with_text else None, hashlib.sha256(kept).hexdigest()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT.types, strict=True)], names=RESULT.names)
    return run


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc, part, pos, len): spans whose windows of ``size`` bytes all start in a document of a smaller key too; spans overlap.

    ``docs`` has doc bigint (not null), part bigint and bytes binary; (doc, part) names a row.
    """
    gram_of(size)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    buckets = max(4 * partitions(docs.sparkSession), total // (size // 5) // BUCKET)
    stretches = docs.mapInArrow(_stretches(size, buckets), "bucket bigint, n int, least bigint, blob binary")
    dealt = stretches.repartition("bucket").sortWithinPartitions("bucket")
    settled = materialise(dealt.mapInArrow(_settled(buckets), "doc bigint, part bigint, pos bigint, len bigint, mark bigint"))
    still = settled.where("mark is not null")
    large = materialise(still.groupBy("mark").agg(F.ceil(F.sum("len") / ARRAY).alias("salts")).where("salts > 1"))
    several = not large.isEmpty()
    still = still.join(large, "mark", "left").withColumn("salts", F.coalesce("salts", F.lit(1))) if several else still.withColumn("salts", F.lit(1).cast("bigint"))
    still = still.groupBy("doc", "part").agg(F.collect_list(F.struct("pos", "len", "mark", "salts")).alias("open"))
    texts = docs.mapInArrow(_squeezed, "doc bigint, part bigint, n bigint, z binary")
    bytes_of = texts.join(still, ["doc", "part"]).mapInArrow(_cut, "mark bigint, salt bigint, salts bigint, doc bigint, part bigint, pos bigint, bytes binary")
    found = bytes_of.repartition("mark", "salt").sortWithinPartitions("mark", "salt").mapInArrow(_factored(size), "window binary, doc bigint, part bigint, pos bigint, len bigint")
    found = materialise(found)
    spans = settled.where("mark is null").select("doc", "part", "pos", "len").unionByName(found.where("window is null").drop("window"))
    if several:
        smallest = F.min("doc").over(Window.partitionBy("window"))
        spans = spans.unionByName(found.where("window is not null").withColumn("smallest", smallest).where("doc > smallest").select("doc", "part", "pos", "len"))
    return spans


def remove_repeats(rows: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept_sha256) of every row, and the remaining bytes as ``kept`` on demand.

    Texts are their UTF-8 bytes (null counts as empty); a byte is removed if a string of
    ``size`` bytes around it also starts in a row with a smaller key.  Rows of one key
    are never earlier than each other.  Rows without a key are kept whole and nobody's
    earlier copy.  ``spans`` are the maximal removed runs as byte offsets.  The rest may
    cut a character in two, so it is bytes, not text.  Other columns are not looked at;
    no rows give no rows.
    """
    every = rows.select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    again = materialise(every.where("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit(True).alias("again")))
    if again.isEmpty():
        every = every.withColumn("part", F.lit(0).cast("bigint"))
    else:
        every = every.join(again, "doc", "left").withColumn("part", F.when(F.col("again"), F.xxhash64("bytes")).otherwise(F.lit(0).cast("bigint"))).drop("again")
    known = every.where("doc is not null").select("doc", "part", "bytes")
    gone = repeated_spans(known, size).groupBy("doc", "part").agg(F.collect_list(F.struct("pos", "len")).alias("spans"))
    texts = every.select("doc", "part", "bytes").mapInArrow(_squeezed, "doc bigint, part bigint, n bigint, z binary")
    out = texts.join(gone, ["doc", "part"], "left").select("doc", "n", "z", "spans")
    out = out.mapInArrow(_kept(with_text), "doc bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary, kept_sha256 string")
    return out.select(F.col("doc").alias(key), "n_bytes", "n_removed", "spans", *(["kept"] if with_text else []), "kept_sha256")
