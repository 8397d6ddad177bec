"""Exact quantiles of whole columns by radix selection, distributed.

A double has a whole-number form of 64 bits with the same order.  A pass counts, for all
columns and probabilities together, the next bits of the values whose leading bits are
those of a wanted rank; the counts say which bits the rank has.  Leading bits and counts
are all that is known between passes, so no value is gathered, ranked or bracketed, and
a task holds one batch of rows.  A pass counts as many bits as keep its table of counts
bounded; once few values are left, one pass counts all remaining bits.  Ties are counted,
not repeated.  The answer equals the linear-interpolation quantile of the full column.

Rows may belong to segments (weeks between cut-off dates, say); quantiles of any unions
of segments, such as growing training sets, come from the same passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Bits of a pass, cells of its table of counts, and values that are counted to the last bit at once.
BITS, CELLS, FEW = 16, 1 << 20, 1 << 16
#: Values that a task sorts at a time.
HELD = 1 << 20
TOP = 1 << 63
COUNTS = ("slot", "prefix", "segment", "digit", "n", "lo", "hi")


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned whole numbers of the same order; both zeros are one."""
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(TOP - 1))).view(np.uint64) ^ np.uint64(TOP)


def value_of(bits: int) -> float:
    signed = np.array([bits], np.uint64) ^ np.uint64(TOP)
    signed = signed.view(np.int64)
    return float((signed ^ ((signed >> 63) & np.int64(TOP - 1))).view(np.float64)[0])


def _counts(prefixes: list[list[int]], known: int, more: int):
    """Rows -> how often each value of the next ``more`` bits follows a wanted prefix of ``known`` bits, with the extremes of these values."""
    wanted = [np.array(p, np.uint64) for p in prefixes]

    def counted(slot: int, values: np.ndarray, segment: np.ndarray):
        bits = ordered_bits(values)
        if known:
            head = bits >> np.uint64(64 - known)
            at = np.minimum(np.searchsorted(wanted[slot], head), len(wanted[slot]) - 1)
            keep = wanted[slot][at] == head
            bits, segment = bits[keep], segment[keep]
        if not len(bits):
            return None
        order = np.lexsort((bits, segment))
        bits, segment = bits[order], segment[order]
        cell = bits >> np.uint64(64 - known - more)
        first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (segment[1:] != segment[:-1])))
        many = np.diff(np.append(first, len(bits)))
        head = (cell[first] >> np.uint64(more)) if more < 64 else np.zeros(len(first), np.uint64)
        digit = cell[first] & np.uint64((1 << more) - 1)
        signed = (bits ^ np.uint64(TOP)).view(np.int64)
        return [np.full(len(first), slot, np.int32), head.view(np.int64), segment[first], digit.view(np.int64), many, signed[first], signed[first + many - 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in wanted]

        def done():
            parts = [counted(slot, *(np.concatenate(x) for x in zip(*h, strict=True))) for slot, h in enumerate(held) if h]
            parts = [p for p in parts if p]
            for h in held:
                h.clear()
            if parts:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=COUNTS)

        rows = 0
        for batch in batches:
            segment = np.asarray(batch.column(len(wanted))).astype(np.int32)
            for slot in range(len(wanted)):
                values = batch.column(slot).to_numpy(zero_copy_only=False)
                sound = ~np.isnan(values)  # nulls arrive as NaN
                if len(wanted[slot]) and sound.any():
                    held[slot].append((values[sound], segment[sound]))
            rows += len(batch)
            if rows * len(wanted) >= HELD:
                yield from done()
                rows = 0
        yield from done()
    return run


def quantiles_of_sets(df: DataFrame, columns: Sequence[str], probs: Sequence[float], sets: Mapping[object, Iterable[int]],
                      segment: Column | None = None, written: bool = False) -> dict[object, dict[str, list[float | None]]]:
    """``{set: {column: [quantile per prob]}}`` of the rows whose segment belongs to each set.

    ``written`` says that ``df`` reads a table, so that passes need not write one first.
    Rows without a segment belong to no set; null and NaN are left out; a column without
    values gives ``None``.
    """
    columns, probs = list(dict.fromkeys(columns)), list(probs)
    members = {name: np.array(sorted(set(s)), np.int32) for name, s in sets.items()}
    chosen = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)], (F.lit(0) if segment is None else segment).cast("int").alias("segment"))
    chosen = chosen.where("segment is not null")
    data = chosen if written else materialise(chosen)
    n_segments = max(1, len(set(np.concatenate([*members.values(), np.zeros(0, np.int32)]).tolist())))
    answers = {name: {c: [None] * len(probs) for c in columns} for name in members}
    # (set, slot, rank) -> (prefix, rank among the values with it); ranks are known after the first pass
    open_: dict[tuple, tuple[int, int]] = {}
    found: dict[tuple, int] = {}
    sizes: dict[tuple, int] = {}
    known, more, prefixes = 0, BITS, [[0] for _ in columns]
    while True:
        table = data.mapInArrow(_counts(prefixes, known, more), "slot int, prefix bigint, segment int, digit bigint, n bigint, lo bigint, hi bigint")
        table = table.groupBy("slot", "prefix", "segment", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
        cells = {c: table.column(c).to_numpy() for c in COUNTS}
        order = np.lexsort((cells["digit"].view(np.uint64), cells["prefix"].view(np.uint64), cells["slot"]))
        cells = {c: v[order] for c, v in cells.items()}
        groups = np.flatnonzero(np.append(len(order) > 0, (np.diff(cells["slot"]) != 0) | (np.diff(cells["prefix"]) != 0)))
        of = {(int(cells["slot"][a]), int(cells["prefix"][a])): slice(a, b) for a, b in zip(groups, np.append(groups[1:], len(order)), strict=False)}
        if not known:
            for name, segments in members.items():
                for slot in range(len(columns)):
                    rows = of.get((slot, 0), slice(0, 0))
                    n = int(cells["n"][rows][np.isin(cells["segment"][rows], segments)].sum())
                    sizes[name, slot] = n
                    for p in probs if n else ():
                        for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                            open_[name, slot, rank] = (0, rank)
        left, still = {}, {}
        for (name, slot, rank), (prefix, inside) in open_.items():
            rows = of[slot, prefix]
            own = np.isin(cells["segment"][rows], members[name])
            digit, n, lo, hi = (cells[c][rows][own] for c in ("digit", "n", "lo", "hi"))
            cut = np.flatnonzero(np.append(True, digit[1:] != digit[:-1]))
            upto = np.cumsum(np.add.reduceat(n, cut))
            at = int(np.searchsorted(upto, inside, side="right"))
            low, high = np.minimum.reduceat(lo, cut)[at], np.maximum.reduceat(hi, cut)[at]
            if low == high:
                found[name, slot, rank] = int(np.array([low], np.int64).view(np.uint64)[0]) ^ TOP
            else:
                head = (prefix << more) | int(digit[cut[at]])
                still[name, slot, rank] = (head, inside - (int(upto[at - 1]) if at else 0))
                left[slot, head] = int(cells["n"][rows][cells["digit"][rows] == digit[cut[at]]].sum())
        if not still:
            break
        open_, known = still, known + more
        prefixes = [sorted({h for s, h in left if s == slot}) for slot in range(len(columns))]
        room = max(2, int(math.log2(CELLS / (len(left) * n_segments))))
        more = 64 - known if sum(left.values()) <= FEW else min(BITS, room, 64 - known)
    for name, by in answers.items():
        for slot, c in enumerate(columns):
            n = sizes[name, slot]
            for i, p in enumerate(probs if n else ()):
                rank = p * (n - 1)
                lower, upper = (value_of(found[name, slot, f(rank)]) for f in (math.floor, math.ceil))
                by[c][i] = lower + (upper - lower) * (rank - math.floor(rank)) if lower != upper else lower
    return answers


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], written: bool = False) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}``; a column without values gives ``None``.  NaN counts as missing."""
    return quantiles_of_sets(df, columns, probs, {0: [0]}, written=written)[0]


def exact_quantile(df: DataFrame, column: str, prob: float) -> float | None:
    """One quantile of one column."""
    return exact_quantiles(df, [column], [prob])[column][0]
