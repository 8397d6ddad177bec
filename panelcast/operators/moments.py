"""Moment matrices of a wide table, by segments that can be added up, from one scan.

A task multiplies batches of rows into one matrix for each segment (counts, sums and
cross sums of all columns, with one more column per feature that says where it is
missing), so what it sends is a fixed number of values however many rows it read.
Matrices of the same layout add up: every growing training set, fold, subset of columns
and imputation by given values is answered from the same few matrices.

Values are shifted by a typical value of their column before they are multiplied, so
columns with large means and small spreads lose no digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite

PART = ("segment", "salt", "data")


@dataclass(frozen=True)
class Moments:
    """Products of [1, values, missing flags, squares if asked for, targets]; values and targets are shifted, missing values are 0."""

    matrix: np.ndarray
    columns: tuple[str, ...]
    targets: tuple[str, ...]
    shift: Mapping[str, float]

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.matrix + other.matrix, self.columns, self.targets, self.shift)

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def imputed(self, columns: Sequence[str], fill: Mapping[str, float], target: str) -> np.ndarray:
        """Products of [1, shifted columns with missing values replaced, shifted target]."""
        p = len(self.columns)
        select = np.zeros((len(columns) + 2, len(self.matrix)))
        select[0, 0] = select[-1, len(self.matrix) - len(self.targets) + self.targets.index(target)] = 1.0
        for row, c in enumerate(columns, 1):
            at = self.columns.index(c)
            select[row, 1 + at] = 1.0
            select[row, 1 + p + at] = fill[c] - self.shift[c]
        return select @ self.matrix @ select.T

    def pairs(self) -> dict[str, np.ndarray]:
        """For every two columns, over the rows that have both: count, sums of the first and the second, sums of squares, cross sum (all shifted).

        Needs :func:`segment_moments` with ``squares``.
        """
        p = len(self.columns)
        values, flags, squares = slice(1, 1 + p), slice(1 + p, 1 + 2 * p), slice(1 + 2 * p, 1 + 3 * p)
        m = self.matrix
        missing, total = np.diag(m[flags, flags]), m[0, values]
        both = m[0, 0] - missing[:, None] - missing[None, :] + m[flags, flags]
        first = total[:, None] - m[values, flags]
        square = m[0, squares][:, None] - m[squares, flags]
        return {"n": both, "x": first, "y": first.T, "xx": square, "yy": square.T, "xy": m[values, values]}


def _multiplied(p: int, shift: np.ndarray, squares: bool):
    """Rows (values, targets, segment) -> one matrix for each segment of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            data = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]) - shift
            missing = np.isnan(data)
            data[missing] = 0.0
            parts = [np.ones((len(data), 1)), data[:, :p], missing[:, :p].astype(np.float64), *([data[:, :p] ** 2] if squares else []), data[:, p:]]
            whole = np.concatenate(parts, axis=1)
            segment = np.asarray(batch.column(batch.num_columns - 1))
            for s in np.unique(segment).tolist():
                own = whole[segment == s]
                sums[s] = sums.get(s, 0) + own.T @ own
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([TaskContext.get().partitionId()] * len(sums), pa.int64()),
                                   pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=PART)
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for s, salt, data in zip(*(batch.column(c).to_pylist() for c in PART), strict=True):
            sums[s, salt] = sums.get((s, salt), 0) + np.frombuffer(data)
    if sums:
        yield pa.record_batch([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=PART)


def segment_moments(df: DataFrame, columns: Sequence[str], targets: Mapping[str, Column], segment: Column | None = None,
                    shift: Mapping[str, float] | None = None, squares: bool = False) -> dict[int, Moments]:
    """``{segment: moments}``; rows without a segment are left out, values that are not finite are missing.

    Targets must not be missing.  Parts are added up in two rounds, so no task and not
    the driver meets more than about the square root of the number of tasks.
    """
    columns, shift = tuple(dict.fromkeys(columns)), dict(shift or {})
    shift = {c: float(shift.get(c) or 0.0) for c in (*columns, *targets)}
    rows = df.select(*[finite(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)], *[t.cast("double").alias(f"t{i}") for i, t in enumerate(targets.values())],
                     (F.lit(0) if segment is None else segment).cast("bigint").alias("segment")).where("segment is not null")
    schema = "segment bigint, salt bigint, data binary"
    parts = rows.mapInArrow(_multiplied(len(columns), np.array([shift[c] for c in (*columns, *targets)]), squares), schema)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.withColumn("salt", F.col("salt") % max(1, math.isqrt(tasks))).repartition("segment", "salt").mapInArrow(_added, schema)
    sums: dict[int, np.ndarray] = {}
    for r in parts.collect():  # a few matrices per segment
        sums[r.segment] = sums.get(r.segment, 0) + np.frombuffer(r.data)
    return {s: Moments(m.reshape(math.isqrt(len(m)), -1), columns, tuple(targets), shift) for s, m in sorted(sums.items())}


def linear_solution(products: np.ndarray, columns: Sequence[str], shift: Mapping[str, float], target: str, reg: float = 0.0, mixing: float = 0.0,
                    tolerance: float = 1e-12, rounds: int = 10_000) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of penalised least squares on standardised columns from :meth:`Moments.imputed`.

    ``reg`` and ``mixing`` mean what ``regParam`` and ``elasticNetParam`` mean to Spark's
    linear regression: the penalty acts on columns and target scaled to unit spread.
    """
    n = products[0, 0]
    mean = products[0, 1:] / n
    cov = products[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    floor = 1e-12 * np.sqrt(np.maximum(np.diag(products[1:, 1:]) / n, 0.0))
    spread[spread <= floor] = 0.0
    coefficients = np.zeros(len(columns))
    live = np.flatnonzero(spread[:-1] > 0)
    if spread[-1] > 0 and len(live):
        scale, label = spread[live], spread[-1]
        c = cov[np.ix_(live, live)] / np.outer(scale, scale)
        b = cov[live, -1] / (scale * label)
        strength = reg / label
        ridge, lasso = (1 - mixing) * strength, mixing * strength
        if not lasso:
            beta = np.linalg.lstsq(c + ridge * np.eye(len(live)), b, rcond=None)[0] if ridge <= 0 else np.linalg.solve(c + ridge * np.eye(len(live)), b)
        else:  # coordinate descent
            beta = np.zeros(len(live))
            for _ in range(rounds):
                moved = 0.0
                for j in range(len(live)):
                    pull = b[j] - c[j] @ beta + c[j, j] * beta[j]
                    new = math.copysign(max(abs(pull) - lasso, 0.0), pull) / (c[j, j] + ridge)
                    moved, beta[j] = max(moved, abs(new - beta[j])), new
                if moved < tolerance:
                    break
        coefficients[live] = beta * label / scale
    centre = mean[:-1] + np.array([shift[c] for c in columns])
    return coefficients, float(mean[-1] + shift[target] - coefficients @ centre)
