"""Linear models of many training sets from one scan of the matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..operators.moments import Moments, linear_solution, segment_moments
from ..operators.quantiles import quantiles_of_sets
from .forecast import Fitted


@dataclass(frozen=True)
class LinearSolution:
    """Coefficients with the ``transform`` of a fitted linear model."""

    coefficients: DenseVector
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(v)) for v in self.coefficients])
        products = F.zip_with(vector_to_array("features"), weights, lambda v, w: v * w)
        return df.withColumn("prediction", F.aggregate(products, F.lit(float(self.intercept)), lambda a, x: a + x))


def solvable(model_factory: Callable) -> tuple[float, float] | None:
    """(penalty, mixing) if the factory makes a plain least-squares model that moments determine, else None."""
    estimator = model_factory()
    if not isinstance(estimator, LinearRegression) or estimator.getLoss() != "squaredError" or not estimator.getFitIntercept():
        return None
    if not estimator.getStandardization() or estimator.isSet(estimator.weightCol):
        return None
    return estimator.getRegParam(), estimator.getElasticNetParam()


@dataclass(frozen=True)
class Sums:
    """What one pair of scans leaves of a matrix: medians and moments of every training set."""

    medians: Mapping[object, Mapping[str, float]]
    moments: Mapping[int, Moments]
    sets: Mapping[object, Sequence[int]]

    def fit(self, name: object, columns: Sequence[str], penalty: tuple[float, float], target: str = "cases") -> Fitted:
        """The model of one training set on some of the columns."""
        parts = [self.moments[s] for s in self.sets[name] if s in self.moments]
        n = int(sum(p.n for p in parts))
        if n < 10:
            raise ValueError(f"training is impossible: {n} usable rows")
        whole, medians = reduce(add, parts), {c: self.medians[name][c] for c in columns}
        weights, intercept = linear_solution(whole.imputed(columns, medians, target), columns, whole.shift, target, *penalty)
        return Fitted(LinearSolution(DenseVector(weights), intercept), "LinearRegressionModel", list(columns), medians, log_target=target == "log", n_train=n)


def training_sums(matrix: DataFrame, columns: Sequence[str], sets: Mapping[object, Iterable[int]], segment: Column) -> Sums:
    """Exact medians and moments of all training sets; ``matrix`` reads a written table.

    A training set is a union of segments: weeks between cut-off dates, or rows with
    the same memberships in folds.
    """
    sets = {name: sorted(set(s)) for name, s in sets.items()}
    cleaned = matrix.select(*[finite(c).alias(c) for c in columns], segment.alias("_segment"))
    found = quantiles_of_sets(cleaned, columns, [0.5], sets, F.col("_segment"), written=True)
    medians = {name: {c: by[c][0] if by[c][0] is not None else 0.0 for c in columns} for name, by in found.items()}
    largest = max(sets, key=lambda name: len(sets[name]))
    label = F.col("cases").cast("double")
    moments = segment_moments(matrix, columns, {"cases": label, "log": F.log1p(label)}, segment, medians[largest])
    return Sums(medians, moments, sets)


def growing(origins: Sequence[int]) -> tuple[dict[int, list[int]], Column]:
    """(training set of each origin, segment of a row): rows up to an origin are the segments up to its place; later rows have none."""
    origins = sorted(int(o) for o in origins)
    place = reduce(add, [(F.col("week_index") > o).cast("int") for o in origins])
    return {o: list(range(i + 1)) for i, o in enumerate(origins)}, F.when(place < len(origins), place)


def by_membership(matrix: DataFrame, folds: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, dict[int, list[int]]]:
    """(matrix with ``_segment``, training set of each fold): rows in the training sets of the same folds are one segment."""
    member = F.bit_or(F.expr("shiftleft(1L, cast(fold as int))"))
    masks = folds.where("role = 'train'").groupBy(*keys).agg(member.alias("_segment"))
    out = matrix.join(masks, list(keys), "left")
    found = [r[0] for r in masks.select("_segment").distinct().collect()]  # one row per combination of folds that occurs
    numbers = sorted({f for m in found for f in range(m.bit_length()) if m >> f & 1})
    return out.withColumn("_segment", _numbered(found)), {f: [i for i, m in enumerate(sorted(found)) if m >> f & 1] for f in numbers}


def _numbered(masks: Sequence[int]) -> Column:
    pairs = [v for i, m in enumerate(sorted(masks)) for v in (F.lit(m).cast("bigint"), F.lit(i))]
    return F.element_at(F.create_map(*pairs), F.col("_segment")) if pairs else F.lit(None).cast("int")
