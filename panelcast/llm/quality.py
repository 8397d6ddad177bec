"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are gathered in one pass.  The trees are grown on binned
statistics of a bounded sample of labelled documents; every tree is a full binary tree
laid out in arrays, so that scoring walks all documents and trees of a batch down one
level at a time in numpy.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Labelled documents that the trees are grown on: at most about so many, chosen by a hash of the key.
MAX_LABELLED = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAF = 60, 4, 32, 0.2, 1.0, 5

SIGNS = np.zeros(256, bool)
SIGNS[list(b"#$%&*~^=<>{}[]\\/@+")] = True
ASCII = np.zeros(256, bool)
ASCII[list(range(65, 91)) + list(range(97, 123))] = True
STATISTICS = ("log_chars", "log_words", "word_length", "letters", "upper", "digits", "signs", "exclaim", "bar", "stops", "wide", "blank",
              "distinct", "commonest", "repeats", "line_words", "line_distinct", "longest_word", "signed_words", "bigram_distinct")


def statistics(text: str) -> list[float]:
    """Shares and sizes that describe a text; zeros for the empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    ascii_letters = int(byte[ASCII].sum())
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    k, many = max(len(words), 1), Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    signs = int(byte[SIGNS].sum())
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / k, (ascii_letters + int(byte[128:].sum())) / n, int(byte[65:91].sum()) / max(ascii_letters, 1),
        int(byte[48:58].sum()) / n, signs / n, int(byte[33]) / n, int(byte[124]) / n, int(byte[46] + byte[44]) / k, int(byte[128:].sum()) / n,
        int(byte[32] + byte[10] + byte[9]) / n, len(many) / k, max(many.values(), default=0) / k, sum(map(eq, words, words[1:])) / k,
        len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), max(map(len, words), default=0), signs / k, pairs / max(len(words) - 1, 1),
    ]


@dataclass
class Forest:
    """Trees as arrays: node i of a tree has the children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.base)
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        while node[0, 0] < inner if len(x) else False:
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.leaf[trees, node - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boost logistic loss; splits maximise the gain over histograms of gradients.  One class or no rows give a constant."""
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        empty = np.zeros((0, inner))
        return Forest(empty.astype(np.int64), empty, np.zeros((0, 2**depth)), 4.0 if len(y) and y.max() else (-4.0 if len(y) else 0.0))
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="inverted_cdf")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin <= b means x <= edge b
    offsets = np.arange(x.shape[1]) * bins
    p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = math.log(p / (1 - p))
    margin = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, np.maximum(q * (1 - q), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first) * (x.shape[1] * bins))[:, None] + offsets + binned
            shape = (width, x.shape[1], bins)
            total = width * x.shape[1] * bins
            many = np.bincount(at.ravel(), minlength=total).reshape(shape).cumsum(2)
            gs = np.bincount(at.ravel(), np.repeat(g, x.shape[1]), minlength=total).reshape(shape).cumsum(2)
            hs = np.bincount(at.ravel(), np.repeat(h, x.shape[1]), minlength=total).reshape(shape).cumsum(2)
            all_g, all_h, all_n = gs[:, :1, -1:], hs[:, :1, -1:], many[:, :1, -1:]
            gain = gs**2 / (hs + RIDGE) + (all_g - gs)**2 / (all_h - hs + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(many < LEAF) | (all_n - many < LEAF)] = 0.0
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            for i in np.flatnonzero(flat[np.arange(width), best] > 1e-9):
                f, b = divmod(int(best[i]), bins)
                if b < len(edges[f]):
                    feature[t, first + i], threshold[t, first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        own = node - inner
        leaf[t] = rate * np.bincount(own, g, minlength=2**depth) / (np.bincount(own, h, minlength=2**depth) + RIDGE)
        margin += leaf[t, own]
    return Forest(feature, threshold, leaf, base)


def described(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """Statistics of the texts of a batch (null: of the empty text)."""
    return np.array([statistics(t.as_py() or "") for t in batch.column(at)], np.float64).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Forest:
    """Grow the trees on labelled documents.

    ``labels`` has (key, label); rows with a null key or label teach nothing, a key with
    several labels has the greatest.  Without both classes the score is a constant.
    """
    taught = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).na.drop().groupBy("k").agg(F.max("y").alias("y"))
    n = taught.count()
    if n > max_labelled:
        taught = taught.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = described(batch, 2)
            stops = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.record_batch([*batch.columns[:2], pa.ListArray.from_arrays(stops, pa.array(x.ravel()))], names=["k", "y", "x"])
    # the labelled keys are bounded by max_labelled, so they may be sent to every task
    some = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(taught), "k").select("k", "y", "text")
    rows = some.mapInArrow(run, f"k {dict(some.dtypes)['k']}, y int, x array<double>").orderBy("k", "x").collect()
    x = np.array([r.x for r in rows], float).reshape(-1, len(STATISTICS))
    return grow(x, np.array([float(bool(r.y)) for r in rows]))


def score(docs: DataFrame, forest: Forest, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Add score and predicted to every row (other columns stay, so they must not have these names).

    Null texts are empty; repeated rows are scored alike; no rows give no rows.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = forest.score(described(batch, at))
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, score, predicted])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType()), StructField(predicted, IntegerType())]))
