"""Vector codes against rounds in plain Python integers."""

import hashlib
import math

import numpy as np
import pytest

from panelcast.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, code string, error string, v string"


def brute(rows, parts=8, entries=16, rounds=6):
    """{place: (vec_id, code, error, label)} and the digest, by comparing every part with every entry."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1]) // parts
    cut = [[[math.floor(4096 * x) for x in r[1][p * length:(p + 1) * length]] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(members[e]) for col in zip(*members[e], strict=True)] if e in members else c for e, c in enumerate(books[p])]
    out = []
    for r, c in zip(kept, cut, strict=True):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), r[2]))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    fits = lambda n: n if n < 1 << 63 else None
    return sorted([(i, code, fits(error), fits(sums[label]), sha) for i, code, error, label in out], key=str)


def coded(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", None) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in vector_codes.coded_vectors(df).collect()), key=str)


def points(n, width=16, seed=1, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, width))
    return (centres[rng.integers(0, 7, n)] + spread * rng.standard_normal((n, width))).round(4).tolist()


def test_equals_brute_force(spark):
    rows = [(i, v, i % 5 if i % 5 else None) for i, v in enumerate(points(700))]
    assert coded(spark, rows) == brute(rows)
    assert coded(spark, rows[::-1]) == brute(rows)  # however the rows are dealt


def test_odd_rows(spark):
    good = points(60)
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(100, None, 1), (101, [float("nan")] * 16, 1), (102, [None] * 16, 2), (103, [float("inf")] + [0.0] * 15, None), (104, [], 1)]
    rows += [(None, good[3], None), (7, good[7], 1), (7, good[9], 3), (105, [0.0] * 16, 3), (106, [-0.0] * 16, 3)]
    assert coded(spark, rows) == brute(rows)


def test_ties_and_unused_entries(spark):
    rows = [(i, [float(i // 4 % 3)] * 16, 0) for i in range(200)]  # equal vectors: equal entries, of which only the first is used
    got = coded(spark, rows)
    assert got == brute(rows) and {r[1] for r in got} == {"00" * 8, "04" * 8, "08" * 8}


@pytest.mark.parametrize("size", [30.0, 1e6, 1e12])
def test_large_components(spark, size):
    rows = [(i, [x * size for x in v], i % 2) for i, v in enumerate(points(90, width=8))]
    assert coded(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(5, [0.5] * 8, None), (3, [-0.25] * 8, 1)]
    assert coded(spark, rows) == brute(rows)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


def test_widths(spark):
    rows = [(1, [0.1] * 12, 1), (2, [0.2] * 12, 1), (3, [0.3] * 8, 1)]
    got = coded(spark, rows)
    assert [r[0] for r in got] == [1, 2] and all(len(r[1]) == 16 and r[2] == 0 for r in got)


@pytest.mark.parametrize("clusters, most", [(0, 16), (6, 8)])
def test_blocks_lose_no_nearest_entry(clusters, most):
    """Whatever the shortlists leave out is farther than what they keep; they are short where vectors lie in clusters."""
    rng = np.random.default_rng(3)
    data = rng.integers(-300, 300, (clusters, 5))[rng.integers(0, clusters, 4000)] + rng.integers(-9, 9, (4000, 5)) if clusters else rng.integers(-300, 300, (4000, 5))
    data = data[np.argsort(vector_codes.hilbert_keys(data))]
    starts = np.arange(0, 4000, 32)
    entries = rng.integers(-300, 300, (16, 5))
    listed = vector_codes.shortlists(np.minimum.reduceat(data, starts), np.maximum.reduceat(data, starts), entries)
    far = ((data[:, None] - entries[None]) ** 2).sum(-1)
    assert np.repeat(listed, 32, axis=0)[far == far.min(1)[:, None]].all() and listed.sum(1).mean() <= most


def test_hilbert_neighbours():
    """Points of a full grid follow each other in unit steps."""
    grid = np.stack(np.meshgrid(np.arange(16), np.arange(16), indexing="ij"), -1).reshape(-1, 2) * 4369
    walk = grid[np.argsort(vector_codes.hilbert_keys(grid))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 4369).all()
