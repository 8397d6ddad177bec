"""Removal of repeated byte strings against a dictionary of all windows."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string, doc string, part string, bytes string, window string, spans string"


def brute(rows, size=50):
    """(doc_id, n_bytes, n_removed, spans, sha) of every row."""
    first = {}
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for key, text in sorted((d for d in data if d[0] is not None), key=lambda d: d[0]):
        for i in range(len(text) - size + 1):
            first.setdefault(text[i:i + size], key)
    out = []
    for key, text in data:
        gone = np.zeros(len(text) + 2, bool)
        for i in range(len(text) - size + 1) if key is not None else ():
            if first[text[i:i + size]] < key:
                gone[1 + i:1 + i + size] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        kept = bytes(b for b, g in zip(text, gone[1:], strict=False) if not g)
        out.append((key, len(text), int(gone.sum()), [(int(a), int(b)) for a, b in edges.reshape(-1, 2)], hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(spark, rows, **options):
    df = spark.createDataFrame([(*r, None, "x", "x", None, "x") for r in rows], SCHEMA).repartition(3)
    out = suffix_dedup.remove_repeats(df, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.stop) for s in r.spans], r.kept_sha256) for r in out), key=str)


def prose(n, seed, letters="abcdefghij     é"):
    rng = np.random.default_rng(seed)
    return "".join(rng.choice(list(letters), n))


def cases():
    rows = [(i, prose(300, i)) for i in range(20)]
    passage, other = prose(120, 1000), prose(55, 1001)
    rows += [(30 + i, prose(40 + i, 50 + i) + passage + prose(30, 80 + i)) for i in range(12)]  # a passage in different surroundings
    rows += [(60 + i, other[i % 3:] + prose(60, 90 + i) + passage[:49 + i]) for i in range(8)]  # shorter and longer pieces of it
    base = prose(900, 2000)
    rows += [(100 + i, base[:80 * i] + "#" + base[80 * i + 1:]) for i in range(11)]  # near copies
    rows += [(120 + i, base) for i in range(5)]
    rows += [(140, "x" * 400), (141, "x" * 49), (142, "x" * 50), (143, "xy" * 200), (144, "y" + "x" * 333), (145, prose(60, 7) * 5), (146, prose(60, 7))]
    rows += [(150, passage + passage), (151, passage[30:] + passage[:30])]
    return rows


def test_equals_brute_force(spark):
    rows = cases()
    assert removed(spark, rows) == brute(rows)
    assert removed(spark, rows, size=25) == brute(rows, 25)


def test_odd_rows(spark):
    text = prose(200, 5)
    rows = [(1, None), (2, ""), (3, " "), (4, text), (4, text), (4, "a" + text[:150]), (5, text[20:]), (None, text), (None, None), (0, text[:80]), (-3, "漢字" * 40), (9, "漢字" * 30), (9, None)]
    assert removed(spark, rows) == brute(rows)
    assert removed(spark, []) == []


@pytest.mark.parametrize("limits", [{}, {"SLICE": 256}, {"CROWD": 1}, {"SLICE": 700, "CROWD": 2, "ARRAY": 100}])
def test_borders_of_slices_and_crowded_marks(monkeypatch, limits):
    """Slices far smaller than a text, marks dealt by content, arrays of a few stretches: what they cut is found all the same."""
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = cases()
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([0] * len(rows)), pa.array([r[1].encode() for r in rows], pa.binary())], names=["doc", "part", "bytes"])
    assert removed_locally(batch, 3 if "ARRAY" in limits else 1) == {(d, a, b) for d, _, _, spans, _ in brute(rows) for a, b in spans}


def removed_locally(batch, salts):
    """Both steps in this process, the exchanges as plain sorts."""
    def sent(batches, *keys):
        return pa.Table.from_batches(batches).sort_by([(k, "ascending") for k in keys]).to_batches(max_chunksize=7)

    settled = pa.Table.from_batches(suffix_dedup._settled(5)(iter(sent(suffix_dedup._stretches(50, 5)(iter([batch])), "bucket")))).to_pylist()
    open_rows = {}
    for r in settled:
        if r["mark"] is not None:
            open_rows.setdefault(r["doc"], []).append({"pos": r["pos"], "len": r["len"], "mark": r["mark"], "salts": salts})
    texts = pa.Table.from_batches(suffix_dedup._squeezed(iter([batch]))).to_pylist()
    joined = pa.Table.from_pylist([t | {"open": open_rows[t["doc"]]} for t in texts if t["doc"] in open_rows])
    found = pa.Table.from_batches(suffix_dedup._factored(50)(iter(sent(suffix_dedup._cut(iter(joined.to_batches())), "mark", "salt")))).to_pylist()
    first = {}
    for r in found:
        if r["window"] is not None:
            first[r["window"]] = min(r["doc"], first.get(r["window"], r["doc"]))
    spans = {}
    for r in [r for r in settled if r["mark"] is None] + [r for r in found if r["window"] is None or r["doc"] > first[r["window"]]]:
        spans.setdefault(r["doc"], []).append(r)
    data = dict(zip(batch.column("doc").to_pylist(), batch.column("bytes").to_pylist(), strict=True))
    return {(d, a, b) for d, s in spans.items() for a, b in suffix_dedup.without(data[d], s)[1]}


def test_marks_in_several_arrays(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY", 300)
    rows = cases()
    assert removed(spark, rows) == brute(rows)


def test_packed_columns():
    rng = np.random.default_rng(1)
    mark = np.sort(rng.integers(0, 1 << 48, 50).astype(np.uint64))
    columns = [mark, rng.integers(0, 1 << 48, 50).astype(np.uint64), rng.integers(-(1 << 62), 1 << 62, 50), rng.integers(-(1 << 63), 1 << 62, 50), rng.integers(0, 1 << 40, 50), rng.integers(0, 1 << 31, 50)]
    back = suffix_dedup.unpacked(memoryview(suffix_dedup.packed(*columns)), 50, int(columns[2].min()))
    assert all((a == b).all() for a, b in zip(columns, back, strict=True))


def test_very_long_text(spark):
    """Five megabytes, of which a later document has two; and one byte repeated."""
    rng = np.random.default_rng(8)
    long = bytes(rng.integers(97, 123, 5_000_000, np.uint8)).decode()
    rows = [(1, long), (2, "?" + long[1_000_000:3_000_000] + "?"), (3, "z" * 300_000), (4, "z" * 100_000)]
    got = {r[0]: r[1:4] for r in removed(spark, rows)}
    assert got == {1: (5_000_000, 0, []), 2: (2_000_002, 2_000_000, [(1, 2_000_001)]), 3: (300_000, 0, []), 4: (100_000, 100_000, [(0, 100_000)])}


def test_suffix_order_and_previous_smaller():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 2, 600).astype(np.uint8)
    padded = np.append(text, np.zeros(60, np.uint8))
    places = np.arange(550)
    rank = suffix_dedup.suffix_order(padded, places, 50)
    strings = [padded[p:p + 50].tobytes() for p in places]
    order = sorted(strings)
    assert [order.index(s) for s in strings] == rank.tolist()
    values = rng.integers(0, 9, 300)
    assert suffix_dedup.previous_smaller(values).tolist() == [max([j for j in range(i) if values[j] < values[i]], default=-1) for i in range(300)]
    with pytest.raises(ValueError):
        suffix_dedup.gram_of(10)


def test_kept_bytes(spark):
    df = spark.createDataFrame([(1, "a" * 60), (2, "b" + "a" * 60 + "c")], "doc_id bigint, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, with_text=True).collect()}
    assert kept == {1: b"a" * 60, 2: b"bc"}
