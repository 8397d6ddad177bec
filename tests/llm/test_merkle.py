"""The Merkle manifest against a tree built in plain Python, its versions against trees rebuilt from scratch."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from panelcast.llm import merkle, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, root string, g string"
LOWER = str.maketrans(queries.UPPER, queries.LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return sha("".join(map(framed, (row[0], row[3], row[2], row[4], text))))


def tampered(key):
    return key is not None and zlib.crc32(str(key).encode()) % 3 == 0


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row, each version rebuilt whole."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: r[:3])
        trees[lang] = levels_of([r[2] for r in groups[lang]])
    top = levels_of([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, (_, _, leaf, row) in enumerate(groups[lang]):
            siblings = ""
            for levels, i in ((trees[lang], at), (top, place)):
                for level in levels[:-1]:
                    siblings += "".join(d for j, d in enumerate(level[i - i % 8:i - i % 8 + 8]) if j != i % 8)
                    i //= 8
            changed = leaf_of(row, row[1] and row[1].translate(LOWER)) if tampered(row[0]) else leaf
            nodes = [r[2] for r in groups[lang]]
            nodes[at] = changed
            roots = [trees[other][-1][0] for other in langs]
            roots[place] = levels_of(nodes)[-1][0]
            folded = levels_of(roots)[-1][0]
            out.append((row[0], leaf, trees[lang][-1][0], top[-1][0], sha(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def verified(df):
    changed = {"text": F.translate("text", queries.UPPER, queries.LOWER)}
    rows = merkle.verified_leaves(df, queries.LEAF, altered=changed, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    return rows


def filled(rows):
    return [(*r, len(r[1]) if r[1] is not None else None, "clash", "clash", None) for r in rows]


@pytest.fixture(scope="module")
def odd():
    rows = [(1, "The Cat", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, " \t\n ", "en", "s2"), (None, "No Key", "en", "s2"), (None, None, None, None),
            (7, "Twice", "en", "s1"), (7, "Twice", "en", "s1"), (7, "Another", "en", "s1"), (8, "漢字 É Z", "xx", "s3"), (9, "X" * 200_000, "", "s"), (10, "lone", "é", "s")]
    return filled(rows)


def test_equals_brute_force_on_odd_rows(spark, odd):
    got = verified(spark.createDataFrame(odd, SCHEMA)).drop("n_copied").collect()
    assert sorted(map(tuple, got), key=str) == brute(odd)


@pytest.mark.parametrize("sizes", [(1,), (8, 9), (512, 513, 1), (64, 65, 7, 600)])
def test_equals_brute_force_at_block_borders(spark, sizes):
    rows = filled([(g * 10_000 + i, f"Text {i}", f"l{g}", "s") for g, n in enumerate(sizes) for i in range(n)])
    sample = {r[0] for r in rows[::37]} | {rows[-1][0]}
    got = verified(spark.createDataFrame(rows, SCHEMA)).drop("n_copied").collect()
    assert len(got) == len(rows)
    want = {r[0]: r for r in brute(rows)} if len(rows) < 100 else None
    if want:
        assert {r.doc_id: tuple(r) for r in got} == want
    else:
        langs = sorted({r[2] for r in rows})
        trees = {g: levels_of([leaf_of(r, r[1]) for r in rows if r[2] == g]) for g in langs}
        root = levels_of([trees[g][-1][0] for g in langs])[-1][0]
        for r in got:
            assert r.root == root and r.verified == (not tampered(r.doc_id))
            if r.doc_id in sample:
                lang = langs[r.doc_id // 10_000]
                changed = [leaf_of(x, x[1].translate(LOWER) if x[0] == r.doc_id and tampered(x[0]) else x[1]) for x in rows if x[2] == lang]
                roots = [levels_of(changed)[-1][0] if g == lang else trees[g][-1][0] for g in langs]
                assert r.folded_root == levels_of(roots)[-1][0] and r.subroot == trees[lang][-1][0]


def test_a_version_owns_only_its_path(spark):
    """Shared nodes and copied nodes of a version together are the tree rebuilt with the tampered leaf."""
    rows = filled([(i, f"Text {i}", "en", "s") for i in range(700)])
    changed = {"text": F.translate("text", queries.UPPER, queries.LOWER)}
    manifest = merkle.build(spark.createDataFrame(rows, SCHEMA), queries.LEAF, altered=changed, where=F.col("doc_id") == 600)
    shared = {(r.level, r.idx): r.digest for r in merkle.stored_nodes(manifest).collect()}
    found = {r.id: r for r in merkle.versions(manifest).collect()}
    base = levels_of([leaf_of(r, r[1]) for r in rows])
    assert {(k, i): d for k, level in enumerate(base) for i, d in enumerate(level) if k} == shared
    assert [k for k, r in found.items() if r.copied is not None] == [600]
    version = levels_of([leaf_of(r, r[1].translate(LOWER) if r[0] == 600 else r[1]) for r in rows])
    copied = found[600].copied
    for k, level in enumerate(version):
        for i, d in enumerate(level):
            assert d == (copied[k] if i == 600 // 8 ** k else shared.get((k, i), base[0][i] if not k else None))
    assert len(copied) == len(version) and manifest.root == base[-1][0]


def test_empty_table(spark):
    out = verified(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "leaf", "subroot"]


def test_text_keys_and_plain_rows(spark):
    rows = [("b", "x"), ("a", "y"), (None, "z")]
    got = merkle.verified_leaves(spark.createDataFrame(rows, "name string, lang string"), ["name"], key="name").collect()
    assert {r.name for r in got} == {"a", "b", None} and all(r.verified and r.n_copied == 0 for r in got)
