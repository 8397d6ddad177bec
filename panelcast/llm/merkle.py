"""Merkle manifest of a table: a persistent tree whose tampered versions copy paths and share the rest.

The rows of a group (a language), in the order of their keys, are the leaves of a tree
in which every eight consecutive nodes have one parent; the roots of the groups are the
leaves of one more such tree.  A tree is cut into tiers of aligned blocks of 512 nodes,
three levels high.  A block is built in one piece in one task; its top node is a node of
the next tier, 512 times smaller, which is built in the same way, until every group has
one node left.  No tier is gathered anywhere, and a group of any size is many blocks.

A version of the tree in which one leaf is tampered with shares every node that is not
above this leaf: inside its block it copies the three ancestors, and it continues in
the tiers above with the run of siblings on each level.  These runs are passed down once
per block (a path from the block's top to the root), not once per leaf, and no version
is ever sent upwards, so the topmost block, which lies above all versions, is no hot spot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..session import materialise

FANOUT, CLIMB, HEX = 8, 3, 64
BLOCK = FANOUT ** CLIMB


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)).cast("binary"), 256)


class Block:
    """The levels of an aligned block of nodes; ``levels[0]`` are its nodes, the last level is its top."""

    def __init__(self, nodes: list[str], size: int):
        """``size`` is the number of nodes of the whole group on this tier: a group that fits one block stops at its root."""
        self.levels = [nodes]
        alone = size <= BLOCK
        for _ in range(CLIMB):
            below = self.levels[-1]
            if alone and len(below) == 1:
                break
            self.levels.append([digest("".join(below[i:i + FANOUT])) for i in range(0, len(below), FANOUT)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[str]:
        """For each level below the top: the place in the run and the run's other digests."""
        steps = []
        for level in self.levels[:-1]:
            place = at % FANOUT
            run = level[at - place:at - place + FANOUT]
            steps.append(chr(48 + place) + "".join(run[:place] + run[place + 1:]))
            at //= FANOUT
        return steps


def copied_path(leaf: str, steps: Sequence[str]) -> list[str]:
    """The nodes that a version with this leaf owns, from the leaf to the root; all others are shared."""
    nodes = [leaf]
    for step in steps:
        cut = 1 + HEX * (ord(step[0]) - 48)
        nodes.append(digest(step[1:cut] + nodes[-1] + step[cut:]))
    return nodes


def _blocks(batches: Iterator[pa.RecordBatch], *columns: str):
    """((g, block), rows of ``columns``) of each block; the rows of a block follow each other, over batches too."""
    held_key, held = None, []
    for batch in batches:
        keys = zip(batch.column("g").to_pylist(), batch.column("block").to_pylist(), strict=True)
        for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if key != held_key:
                if held:
                    yield held_key, held
                held_key, held = key, []
            held.append(row)
    if held:
        yield held_key, held


def _batches(names: Sequence[str], schema: pa.Schema, rows: Iterator[tuple], many: int = 2048):
    done: list[tuple] = []
    for row in rows:
        done.append(row)
        if len(done) == many:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], names=list(names))
            done = []
    if done:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], names=list(names))


NODES = pa.schema([("g", pa.int64()), ("rise", pa.int32()), ("idx", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("top", pa.bool_())])
PATHS = pa.schema([("g", pa.int64()), ("idx", pa.int64()), ("subroot", pa.string()), ("path", pa.string())])


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a tier -> the nodes above them inside their blocks."""
    def rows():
        for (g, block), members in _blocks(batches, "size", "digest"):
            size, built = members[0][0], Block([d for _, d in members], members[0][0])
            last = len(built.levels) - 1
            for rise, level in enumerate(built.levels):
                if rise or not last:
                    start = block * BLOCK // FANOUT ** rise
                    for i, d in enumerate(level):
                        yield g, rise, block if rise == last else start + i, -(-size // BLOCK), d, rise == last
    return _batches(NODES.names, NODES, rows())


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of the blocks of a tier, each before its nodes -> paths of the nodes."""
    def rows():
        for (g, _), members in _blocks(batches, "idx", "size", "digest", "path"):
            (_, _, subroot, above), nodes = members[0], members[1:]
            built = Block([n[2] for n in nodes], nodes[0][1])
            for at, (idx, *_) in enumerate(nodes):
                yield g, idx, subroot if subroot is not None else nodes[at][2], " ".join(filter(None, [*built.path(at), above]))
    return _batches(PATHS.names, PATHS, rows())


def _versions(schema: pa.Schema):
    """Paths of the blocks and the leaves of the first tier -> proof and version of every leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, members in _blocks(batches, "id", "size", "digest", "altered", "path"):
                (_, _, subroot, _, above), nodes = members[0], members[1:]
                above = above.split(" ") if above else []
                built = Block([n[2] for n in nodes], nodes[0][1])
                for at, (key, _, leaf, altered, _) in enumerate(nodes):
                    steps = built.path(at) + above
                    nodes_of = copied_path(leaf if altered is None else altered, steps)
                    yield key, leaf, subroot, digest("".join(s[1:] for s in steps)), nodes_of[-1], None if altered is None else nodes_of
        return _batches(schema.names, schema, rows())
    return run


@dataclass(frozen=True)
class Manifest:
    """``tiers``: the nodes that each tier starts from; ``built``: the nodes above them; ``groups``: root of each group."""
    leaves: DataFrame
    built: list[DataFrame]
    groups: DataFrame
    group_tiers: list[DataFrame]
    group_built: list[DataFrame]
    tiers: list[DataFrame]
    root: str | None


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks in one piece each, in order; the number of partitions is left to adaptive execution, so small tiers are few files."""
    rows = rows.withColumn("block", F.expr(f"case when idx < 0 then -idx - 1 else idx div {BLOCK} end"))
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "idx")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """All tiers above ``nodes`` (g, idx, size, digest), at least one, and the nodes built on each."""
    tiers, built = [nodes], []
    while True:
        rows = _dealt(tiers[-1].select("g", "idx", "size", "digest")).mapInArrow(_built, "g bigint, rise int, idx bigint, size bigint, digest string, top boolean")
        built.append(materialise(rows))
        tiers.append(built[-1].where("top").select("g", "idx", "size", "digest"))
        if tiers[-1].where("size > 1").isEmpty():
            return tiers, built


def _headed(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of a tier, each block led by the path of its top (its place -1 - block sorts before all nodes)."""
    heads = paths.select("g", (-F.col("idx") - 1).alias("idx"), F.lit(0).cast("bigint").alias("size"), F.col("subroot").alias("digest"), "path")
    return _dealt(nodes.withColumn("path", F.lit(None).cast("string")).unionByName(heads, allowMissingColumns=True))


def _descend(tiers: Sequence[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths (g, idx, subroot, path) of the last tier's nodes -> those of the first of ``tiers``."""
    for nodes in reversed(tiers[:-1]):
        rows = _headed(nodes.select("g", "idx", "size", "digest"), paths)
        paths = materialise(rows.mapInArrow(_lowered, "g bigint, idx bigint, subroot string, path string"))
    return paths


def _numbered(leaves: DataFrame) -> DataFrame:
    """Place of each leaf in its group: range-partitioned on the whole key, so a hot group is split by the keys after it."""
    keys = ["lang", "id", "leaf", "altered", "_tie"]
    ranges = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    number = F.monotonically_increasing_id()
    placed = materialise(ranges.sortWithinPartitions(*keys).drop("_tie").withColumn("_at", number.bitwiseAND(F.lit((1 << 33) - 1)))
                         .withColumn("_bucket", F.shiftright(number, 33)))
    pieces = materialise(placed.groupBy("_bucket", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")))
    groups = global_rank(pieces.select("lang").distinct(), ["lang"], "g")
    before = Window.partitionBy("lang").orderBy("_bucket")
    pieces = pieces.select("lang", "_bucket", "first", F.sum("n").over(Window.partitionBy("lang")).alias("size"),
                           (F.sum("n").over(before) - F.col("n")).alias("before"))
    named = pieces.join(groups.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang").withColumnsRenamed({"lang": "_lang", "_bucket": "_piece"})
    both = placed.join(named, (F.col("_bucket") == F.col("_piece")) & F.col("lang").eqNullSafe(F.col("_lang")))
    return both.select((F.col("g") - 1).alias("g"), (F.col("before") + F.col("_at") - F.col("first")).alias("idx"), "size", F.col("leaf").alias("digest"), "altered", "id", "lang")


def build(rows: DataFrame, fields: Sequence[str], key: str = "doc_id", group: str = "lang", altered: Mapping[str, Column] | None = None,
          where: Column | None = None) -> Manifest:
    """The tree over ``rows``; where ``where`` holds, a row also has a tampered leaf, with the fields of ``altered`` replaced."""
    values = {f: F.col(f) for f in fields}
    changed = leaf_digest([(altered or {}).get(f, values[f]) for f in fields])
    leaves = rows.select(F.col(key).alias("id"), F.col(group).cast("string").alias("lang"), leaf_digest(list(values.values())).alias("leaf"),
                         (F.when(where, changed) if where is not None else F.lit(None).cast("string")).alias("altered"))
    leaves = materialise(_numbered(materialise(leaves)))  # texts are hashed once: ranges are sampled from the narrow table
    tiers, built = _climb(leaves)
    groups = tiers[-1].select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("idx"), "digest")
    groups = groups.withColumn("size", F.lit(groups.count()).cast("bigint"))
    group_tiers, group_built = _climb(groups)
    top = group_tiers[-1].first()
    return Manifest(leaves, built, groups, group_tiers, group_built, tiers, top.digest if top else None)


def versions(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, proof_sha256, folded_root, copied) of every leaf.

    ``copied`` are the nodes that the tampered leaf's version owns, leaf first and root
    last (null without tampering); every other node of the version is the manifest's.
    """
    roots = manifest.group_tiers[-1].select("g", "idx", F.lit(None).cast("string").alias("subroot"), F.lit("").alias("path"))
    paths = _descend(manifest.group_tiers, roots)
    paths = _descend(manifest.tiers[1:], paths.select(F.col("idx").alias("g"), F.lit(0).cast("bigint").alias("idx"), "subroot", "path"))
    heads = _headed(manifest.leaves.select("g", "idx", "size", "digest", "altered", "id"), paths)
    kind = dict(manifest.leaves.dtypes)["id"]
    empty = manifest.leaves.select("id").limit(0).toArrow().schema.field("id").type
    schema = pa.schema([("id", empty), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")), ("copied", pa.list_(pa.string()))])
    return heads.mapInArrow(_versions(schema), f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string, copied array<string>")


def verified_leaves(rows: DataFrame, fields: Sequence[str], key: str = "doc_id", group: str = "lang", altered: Mapping[str, Column] | None = None,
                    where: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified, n_copied) of every row.

    A leaf is the SHA-256 of the row's framed fields; leaves ascend by key inside a group
    (null keys first, ties by their digests; equal rows are equal leaves).  A null group
    is a group of its own and comes first.  Null fields count as ``-``, empty texts as
    ``0:``.  ``proof_sha256`` hashes the siblings from the leaf's run to the root's.
    Other columns are not looked at; no rows give no rows.
    """
    manifest = build(rows, fields, key, group, altered, where)
    root = F.lit(manifest.root).cast("string")
    out = versions(manifest)
    return out.select(F.col("id").alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"),
                      F.coalesce(F.size("copied"), F.lit(0)).cast("int").alias("n_copied"))


def stored_nodes(manifest: Manifest) -> DataFrame:
    """(lang place, level, idx, digest) of the group trees' nodes above the leaves, the shared part of all versions."""
    out = None
    for tier, built in enumerate(manifest.built):
        inside = built.where("rise > 0").select("g", (F.col("rise") + CLIMB * tier).alias("level"), "idx", "digest")
        out = inside if out is None else out.unionByName(inside)
    return out
