"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that a task works on at a time.
TEXT = 2_000_000


def sliced(batches: Iterator[pa.RecordBatch], text: str, rows: int, room: int = TEXT) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``room`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        at = 0
        while at < len(batch):
            total = np.cumsum(size[at:at + rows])
            many = max(1, int(np.searchsorted(total, room, side="right")))
            yield batch.slice(at, many)
            at += many


def release() -> None:
    """Give the memory of a finished task back: an idle worker that is kept for the next stage holds none of it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each end of an edge can reach.

    Every round hooks each node to its smallest neighbour, follows the hooks to their
    roots by doubling, and contracts the edges, which at least halves the nodes of a
    component; a star or a chain needs one round.  Partial
    minima keep a hub with a third of all edges cheap, each round is a written table,
    and nothing is gathered on the driver.  Loops and null ends are ignored; without
    edges the result is empty.
    """
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null and a != b")
    live, labels = materialise(ends.distinct()), None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        while True:  # double the steps until every node points to the root of its tree
            upper = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialise(hooks.join(upper, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            hooks, settled = jumped.select("node", "up"), jumped.where("moved").isEmpty()
            if settled:
                break
        if labels is None:
            labels = hooks.select(F.col("node").alias("id"), F.col("up").alias("component"))
        else:
            labels = materialise(labels.join(hooks, labels.component == hooks.node, "left")
                                 .select("id", F.coalesce("up", "component").alias("component")))
        upper = hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        live = materialise(live.join(hooks.withColumnRenamed("node", "a"), "a").join(upper, "b").where("up != ub")
                           .select(F.least("up", "ub").alias("a"), F.greatest("up", "ub").alias("b")).distinct())
    return live.select(F.col("a").alias("id"), F.col("b").alias("component")) if labels is None else labels
