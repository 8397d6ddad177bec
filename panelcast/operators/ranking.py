"""Positions over a whole table without pulling it through one task.

A plain ``row_number().over(Window.orderBy(...))`` moves every row to a single
partition.  Here the rows are range-partitioned on the full key (so a hot leading
value is split by the columns after it) and written with their partition number.
Rows are numbered inside each sorted partition as they are written and then shifted by
the partition offsets, one row per partition.  Writing them first fixes the partition of every row: Spark
samples the ranges anew whenever it evaluates a range partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def global_rank(df: DataFrame, keys: Sequence[str], name: str, n_buckets: int | None = None,
                weight: str | None = None) -> DataFrame:
    """Add the 1-based position of each row in the order of ``keys``.

    ``keys`` must identify a row (use :func:`sequential_id` for tables with copies).
    With ``weight`` the column is the running total of ``weight`` *before* the row,
    plus one: the first position of a block of ``weight`` rows.
    """
    n_buckets = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n_buckets, *keys)
    if not weight:
        # the low 33 bits of the generated id count the rows of a sorted partition, the others are the partition
        placed = materialise(ranges.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
                             .withColumn("_bucket", F.shiftright("_at", 33).cast("int"))
                             .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1))
    else:
        placed = materialise(ranges.withColumn("_bucket", F.spark_partition_id()))
    size = F.col(weight) if weight else F.lit(1)
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (placed.groupBy("_bucket").agg(F.sum(size).cast("bigint").alias("_n"))
               .select("_bucket", F.coalesce(before, F.lit(0)).alias("_offset")))
    if weight:
        inside = Window.partitionBy("_bucket").orderBy(*keys)
        local = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    else:
        local = F.col("_at")
    return (placed.join(offsets, "_bucket")
            .withColumn(name, (F.col("_offset") + local).cast("bigint")).drop("_bucket", "_offset", "_at"))


#: Rows that a task of :func:`sequential_id` unrolls.
UNROLLED = 500_000


def sequential_id(df: DataFrame, name: str, chunk: int = 10_000) -> DataFrame:
    """Number the rows 1..n.

    Exact copies are counted first, so a row repeated millions of times is one
    weighted row until its block of numbers is unrolled, at most ``chunk`` per
    generator call.  The blocks are few bytes however many rows they stand for, so
    they are dealt by the number of rows: Spark would merge them into one task by size.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    keyed = counted.withColumn("_key", F.xxhash64(*columns))
    start = global_rank(keyed, ["_key", *columns], "_start", weight="_copies")
    blocks = start.select(*columns, "_start", "_copies", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(chunk).cast("bigint"))).alias("_from"))
    total = start.agg(F.sum("_copies")).first()[0] or 0
    blocks = blocks.repartition(max(1, -(-total // UNROLLED)), F.xxhash64("_start", "_from"))
    last = F.least(F.col("_copies"), F.col("_from") + chunk) - 1
    numbers = F.sequence(F.col("_start") + F.col("_from"), F.col("_start") + last)
    return blocks.select(F.explode(numbers).alias(name), *columns)
