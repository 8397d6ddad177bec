"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; (rank + 1/2) / (rows of
the source) spreads every source evenly over [0, 1).  Sorted by that fraction and cut
into equal runs, every shard holds the sources in the proportions of the corpus.
Ranks come from written range partitions, so a source with a third of all rows is
ranked by as many tasks as its rows fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Assign every row to a shard under the law ``rows`` (counts differ by one at most).

    Returns key, source, size (UTF-8 bytes of the text and one more; null text: 1),
    text_crc32, law, shard, slot (gapless from 0 in each shard, interleaved order).
    Null keys, texts and sources are values like others (null source: its own
    stratum, last).  Repeated rows are rows of their own; which of two equal rows gets
    which slot does not matter.  No rows give no rows.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), (F.octet_length(content) + 1).cast("bigint").alias("size"),
                       F.crc32(content.cast("binary")).alias("text_crc32"))
    slim = slim.withColumn("nosource", F.col("source").isNull()).withColumn("mix", F.xxhash64(F.lit(seed), "key", "text_crc32", "size"))
    ranked = global_rank(slim, ["nosource", "source", "mix", "key", "text_crc32", "size"], "place")
    strata = ranked.groupBy("nosource", "source").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    strata = strata.select("start", "n", F.col("source").alias("s"), F.xxhash64(F.lit(seed), "source").alias("turn"))
    ranked = ranked.join(strata, ranked.source.eqNullSafe(strata.s))
    spread = ranked.withColumn("fraction", (F.col("place") - F.col("start") + F.lit(0.5)) / F.col("n"))
    placed = global_rank(spread.select("fraction", "turn", "mix", "key", "source", "text_crc32", "size"),
                         ["fraction", "turn", "mix", "key", "text_crc32", "size"], "place")
    total = docs.count()
    at = F.col("place") - 1
    # exact integers: the shard s begins at ceil(s * total / shards)
    shard = F.expr(f"((place - 1) * {shards}) div {max(total, 1)}")
    begin = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", shard.cast("bigint")).withColumn("slot", (at - begin).cast("bigint"))
            .select(F.col("key").alias(key), "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot"))
