"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The mixture is a number of blocks of equal tokens.  Blocks are allocated to sources
by the highest quotients target / (2 k + 1), which gives every source an integer
quota, and every shard too, since the quotients of a larger house only add seats.
Only quotients near the last seat are listed: with ``n`` sources the divisor rounds
by n/2 seats at most, so a source's seats lie between round(p (m - n/2)) and
round(p (m + n/2)), together about 2 n candidates instead of one for each block.

Each source's documents, in seeded order, form one stream of tokens cut into blocks.
The blocks in the order of selection are those from a seeded block on, round and round.
Every shard takes its quota of them, one shard after the other (the stream is shuffled
already, so a run of it is a random selection and cuts two documents at most); all shards
together take every block as often as the quotas go round the stream, and the rest once more.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..session import materialise
from .common import WORD

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
BLOCK = 16


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size) -> with weight and target, one row per source.

    Sources by code point, null last, take the weights in turn and share ``share``
    times all tokens; a target stops at ``ceiling`` times its source's size and the
    excess goes to the others by weight.  With the sources ordered by the level at
    which they are full, the common level follows from running sums.  Windows without
    a partition run on one row per source here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    full = F.col("weight") * 0 + ceiling * F.col("source_size")
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
            .withColumn("cap", full)
            .withColumn("total", share * F.sum("source_size").over(everything))
            .withColumn("spent", F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
            .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
            .withColumn("level", (F.col("total") - F.col("spent")) / F.col("left")))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    rows = rows.withColumn("water", F.max(fits).over(everything))
    return rows.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), "cap")).alias("target"))


def shard_quotas(targets: DataFrame, shards: int = 8, block: int = BLOCK) -> DataFrame:
    """(source, source_size, weight, target) -> with blocks, shard, seats, quota: one row per source and shard.

    ``seats`` are the source's blocks in the shards up to this one, ``quota`` those of this shard.
    """
    everything = Window.partitionBy(F.lit(0))
    rows = (targets.withColumn("blocks", F.ceil(F.col("source_size") / block))
            .withColumn("n", F.count(F.lit(1)).over(everything)).withColumn("sum", F.sum("target").over(everything)))
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    house = F.floor(F.floor(F.col("sum") / block) * (F.col("shard") + 1) / shards)
    part = F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0)
    most = (CEILING * F.col("blocks")).cast("bigint")
    rows = rows.withColumn("house", house)
    rows = rows.withColumn("low", F.least(most, F.greatest(F.lit(0), F.floor(part * (F.col("house") - F.col("n") / 2) + 0.5))))
    rows = rows.withColumn("high", F.least(most, F.greatest(F.col("low"), F.ceil(part * (F.col("house") + F.col("n") / 2) + 0.5))))
    rows = rows.withColumn("open", F.col("house") - F.sum("low").over(Window.partitionBy("shard")))
    seats = rows.where("high > low").withColumn("k", F.explode(F.sequence("low", F.col("high") - 1)))
    order = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last())
    won = seats.withColumn("r", F.row_number().over(order)).where("r <= open").groupBy("shard", F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("won"))
    won = won.withColumnRenamed("shard", "h")
    rows = rows.join(won, (rows.shard == won.h) & rows.source.eqNullSafe(won.s), "left")
    rows = rows.withColumn("seats", F.col("low") + F.coalesce("won", F.lit(0)))
    before = F.lag("seats", 1, 0).over(Window.partitionBy("source").orderBy("shard"))
    return rows.withColumn("quota", F.col("seats") - before).select("source", "source_size", "weight", "target", "blocks", "shard", "seats", "quota")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        shards: int = 8, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """What the mixture takes of every document.

    Returns key, source, ``text_hash`` (tells apart rows of one key), size (words),
    source_size, target, taken (words, repeats counted), passes (whole copies), and
    ``first``/``words``: the run of words taken once more (0 words: none; a run may go
    past the end of the stream and come back, then it is the document's last words and
    its first ones, ``words2`` of them), and ``shards``: the words that each shard takes of
    it, an array of (shard, words) in the order of shards, shards without any left out.  Null texts have size 0 and nothing is taken
    of them; null sources are one source; repeated rows count each; null keys are
    values like others; no rows give no rows.  Reruns agree: order and start depend on
    the seed and the row alone.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                       F.xxhash64(F.col(text)).alias("text_hash"))
    slim = slim.withColumn("nosource", F.col("source").isNull()).withColumn("mix", F.xxhash64(F.lit(seed), "key", "text_hash"))
    order = ["nosource", "source", "mix", "key", "text_hash", "size"]
    placed = materialise(global_rank(slim, order, "at", weight="size"))
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("at").alias("begin"))
    quotas = shard_quotas(source_targets(sources.select("source", "source_size"), weights, share), shards, block)
    seats = F.transform(F.array_sort(F.collect_list(F.struct("shard", "seats"))), lambda x: x["seats"])
    whole = quotas.groupBy("source", "source_size", "target", "blocks").agg(F.max("seats").alias("seats"), seats.alias("upto"))
    begin = sources.select(F.col("source").alias("s"), "begin")
    plan = whole.join(begin, whole.source.eqNullSafe(begin.s)).select(
        F.col("source").alias("s"), "source_size", "target", "blocks", "begin", "upto", F.col("seats").alias("quota"))
    many = F.greatest("blocks", F.lit(1))
    plan = plan.withColumn("passes", F.expr("quota div greatest(blocks, 1)")).withColumn("rest", F.col("quota") - F.col("passes") * F.col("blocks"))
    plan = materialise(plan.withColumn("from", F.pmod(F.xxhash64(F.lit(seed), "s"), many)))
    rows = placed.join(plan, placed.source.eqNullSafe(plan.s))
    a, b = F.col("at") - F.col("begin"), F.col("at") - F.col("begin") + F.col("size")
    lo, hi, turn = F.col("from") * block, (F.col("from") + F.col("rest")) * block, F.col("blocks") * block
    none = F.lit(0).cast("bigint")
    rows = rows.withColumn("first", F.greatest(none, lo - a)).withColumn("words", F.greatest(none, F.least(b, hi) - F.greatest(a, lo)))
    rows = rows.withColumn("words2", F.greatest(none, F.least(b, hi - turn) - a))
    taken = F.col("passes") * F.col("size") + F.col("words") + F.col("words2")
    # a shard's blocks are a run of the stream laid out from the first selected block on, where a document comes once a turn
    rows = rows.withColumn("away", a - lo).withColumn("turn", turn)
    start = lambda h: F.when(h > 0, F.element_at("upto", F.greatest(h, F.lit(1)))).otherwise(none) * block
    stop = lambda h: F.element_at("upto", h + 1) * block
    met = lambda h: sum((F.greatest(none, F.least(F.col("away") + t * F.col("turn") + F.col("size"), stop(h)) - F.greatest(F.col("away") + t * F.col("turn"), start(h)))
                         for t in range(math.ceil(CEILING) + 2)), none)
    parts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda h: F.struct(h.alias("shard"), met(h).alias("words")))
    parts = F.filter(parts, lambda x: x["words"] > 0).alias("shards")
    return rows.select(F.col("key").alias(key), "source", "text_hash", "size", "source_size", "target", taken.alias("taken"), "passes", "first", "words", "words2", parts)


def apply_mixture(docs: DataFrame, taken: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of a mixture: whole copies as they are, and the runs that a quota cuts, their words joined by blanks."""
    whole = (F.col("words") >= F.col("size")) & (F.col("size") > 0)
    none = F.expr("cast(array() as array<struct<start: bigint, n: bigint>>)")
    cut = lambda start, n: F.when((n > 0) & ~whole, F.array(F.struct(start.alias("start"), n.alias("n"))))
    runs = F.concat(F.coalesce(cut(F.col("first"), F.col("words")), none), F.coalesce(cut(F.lit(0).cast("bigint"), F.col("words2")), none))
    plan = (taken.where("size > 0").groupBy(F.col(key).alias("k"), F.col(source).alias("s"), "text_hash")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("passes") + whole.cast("int")).alias("copies"),
                 F.flatten(F.collect_list(runs)).alias("runs"))  # a quota cuts two documents of a source at most
            .where("copies > 0 or size(runs) > 0"))
    named = docs.select(*[F.col(c).alias(f"doc_{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    rows = named.withColumn("h", F.xxhash64(F.col(at[text])))
    rows = rows.join(plan, F.col(at[key]).eqNullSafe(F.col("k")) & F.col(at[source]).eqNullSafe(F.col("s")) & (F.col("h") == F.col("text_hash")))
    # repeated rows share one plan: keep one of them and give it the copies of all
    rows = rows.where("n_rows = 1").unionByName(rows.where("n_rows > 1").dropDuplicates(["k", "s", "h"]))
    words = F.regexp_extract_all(F.col(at[text]), F.lit(WORD), F.lit(0))
    full = F.array_repeat(F.col(at[text]), F.col("copies").cast("int"))
    cuts = F.transform("runs", lambda r: F.array_join(F.slice(words, (r["start"] + 1).cast("int"), r["n"].cast("int")), " "))
    rows = rows.withColumn("part", F.explode(F.when(F.size("runs") > 0, F.concat(full, cuts)).otherwise(full)))
    out = {text: F.col("part").alias(text)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("part").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars")
    return rows.select(*[out.get(c, F.col(at[c]).alias(c)) for c in docs.columns])
