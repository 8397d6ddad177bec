"""From raw documents to encoded ones: drop toxic and poor documents, keep one of each near-duplicate group, mix sources, encode.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and works on
all that its predecessor kept; what it returns is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import minhash, mixing, quality, queries, sentencepiece_nbest, toxicity
from panelcast.llm.common import table
from panelcast.session import materialise

#: Near duplicates in the pipeline: five words, likeness of at least 0.8.
WORDS, PERCENT = 5, 80
#: The rows of a stage cannot be told in SQL (trained models, language model); tests compare stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score="_score", predicted="_toxic").where("_toxic = 0").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, score="_score", predicted="_good").where("_good = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, and one row of a repeated key; rows without a key all stay."""
    classes = materialise(minhash.near_duplicates(docs, k=WORDS, percent=PERCENT))
    gone = materialise(classes.where("not kept").select("doc_id").distinct())
    again = materialise(classes.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti")
    one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").unionByName(one).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mixture(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation, scores and ids of the four best, and the text that the ids decode to."""
    model = public_tokenizers.path(queries.PIECES)
    rows = sentencepiece_nbest.encode(docs, model, n=4, decoded="decoded")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.element_at("scores", 1).alias("score"), "scores", "nbest", "decoded")


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", near_dedup), ("mixing", mix_sources), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
