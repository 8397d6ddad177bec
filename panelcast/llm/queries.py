"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fingerprints, merkle, minhash, mixing, quality, sentencepiece_nbest, sharding, suffix_dedup, token_counts, token_files, toxicity, vector_codes
from .common import table
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def query(function):
    QUERIES[function.__name__] = function
    return function


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text modulo ``by``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


@query
def op1_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


@query
def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from labels outside the held-out fold."""
    return toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))


@query
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op4_sentencepiece(spark, sf_dir):
    return sentencepiece_nbest.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), n=4)


@query
def op5_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query
def op6_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Forest:
    """Learned from labels outside the held-out fold."""
    return quality.fit(docs, labels.where(remainder("doc_id", 3) != 1))


@query
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op8_token_files(spark, sf_dir):
    path = token_files.new_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))
    return token_files.token_index(token_files.read_tokens(spark, path))


@query
def op9_sharding(spark, sf_dir):
    rows = sharding.interleaved_shards(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@query
def op10_mixing(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "shards")


#: Fields of a document's leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op11_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.verified_leaves(table(spark, sf_dir, "documents"), LEAF, altered={"text": F.translate("text", UPPER, LOWER)}, where=tampered)
    return rows.drop("n_copied")


@query
def op12_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


@query
def op13_vector_codes(spark, sf_dir):
    return vector_codes.coded_vectors(table(spark, sf_dir, "embeddings"))


def register_pipeline() -> None:
    """Add the pipeline of the repository's top folder."""
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
