"""Document fingerprints: a homomorphic multiset hash of paragraphs, in SQL functions only.

A text is a multiset of paragraphs: lines, cut again after every eighth word so that
a page-long line is not a single element.  Each paragraph is hashed to a wide vector
and the vectors are added, so the order does not matter and paragraphs can be added
to or taken from a stored fingerprint without the rest of the text.  The vector has

* eight words added modulo 2^32, two from each of four passes over the paragraph with
  different seeds (equality; a chance collision has probability 2^-256, but the hash is
  not meant to withstand an adversary), and
* 64 counters modulo 2^32 of hash bits, which with the number of paragraphs are a
  tug-of-war sketch: the squared distance of two sketches estimates how many
  paragraphs differ, whatever they are.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

LANES = 64
SEEDS = (11, 23, 47, 89)
#: Up to eight words and the blanks after them, and the line end if it comes next; covers every character.
PIECE = r"(?:[^ \n]+ ?| ){1,8}\n?|\n"


def pieces(text: Column) -> Column:
    """The paragraphs of a text (null: none)."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), lambda p: p != "")


def sums(piece: str) -> list[Column]:
    """Aggregates over the rows of a document's paragraphs (a null paragraph adds nothing)."""
    h, low, both = F.xxhash64(piece), F.lit(0xFFFFFFFF).cast("bigint"), F.lit(0x0000000100000001).cast("bigint")
    there = lambda x: F.coalesce(F.sum(F.when(F.col(piece).isNotNull(), x)), F.lit(0).cast("bigint"))
    counters = [there(F.shiftrightunsigned(h, bit).bitwiseAND(both)) for bit in range(LANES // 2)]  # of a bit and of the one 32 above
    words = []
    for seed in SEEDS:
        again = F.xxhash64(F.lit(seed), piece)  # the seed first: a pass of its own over the piece
        words += [there(again.bitwiseAND(low)).bitwiseAND(low), there(F.shiftrightunsigned(again, 32)).bitwiseAND(low)]
    return [F.count(piece), *counters, *words]


def _halves(v: Column) -> Column:
    """The vector as numbers modulo 2^32: paragraphs, counters, words."""
    low = F.lit(0xFFFFFFFF).cast("bigint")
    split = F.flatten(F.transform(F.slice(v, 2, LANES // 2), lambda x: F.array(x.bitwiseAND(low), F.shiftrightunsigned(x, 32))))
    return F.concat(F.slice(v, 1, 1), split, F.slice(v, LANES // 2 + 2, 2 * len(SEEDS)))


def to_hex(v: Column) -> Column:
    """Eight hexadecimal digits for each number of the vector."""
    return F.array_join(F.transform(_halves(v), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def from_hex(fingerprint: Column) -> Column:
    """The numbers of a fingerprint, in the layout of its digits."""
    count = 1 + LANES + 2 * len(SEEDS)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)),
                       lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets; with ``sign=-1`` of ``a`` without the paragraphs of ``b``."""
    low = F.lit(0xFFFFFFFF).cast("bigint")
    parts = F.zip_with(from_hex(a), from_hex(b), lambda x, y: (x + sign * y).bitwiseAND(low))
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, about 1 - (paragraphs that differ) / (paragraphs of both), never below 0."""
    return _likeness(from_hex(a), from_hex(b))


def _likeness(x: Column, y: Column) -> Column:
    def signed(v):  # counters of one bits turned into sums of +1 and -1
        return F.transform(F.slice(v, 2, LANES), lambda c: (2 * c - v[0]).cast("double"))
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, c: s + c * c)
    sx, sy = signed(x), signed(y)
    total = norm(sx) + norm(sy)
    apart = norm(F.zip_with(sx, sy, lambda p, q: p - q))
    return (F.when(x == y, 1.0).when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / total))))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every key's paragraphs: the rows of one key are one multiset, null texts are empty."""
    names = [f"s{i}" for i in range(1 + LANES // 2 + 2 * len(SEEDS))]
    rows = docs.select(F.col(key).alias("key"), F.explode_outer(pieces(F.col(text))).alias("piece"))
    rows = rows.groupBy("key").agg(*[c.alias(n) for c, n in zip(sums("piece"), names, strict=True)])
    return rows.select(F.col("key").alias(key), to_hex(F.array(*names)).alias("fingerprint"))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, next_text, bucket, lap, tie) with the text of the next row by ``key``; the last row's next is the first.

    Rows are dealt to buckets of neighbouring keys (cuts from a bounded sketch), and
    the first key of a bucket is also sent to the bucket before it, so one exchange of
    the texts and a window inside buckets give every row its successor.  Equal keys
    are ordered by their text's hash; null keys come last.  Rows of ``lap`` 1 are those copies.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = 4 * partitions(docs.sparkSession)
    cuts = sorted(set(docs.select(F.col(key).cast("double").alias("key")).na.drop().approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n)))
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    deal = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket", handleInvalid="keep")

    def dealt(df):
        return deal.transform(df.withColumn("_key", F.col("key").cast("double"))).withColumn("bucket", F.coalesce(F.col("_bucket").cast("int"), F.lit(len(splits) - 1))).drop("_key", "_bucket")

    first = {r.bucket: r.key for r in dealt(docs.select(F.col(key).alias("key"))).groupBy("bucket").agg(F.min("key").alias("key")).collect()}
    used, kind = sorted(first), dict(rows.dtypes)["key"]
    before = {b: used[i - 1] for i, b in enumerate(used)}  # of the first it is the last: the ring is closed
    lead = F.array(*[F.lit(first.get(b)).cast(kind) for b in range(len(splits))])
    back = F.array(*[F.lit(before.get(b, 0)) for b in range(len(splits))])
    place = F.col("bucket") + 1
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("lap"))
    copy = F.struct(F.element_at(back, place).alias("bucket"), F.lit(1).alias("lap"))
    at = F.when(F.col("key").eqNullSafe(F.element_at(lead, place)), F.array(own, copy)).otherwise(F.array(own))
    sent = dealt(rows).withColumn("at", F.explode(at)).select("key", "text", "at.*", F.xxhash64("text").alias("tie"))
    return sent.withColumn("next_text", F.lead("text").over(ring()))


def ring():
    return Window.partitionBy("bucket").orderBy("lap", F.col("key").asc_nulls_last(), "tie")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    The edited text has its last quarter of code points replaced by as many from the
    start of the next document (see :func:`with_next`; fewer if that is shorter).
    Null texts are empty; one row per input row, repeated rows included; columns of
    ``docs`` other than the two are not looked at; no rows give no rows.
    """
    rows = with_next(docs, key, text)
    n = F.length("text").cast("bigint")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - quarter).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    rows = rows.select("key", "bucket", F.row_number().over(ring()).alias("place"), "lap", "text", edited.alias("edited"))
    rows = rows.select("key", "bucket", "place", "lap", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("body")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("body")))).alias("as"))
    rows = rows.select("key", "bucket", "place", "lap", "n_chars", "edited_sha256", F.col("as.form").alias("form"), F.explode_outer(pieces(F.col("as.body"))).alias("piece"))
    # buckets are already in one place, so neither the sums nor the last window move the rows again
    names = [f"s{i}" for i in range(1 + LANES // 2 + 2 * len(SEEDS))]
    rows = rows.groupBy("bucket", "place", "form", "lap", "key", "n_chars", "edited_sha256").agg(*[c.alias(n) for c, n in zip(sums("piece"), names, strict=True)])
    rows = rows.withColumn("v", F.array(*names)).drop(*names)
    order = Window.partitionBy("bucket").orderBy("place", "form")  # a text, its edited form, the next text
    rows = rows.withColumn("e", F.lead("v", 1).over(order)).withColumn("w", F.lead("v", 2).over(order)).where("lap = 0 and form = 0")
    rows = rows.select("key", "n_chars", "edited_sha256", *[_halves(F.col(c)).alias(c) for c in "vew"])
    hexed = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return rows.select(F.col("key").alias(key), "n_chars", "edited_sha256", hexed("v").alias("fingerprint"), hexed("e").alias("edited_fingerprint"),
                       _likeness(F.col("v"), F.col("e")).alias("near_edited"), _likeness(F.col("v"), F.col("w")).alias("near_next"))
