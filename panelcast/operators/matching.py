"""Fuzzy matching of dirty area names to a reference layer.

Only distinct names are compared.  Close matches (ratio ``INDEXED`` or more) come from
indexes.  Names that differ in at most three letters have a half that differs in at most
one (:func:`_by_halves`), so they meet by an equi-join on half names, one letter left out.
Longer names, and those of crowded halves, share so many pairs of letters that they share
two of the rarest of each (:func:`pairs_needed`): they meet by an equi-join on two rare
ones, within their length bands.

Names without a match that close, and very short ones, are compared in full: both
lists are cut into bounded fragments that meet by an equi-join on the fragment pair
(fragment-and-replicate), so no task ever holds a whole list and no pair leaves a task
unless it is a winner.  Inside a task a letter-count bound skips almost all full
comparisons.  Neither bound underestimates a score, so the result is exact.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import fold_accents, match_key
from ..session import materialise

FRAGMENT = 20_000
#: Ratio from which on the index of letter pairs is used; below it names of usual length need not share any.
INDEXED = 0.9
#: Letter pairs that names must have in common to meet.
SHARED = 2
#: Candidates of one half name from which on its names meet on rare letter pairs instead.
CROWD = 200


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; the order of the arguments matters."""
    return SequenceMatcher(None, a, b).ratio()


def _letter_counts(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts per letter bucket (a bound may merge letters, never split them)."""
    counts = np.zeros((len(names), 64), dtype=np.int32)
    for i, name in enumerate(names):
        for ch in name:
            counts[i, ord(ch) % 64] += 1
    return counts, np.array([len(n) for n in names], dtype=np.int32)


def best_in_fragment(names: pd.DataFrame, layer: pd.DataFrame, cutoff: float, keep: int,
                     candidate_first: bool) -> list[tuple]:
    """The ``keep`` best candidates per name with a ratio of at least ``cutoff``."""
    candidates = layer.sort_values("cand")["cand"].tolist()
    counts, sizes = _letter_counts(candidates)
    out = []
    for key in names["key"].drop_duplicates():
        own, length = _letter_counts([key])
        common = np.minimum(counts, own[0]).sum(axis=1)
        bound = 2.0 * common / np.maximum(sizes + length[0], 1)
        best: list[tuple[float, str]] = []
        for i in np.argsort(-bound, kind="stable"):
            floor = best[-1][0] if len(best) == keep else cutoff
            if bound[i] < max(floor, cutoff):
                break
            cand = candidates[i]
            score = similarity(cand, key) if candidate_first else similarity(key, cand)
            if score >= cutoff:
                best = sorted([*best, (score, cand)], key=lambda t: (-t[0], t[1]))[:keep]
        out += [(key, cand, score) for score, cand in best]
    return out


def pairs_needed(length, cutoff: float):
    """Neighbouring letters that a name of this length shares at least with any name of ratio ``cutoff``.

    Of T letters in both names M match on each side, in k blocks; between two blocks a
    letter is left over, so k <= T - 2 M + 1, and the blocks hold M - k >= 3 M - T - 1
    pairs, with M >= cutoff T / 2.  T is smallest for the shortest partner, which must
    hold the M letters itself.
    """
    return F.ceil(length * (2 / (2 - cutoff)) * (1.5 * cutoff - 1) - 1 - 1e-9)


def letters_apart(letters, cutoff: float):
    """Letters that two names of ratio ``cutoff`` with so many letters in both may leave unmatched at most."""
    return F.floor(letters * (1 - cutoff) + 1e-9)


def _longest(length, cutoff: float):
    """Letters of a name of this length and of its longest possible match."""
    return length + F.floor(length * (2 - cutoff) / cutoff + 1e-9)


def _close(m: str, n: str, cutoff: float):
    """Lengths that allow a ratio of ``cutoff``."""
    return 2 * F.least(m, n) >= cutoff * (F.col(m) + F.col(n)) - 1e-9


def _code(kind: str, half, text):
    return F.xxhash64(F.lit(kind), half, text)


def _without_one(kind: str, half, text):
    """Codes of a text with one letter left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.transform(F.array_distinct(cut), lambda t: _code(kind, half, t))


def _half_codes(length, start, end, cutoff: float):
    """Codes of one candidate's halves, whole and with one letter left out where a match may leave two unmatched."""
    loose = letters_apart(_longest(length, cutoff), cutoff) >= 2
    codes = [F.array(_code(side + "=", F.length(text), text)) for side, text in (("s", start), ("e", end))]
    cut = [_without_one(side + "-", F.length(text), text) for side, text in (("s", start), ("e", end))]
    return F.flatten(F.array(*codes, F.when(loose, F.flatten(F.array(*cut))).otherwise(F.array().cast("array<bigint>"))))


def _by_halves(names: DataFrame, layer: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``key, cand`` of names that differ in at most three letters, and the names of crowded halves.

    The matched letters of two names are a common subsequence.  Cut the candidate in the
    middle and the key where the subsequence passes it: of three unmatched letters one of
    the halves has at most one.  Both ends of a name are fixed, so that half is equal to a
    head or tail of the key, of the same length, or after one letter is left out of either.
    Pairs that meet in crowded halves only are left to the caller: a half that more than
    ``CROWD`` candidates share would let them all meet.
    """
    length = F.length("cand")
    near = letters_apart(length + F.ceil(length * cutoff / (2 - cutoff) - 1e-9), cutoff) <= 3
    halves = layer.where((length > 1) & near).withColumns({
        "n": length, "start": F.substring("cand", F.lit(1), F.floor(length / 2).cast("int")), "end": F.expr("substring(cand, CAST(floor(length(cand) / 2) AS INT) + 1)")})
    b = materialise(halves.select("cand", "n", F.explode(F.array_distinct(_half_codes(F.col("n"), F.col("start"), F.col("end"), cutoff))).alias("code")))
    # lengths of the layer whose names may be as close: bounded, as longer names leave more letters unmatched
    sizes = [r["n"] for r in b.select("n").distinct().collect()]
    wanted = F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>"), lambda n: 2 * F.least(n, F.col("m")) >= cutoff * (n + F.col("m")) - 1e-9)

    def tried(side: str, half, part):
        """Codes that a key may share with a half of this length; ``part(k)`` is its head or tail of k letters."""
        loose = letters_apart(_longest(F.col("m"), cutoff), cutoff) >= 2
        more = F.concat(F.array(_code(side + "-", half, part(half - 1))), _without_one(side + "=", half, part(half + 1)))
        return F.concat(F.array(_code(side + "=", half, part(half))), F.when(loose, more).otherwise(F.array().cast("array<bigint>")))

    def head(k):
        return F.substring("key", F.lit(1), k)

    def tail(k):
        return F.substring(F.col("key"), F.greatest(F.col("m") - k + 1, F.lit(1)), k)

    heads = F.array_distinct(F.transform("wanted", lambda n: F.floor(n / 2).cast("int")))
    tails = F.array_distinct(F.transform("wanted", lambda n: n - F.floor(n / 2).cast("int")))
    codes = F.concat(F.flatten(F.transform(heads, lambda h: tried("s", h, head))), F.flatten(F.transform(tails, lambda h: tried("e", h, tail))))
    keys = names.withColumn("m", F.length("key")).withColumn("wanted", wanted)
    a = materialise(keys.select("key", "m", F.explode(F.array_distinct(codes)).alias("code")))
    crowds = materialise(b.groupBy("code").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > CROWD).select("code"))
    # every pair passes a distinct: few letters apart is checked before
    apart = F.levenshtein("key", "cand", 3) >= 0
    pairs = (a.join(crowds, "code", "left_anti").join(b, "code").where(_close("m", "n", cutoff) & apart)
             .select("key", "cand").distinct())
    return pairs, a.join(crowds, "code", "left_semi").select("key").distinct(), b.join(crowds, "code", "left_semi").select("cand").distinct()


def _indexed(names: DataFrame, layer: DataFrame, cutoff: float, candidate_first: bool) -> DataFrame:
    """``key, cand, score`` of all pairs of at least ``cutoff``; every key must need ``SHARED`` pairs of letters."""
    pairs, keys, cands = _by_halves(names, layer, cutoff)
    # pairs of four letters apart: of two long names; the others again where their half is crowded
    far = [letters_apart(_longest(F.length(c), cutoff), cutoff) > 3 for c in ("key", "cand")]
    some = [materialise(x.where(f).unionByName(y).distinct()) for x, f, y in ((names, far[0], keys), (layer, far[1], cands))]
    if not (some[0].isEmpty() or some[1].isEmpty()):
        pairs = pairs.unionByName(_by_rare_pairs(*some, cutoff)).distinct()
    sides = ("cand", "key") if candidate_first else ("key", "cand")
    return pairs.withColumn("score", _pair_ratio(*sides)).where(F.col("score") >= cutoff)


def _by_rare_pairs(names: DataFrame, layer: DataFrame, cutoff: float) -> DataFrame:
    """Pairs ``key, cand`` that share so many pairs of letters as a ratio of ``cutoff`` needs.

    With the letter pairs of a name ordered from the rarest on, two names that share n of
    them share ``SHARED`` of their first size - n + ``SHARED``: names meet on combinations of those.
    """
    both = names.select(F.col("key").alias("name"), F.lit(True).alias("left")).unionByName(layer.select(F.col("cand").alias("name"), F.lit(False).alias("left")))
    both = both.where(F.length("name") > 1).withColumn("two", F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substring("name", i, F.lit(2))))
    # the second "an" of a name is another one than its first
    numbered = F.transform("two", lambda g, i: F.concat(g, F.size(F.filter(F.slice("two", F.lit(1), i + 1), lambda x: x == g)).cast("string")))
    both = materialise(both.select("left", "name", F.explode(numbered).alias("gram")))
    often = both.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = both.join(often, "gram").groupBy("left", "name").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    length = F.length("name")
    first = F.slice("grams", F.lit(1), F.least(F.size("grams"), F.size("grams") - pairs_needed(length, cutoff).cast("int") + SHARED))
    ranked = ranked.select("left", "name", length.alias("size"), F.transform(first, lambda g: g["gram"]).alias("first"))
    twos = F.flatten(F.transform("first", lambda x, i: F.transform(F.slice("first", i + 2, F.size("first")), lambda y: F.concat(x, y))))
    index = ranked.select("left", "name", "size", F.explode(twos).alias("gram"))
    a = index.where("left").select("gram", F.col("name").alias("key"), F.col("size").alias("m"))
    b = index.where("not left").select("gram", F.col("name").alias("cand"), F.col("size").alias("n"))
    return a.join(b, "gram").where(_close("m", "n", cutoff)).select("key", "cand").distinct()


def _best(scored: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), "cand")
    return scored.select("key", "cand", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def score_names(names: DataFrame, layer: DataFrame, cutoff: float, keep: int = 1,
                candidate_first: bool = False) -> DataFrame:
    """``key, cand, score, rank``: best candidates of each distinct ``key``.

    ``names`` has one string column, ``layer`` too.  Ties go to the smaller name.
    """
    names = materialise(names.toDF("key").where("key is not null and key <> ''").distinct())
    layer = materialise(layer.toDF("cand").where("cand is not null").distinct())
    high = max(cutoff, INDEXED)
    long = names.where(pairs_needed(F.length("key"), high) >= SHARED)
    hits = materialise(_best(_indexed(long, layer, high, candidate_first), keep))
    # below the index's ratio only names that have all their matches above it are settled
    settled = long if cutoff >= high else hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= keep).select("key")
    rest = score_in_fragments(names.join(settled, "key", "left_anti"), layer, cutoff, keep, candidate_first)
    return hits.join(settled, "key", "left_semi").unionByName(rest)


def score_in_fragments(names: DataFrame, layer: DataFrame, cutoff: float, keep: int, candidate_first: bool) -> DataFrame:
    """:func:`score_names` by comparing every name with every candidate (``key`` and ``cand`` distinct)."""
    rows = names.count()
    if not rows:  # nothing to compare: the layer need not move
        return names.select("key", F.lit("").alias("cand"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where(F.lit(False))
    slots = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_left = max(1, min(slots, rows), -(-rows // FRAGMENT))
    n_right = max(1, -(-layer.count() // FRAGMENT))
    left = (names.withColumn("_l", F.pmod(F.xxhash64("key"), F.lit(n_left)))
            .withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))))
    right = (layer.withColumn("_r", F.pmod(F.xxhash64("cand"), F.lit(n_right)).cast("int"))
             .withColumn("_l", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_left - 1).cast("bigint")))))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = best_in_fragment(a, b, cutoff, keep, candidate_first) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["key", "cand", "score"]).astype({"key": str, "cand": str, "score": float})

    hits = (left.groupBy("_l", "_r").cogroup(right.groupBy("_l", "_r"))
            .applyInPandas(compare, "key string, cand string, score double"))
    return _best(hits, keep)


def unmatched_names(cases: DataFrame, layer: DataFrame, key: str = "health_area") -> DataFrame:
    """Names of the case table that the layer does not have."""
    return cases.select(key).distinct().join(layer.select(key).distinct(), key, "left_anti")


def unmatched_report(cases: DataFrame, layer: DataFrame, key: str = "health_area", cutoff: float = 0.7) -> DataFrame:
    """Unmatched names with the closest layer name as a suggestion (null when none is close)."""
    missing = unmatched_names(cases, layer, key)
    best = score_names(missing, layer.select(key), cutoff, candidate_first=True)
    return missing.join(best.select(F.col("key").alias(key), F.col("cand").alias("suggestion"), "score"), key, "left")


def match_areas(df: DataFrame, column: str, layer: DataFrame, layer_key: str = "health_area",
                threshold: float = 70) -> DataFrame:
    """Add ``health_area``: the layer name most similar to ``column``, null below ``threshold``."""
    mapping = best_matches(df, column, layer, layer_key, threshold)
    return df.drop("health_area" if column != "health_area" else "").join(
        mapping.select(F.col("raw_name").alias(column), F.col("health_area").alias("_area")), column, "left") \
        .withColumn("health_area", F.col("_area")).drop("_area")


def _plain(name):
    """Accent-free lower case with hyphens and underscores as blanks."""
    return F.translate(fold_accents(F.trim(name)), "-_", "  ")


def best_matches(df: DataFrame, column: str, layer: DataFrame, layer_key: str = "health_area",
                 threshold: float = 70) -> DataFrame:
    """``raw_name, health_area, score`` for each distinct raw name."""
    raw = df.select(F.col(column).cast("string").alias("raw_name")).distinct().withColumn("_key", _plain("raw_name"))
    names = (layer.select(F.col(layer_key).alias("_area")).distinct().withColumn("_cand", _plain("_area"))
             .groupBy("_cand").agg(F.min("_area").alias("_area")))
    scored = score_names(raw.select("_key"), names.select("_cand"), threshold / 100)
    found = (scored.join(names, scored["cand"] == names["_cand"])
             .select(F.col("key").alias("_key"), F.col("_area").alias("health_area"), (F.col("score") * 100).alias("score")))
    return raw.join(found, "_key", "left").drop("_key")


def match_counts(mapping: DataFrame) -> DataFrame:
    """How many distinct names were recognised."""
    hit = F.col("health_area").isNotNull()
    return mapping.agg(F.count(F.lit(1)).alias("n_names"), F.count_if(hit).alias("n_matched"),
                       F.count_if(~hit).alias("n_unmatched"))


@F.pandas_udf(DoubleType())
def _pair_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def build_auto_health_area_mapping(layer: DataFrame, cases: DataFrame, cutoff: float = 0.90,
                                   key: str = "health_area", margin: float = 0.05) -> DataFrame:
    """Conservative mapping ``raw_name -> health_area`` for names the layer lacks.

    Five closest normal forms, then on the raw strings: ratio at least ``cutoff``,
    the same first four letters, lengths within two, and a lead of ``margin`` over
    the runner-up.
    """
    missing = unmatched_names(cases, layer, key).select(F.col(key).alias("raw_name"), match_key(F.col(key)).alias("_key"))
    real = layer.select(F.col(key).alias("_real")).distinct().withColumn("_cand", match_key("_real"))
    close = score_names(missing.select("_key"), real.select("_cand"), cutoff, keep=5, candidate_first=True)
    pairs = (missing.join(close.select(F.col("key").alias("_key"), F.col("cand").alias("_cand")), "_key")
             .join(real, "_cand"))
    prefix = F.least(F.length("raw_name"), F.length("_real"), F.lit(4))
    strict = ((F.substring("raw_name", 1, 4).substr(F.lit(1), prefix) == F.substring("_real", 1, 4).substr(F.lit(1), prefix))
              & (F.abs(F.length("raw_name") - F.length("_real")) <= 2))
    scored = pairs.where(strict).withColumn("score", _pair_ratio("raw_name", "_real")).where(F.col("score") >= cutoff)
    order = Window.partitionBy("raw_name").orderBy(F.desc("score"), "_real")
    ranked = scored.withColumns({"_rank": F.row_number().over(order), "_next": F.lead("score").over(order)})
    lead = F.col("score") - F.coalesce("_next", F.lit(0.0))
    return ranked.where((F.col("_rank") == 1) & (lead >= margin)).select(
        "raw_name", F.col("_real").alias("health_area"), "score")


def apply_mapping(cases: DataFrame, mapping: DataFrame, key: str = "health_area") -> DataFrame:
    """Replace mapped names, keep the others."""
    pairs = mapping.select(F.col("raw_name").alias(key), F.col("health_area").alias("_to"))
    return cases.join(pairs, key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to")


def layer_fingerprint(layer: DataFrame, key: str = "health_area") -> DataFrame:
    """12 hex digits that identify the set of areas of a layer (cache key).

    Names are dealt to 4096 buckets by the head of their hash, each bucket's sorted
    names are digested, and the number of names and the sorted digests make the key.
    """
    names = layer.select(F.lower(F.trim(F.col(key).cast("string"))).alias("_name")).where("_name is not null").distinct()
    digests = names.groupBy(F.substring(F.sha1("_name"), 1, 3).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.sha1(F.concat_ws("|", F.array_sort(F.collect_list("_name")))).alias("_d"))
    text = F.concat_ws("|", F.coalesce(F.sum("_n"), F.lit(0)).cast("string"), F.concat_ws("|", F.array_sort(F.collect_list("_d"))))
    return digests.agg(F.substring(F.sha1(text), 1, 12).alias("fingerprint"))
