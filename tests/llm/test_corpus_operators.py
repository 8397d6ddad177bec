"""Corpus operators against brute force on small tables, and their edge cases."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelcast.llm import embedding_dedup, fingerprints, lattice, minhash, mixing, quality, queries, sentencepiece_nbest, sharding, token_counts, token_files, toxicity
from panelcast.llm.common import connected_components

PIECES, WORD_BPE = public_tokenizers.path(queries.PIECES), public_tokenizers.path(queries.WORD_BPE)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, id string, a string, key string"


def lorem(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("aeioulnrst"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    rows = [(1, "The cat.\nThe dog", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, " \t\n ", "en", "s2"), (None, "no key at all", None, "s2"),
            (5, "x" * 6_000, "en", "s2"), (6, lorem(5_000, 1), "en", None), (7, "The cat.\nThe dog", "en", "s1"), (7, "The cat.\nThe dog", "en", "s1"),
            (8, "漢字 é ▁ \U0001F600 a  b", "xx", "s3"), (9, "one", "en", "s1")]
    full = [(*r, len(r[1]) if r[1] else None, "score", "id", "a", None) for r in rows]
    return spark.createDataFrame(full, SCHEMA), full


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (5, 4), (3, 1), (None, 4)] + [(100, i) for i in range(101, 150)] + [(i, i + 1) for i in range(200, 260)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {found[1], found[2], found[3]} == {1} and {found[7], found[8], found[9]} == {7} and found[5] == 4 and found[149] == 100 and found[260] == 200
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16))
    for i in range(60):  # pairs and chains around the threshold
        x[i + 100] = x[i] + rng.standard_normal(16) * rng.uniform(0.02, 0.12) * np.linalg.norm(x[i])
    x[300:340] = x[7] + rng.standard_normal((40, 16)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, x[0, :8].tolist()), (905, [None] * 16), (None, x[0].tolist())]
    out = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), miss=1e-9).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = list(range(400))
    for _ in range(400):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(400)]
        if new == root:
            break
        root = new
    for i in range(400):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (near[i].sum(), root[i], root[i] == i)
    assert all(out[i].n_links == 0 and out[i].kept for i in (900, 901, 902, 903, 904, 905, None)) and len(out) == 407
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def classes_of_vectors(x, threshold=0.95):
    """Number of links and smallest member of the component, by brute force."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], *root[row]) if (row := np.flatnonzero(near[i])).size else root[i] for i in range(len(x))])
        if (new == root).all():
            return near.sum(1), root
        root = new


def test_neighbour_windows_equal_all_pairs():
    """Rows within the window, or within a run that is not too long, whose signs differ little enough."""
    rng = np.random.default_rng(2)
    run = np.sort(np.concatenate([rng.integers(0, 1 << 62, 150), (5 << 56) + rng.integers(0, 1 << 55, 60), (9 << 56) + rng.integers(0, 1 << 55, 20)]))
    more = rng.integers(0, 1 << 62, len(run))
    more[1::3] = more[:-1:3] ^ 5
    lead, n = run >> 55, len(run)
    length = np.array([(lead == k).sum() for k in lead])
    differ = lambda a, b: int(np.bitwise_count(a ^ b))
    hit = np.zeros(n, bool)
    for i in range(n):
        for j in range(i + 1, n):
            same = lead[i] == lead[j]
            close = differ(run[i], run[j]) <= 26 and differ(run[i], run[j]) + differ(more[i], more[j]) <= 45
            if close and (j - i <= 4 or same and length[i] <= 30) and not (same and length[i] > 30):
                hit[[i, j]] = True
    got, crowded = embedding_dedup._neighbours(run, more, lead, 4, 30, 26, 45)
    assert got.tolist() == hit.tolist() and crowded.tolist() == (length > 30).tolist() and 0 < hit.sum() < n


def test_signs_apart_keeps_all_but_the_blur():
    rng = np.random.default_rng(3)
    differing = (rng.random((200_000, 124)) < math.acos(0.95) / math.pi).sum(1)
    assert (differing > embedding_dedup.signs_apart(0.95, 124)).mean() < 2 * embedding_dedup.BLUR
    assert embedding_dedup.signs_apart(1.0, 62) == 0 and embedding_dedup.signs_apart(-1.0, 62) == 62


@pytest.mark.parametrize("crowd", [1024, 50])
def test_crowded_vectors_lose_no_link(spark, monkeypatch, crowd):
    """A third of the rows in a cone of mutual cosine 0.9, pairs at 0.952 in it, and a vector that many rows share."""
    monkeypatch.setattr(embedding_dedup, "CROWD", crowd, raising=False)
    rng = np.random.default_rng(8)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    middle, x = unit(rng.standard_normal(64)), unit(rng.standard_normal((3000, 64)))
    own = lambda k: unit((e := rng.standard_normal((k, 64))) - np.outer(e @ middle, middle))
    apart = own(900)
    x[:900] = math.sqrt(0.9) * middle + math.sqrt(0.1) * apart
    c = (0.952 - 0.9) / 0.1  # of the parts beside the middle
    noise = own(100)
    beside = unit(noise - np.sum(noise * apart[:100], 1, keepdims=True) * apart[:100])
    x[900:1000] = math.sqrt(0.9) * middle + math.sqrt(0.1) * (c * apart[:100] + math.sqrt(1 - c * c) * beside)
    x[2000:2200] = x[1500]
    links, root = classes_of_vectors(x)
    assert (links[900:1000] > 0).sum() > 90 and (links > 100).sum() == 201
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = {r.vec_id: r for r in embedding_dedup.near_vectors(frame, window=4).collect()}
    assert [(out[i].n_links, out[i].component_id) for i in range(3000)] == list(zip(links.tolist(), root.tolist(), strict=True))


@pytest.fixture(scope="module")
def pieces():
    return lattice.load(PIECES)


@pytest.fixture(scope="module")
def reference():
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    return SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.mark.parametrize("text", ["hello world", "the thing of", "Ntbleor thha eaouble", "  two  blanks ", "a", "erenbleou thntatwh"])
def test_nbest_equals_library(pieces, reference, text):
    ids, best = sentencepiece_nbest.encode_texts([text], 4, pieces)[0]
    score = lambda ids: sum(pieces.scores[i] for i in ids)
    theirs = [score(x) for x in reference.nbest_encode_as_ids(text, 4)]
    assert [s for s, _ in best] == pytest.approx(theirs) and [score(x) for _, x in best] == pytest.approx(theirs)
    assert len({tuple(x) for _, x in best}) == len(best) and list(ids) == list(best[0][1])
    assert sentencepiece_nbest.decode_ids(ids, pieces) == text


def test_nbest_equals_all_segmentations(pieces):
    text = "▁thend"
    def walk(at):
        if at == 0:
            yield 0.0
        for start, _, s in sentencepiece_nbest.arcs_into(text, at, pieces) if at else ():
            yield from (x + s for x in walk(start))
    every = sorted(walk(len(text)), reverse=True)
    assert [s for s, _ in sentencepiece_nbest.n_best(text, 6, pieces)] == every[:6]


def test_encoding_and_counts_of_odd_texts(spark, odd, none, pieces):
    df, rows = odd
    out = sentencepiece_nbest.decode(sentencepiece_nbest.encode(df, PIECES, n=3), PIECES).collect()
    texts = sorted((r[1] or "").replace("▁", " ") for r in rows)
    assert sorted(r.decoded for r in out) == texts
    counts = token_counts.token_counts(df, PIECES).collect()
    assert sorted(r.n_tokens for r in counts) == sorted(len(r.ids) for r in out)
    assert sorted(r.score for r in counts) == pytest.approx(sorted(r.scores[0] for r in out))
    for text in ("thentione", "ab\ncd"):  # whole-text Viterbi, one position at a time
        norm = pieces.normalised(text)
        assert token_counts.count_texts([text], pieces)[0][2] == pytest.approx(sentencepiece_nbest.viterbi(norm, pieces)[-1])
    assert token_counts.token_counts(none, PIECES).count() == 0 and sentencepiece_nbest.digests(none, PIECES).count() == 0


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def classes(rows, k, percent=80):
    s, root = [sets(t, k) for _, t in rows], {i: i for i, _ in rows}
    links = [(a[0], b[0]) for (a, x), (b, y) in itertools.combinations(zip(rows, s, strict=True), 2) if x & y and 100 * len(x & y) >= percent * len(x | y)]
    while links and any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_duplicates_equal_brute_force(spark, odd, none):
    rng, rows = np.random.default_rng(2), []
    for g in range(25):
        words = lorem(int(rng.integers(1, 120)), g).split()
        for _ in range(6):
            own = list(words)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = "zz" + str(rng.integers(1000))
            rows.append((len(rows), " ".join(own)))
    out = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=4).collect()}
    root = classes(rows, 4)
    assert {i: r.component_id for i, r in out.items()} == root and all(r.n_shingles == len(sets(rows[i][1], 4)) and r.kept == (root[i] == i) for i, r in out.items())
    df, _ = odd
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k=4).collect()]
    assert (7, 1, 1, False) in got and (3, 0, 3, True) in got and (None, 1, None, True) in got and len(got) == 11
    assert minhash.near_duplicates(none).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Buckets beyond the small size and one star only: the comparison of what is left must find every link."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "STARS", 1)
    monkeypatch.setattr(minhash, "PART", 7)
    rng, base, rows = np.random.default_rng(5), lorem(150, 3).split(), []
    for i in range(120):  # likeness on both sides of the threshold, edits that recur in other copies
        own = list(base)
        for at in rng.choice(150, int(rng.integers(2, 9)), replace=False):
            own[at] = f"zz{rng.integers(3)}"
        rows.append((i, " ".join(own)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=4).collect()
    assert {r.doc_id: r.component_id for r in out} == classes(rows, 4)


def test_fingerprints(spark, odd, none):
    df, rows = odd
    out = sorted(fingerprints.edited_fingerprints(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_chars))
    given = sorted([(r[0], r[1] or "") for r in rows], key=lambda r: (r[0] is None, r[0] or 0))
    for i, ((key, text), r) in enumerate(zip(given, out, strict=True)):
        quarter, after = len(text) // 4, given[(i + 1) % len(given)][1]
        edited = text[:len(text) - quarter] + after[:quarter]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (key, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert out[0].fingerprint == out[6].fingerprint != out[5].fingerprint  # equal texts
    assert fingerprints.edited_fingerprints(none).count() == 0
    pair = spark.createDataFrame([(1, "p one\np two\n"), (2, "p two\np one\n"), (3, "p one\n"), (4, "p two\n")], "doc_id bigint, text string")
    f = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(pair).collect()}
    assert f[1] == f[2] != f[3]
    joined = spark.createDataFrame([(f[1], f[3], f[4])], "w string, x string, y string").select(
        fingerprints.combine(F.col("x"), F.col("y")).alias("sum"), fingerprints.combine(F.col("w"), F.col("y"), -1).alias("less"), fingerprints.likeness(F.col("w"), F.col("x")).alias("like")).first()
    assert joined["sum"] == f[1] and joined.less == f[3] and 0.2 < joined.like < 1


def test_words_of_a_fingerprint_come_from_passes_of_their_own(spark):
    """Not from the one hash that the counters come from."""
    row = spark.createDataFrame([(1, "one paragraph\n")], "doc_id bigint, text string")
    words = fingerprints.fingerprint(row).first().fingerprint[-64:]
    passes = row.select(*[F.xxhash64(F.lit(s), "text") for s in fingerprints.SEEDS]).first()
    assert [int(words[i:i + 8], 16) for i in range(0, 64, 8)] == [x for h in passes for x in (h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF)]


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer
    df, rows = odd
    token_files.write_tokens(df, str(tmp_path / "t"), WORD_BPE, files=3)
    stored = token_files.read_tokens(spark, str(tmp_path / "t"))
    own = Tokenizer.from_file(WORD_BPE)
    expected = {}
    for r in rows:
        expected.setdefault(r[0], []).append([*own.encode(r[1] or "", add_special_tokens=False).ids, token_files.END])
    assert all(list(r.ids) in expected[r.doc_id] for r in stored.collect()) and stored.count() == len(rows)
    assert stored.where("doc_id = 5").count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in stored.where("doc_id = 5")._jdf.queryExecution().toString()
    index = sorted(token_files.token_index(stored).collect(), key=lambda r: r.start)
    assert [r.start for r in index] == list(np.cumsum([0, *(r.n_tokens for r in index)])[:-1])
    keys = [-1 if r.doc_id is None else r.doc_id for r in index]
    assert keys == sorted(keys)
    assert all(r.ids_crc32 in [zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in expected[r.doc_id]] for r in index)
    token_files.write_tokens(none, str(tmp_path / "e"), WORD_BPE, files=3)
    assert token_files.token_index(token_files.read_tokens(spark, str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("text", ["The.", "don't stop, it's.", "a<|endoftext|>b.", "x.. y,, z.,", "É. ÀB, ß.", "1. a1. $$. tab\there.\n", "İstanbul. ΟΔΟΣ."])
def test_words_encode_like_texts(text):
    from tokenizers import Tokenizer
    own = np.frombuffer(token_files.encoder(WORD_BPE).encode([text])[0], "<u4").tolist()
    assert own == Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids


def test_words_of_letters_go_to_the_model():
    """Words of Latin, Greek and Cyrillic letters skip the tokenizer's normaliser and splitter, with signs after them or without, and get the same ids."""
    from tokenizers import Tokenizer
    own, whole = token_files.Encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    asked, batch = set(), own.batch
    own.batch = lambda words, **k: asked.update(words) or batch(words, **k)
    letters = [chr(c) for c in range(0x80, 0x500) if chr(c).isalpha()]
    words = ["The", "house***", "straße.", "ÉTÉ!!", "ΟΔΟΣ", "ΣΑΣ,", "Дом?!", *letters, *(a + "o" + a for a in letters), *("É" + a for a in letters)]
    texts = [" ".join(words), "don't. it's*** dogs' <|endoftext|>. a<|b|>. İx. cafe\u0301. x\u0338= 漢字! 3.5% --- a-b--", "THE House***\nthe"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert not asked & {"the", "house", "straße", "ÉTÉ", "ΟΔΟΣ", "ΣΑΣ", "Дом"}


def test_marks_of_letters_are_in_one_piece_with_signs_after_them():
    """The normaliser turns some letters into a letter and a mark, which the splitter leaves with the signs that follow."""
    from tokenizers import Tokenizer
    texts = ["BİRİ!? İ. aİ", "\u0915\u0958.. \u0a59, \u0b5c!", "word.. word", "", "\n", "|<| <|endoftext|>!? A<|b|>!", "é!É! e\u0301! e!\u0301"]
    own = token_files.Encoder(WORD_BPE).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in own] == [Tokenizer.from_file(WORD_BPE).encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_looked_up_once_a_slice(monkeypatch):
    """Arrow numbers the words of a slice: each piece that differs is asked for once, with any signs after it, also when the memory overflows."""
    from tokenizers import Tokenizer
    own, asked = token_files.Encoder(WORD_BPE), []
    found = own.found
    own.found = lambda pieces: asked.append(sorted(pieces)) or found(pieces)
    texts = ["the house the house. " * 500, "The house!\nthe HOUSE, 42. " * 500, ""]
    whole = [Tokenizer.from_file(WORD_BPE).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == whole
    assert asked == [["", "!", ",", ".", "42.", "house", "the"]]
    monkeypatch.setattr(token_files, "REMEMBERED", 9)
    for t in ("one two the", "three four", "the four, five", *texts):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == Tokenizer.from_file(WORD_BPE).encode(t, add_special_tokens=False).ids
        assert len(own.known) <= 9


def test_shards(spark, odd, none):
    df, rows = odd
    out = sharding.interleaved_shards(df, shards=3).collect()
    sizes = [sum(r.shard == s for r in out) for s in range(3)]
    assert max(sizes) - min(sizes) <= 1 and len(out) == len(rows)
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s])) for s in range(3))
    assert sorted(r["size"] for r in out) == sorted(len((r[1] or "").encode()) + 1 for r in rows)
    assert sharding.interleaved_shards(none).count() == 0
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    table = sharding.interleaved_shards(many, shards=8).groupBy("source").pivot("shard").count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 2 for r in table)  # every shard holds the mixture


def apportioned(targets, seats):
    """Sainte-Laguë by listing quotients."""
    listed = sorted(((-t / (2 * k + 1), i) for i, t in enumerate(targets) for k in range(seats)))[:seats]
    return [sum(i == j for _, j in listed) for i in range(len(targets))]


def test_quotas_equal_listed_quotients(spark):
    targets = [(f"s{i}", 10_000, 1.0, t) for i, t in enumerate([512.0, 130.0, 77.0, 9.0, 1.0, 260.0])]
    rows = mixing.shard_quotas(spark.createDataFrame(targets, "source string, source_size bigint, weight double, target double"), shards=4, block=3).collect()
    blocks = int(sum(t[3] for t in targets) // 3)
    for s in range(4):
        assert [r.seats for r in sorted(rows, key=lambda r: r.source) if r.shard == s] == apportioned([t[3] for t in targets], blocks * (s + 1) // 4)
    assert min(r.quota for r in rows) >= 0


def test_mixture(spark, odd, none, sf):
    df, rows = odd
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert mixing.mix(none).count() == 0 and mixing.apply_mixture(none, mixing.mix(none)).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = mixing.mix(docs)
    by = taken.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).orderBy(F.col("source").asc_nulls_last()).collect()
    targets, weights = {}, [(3, 1, 2)[i % 3] for i in range(len(by))]
    left, budget = set(range(len(by))), 1.5 * sum(r["size"] for r in by)
    while True:  # reshare the excess until no target is above its ceiling
        level = (budget - sum(targets.values())) / sum(weights[i] for i in left)
        over = {i for i in left if level * weights[i] > 2 * by[i]["size"]}
        if not over:
            break
        targets.update({i: 2.0 * by[i]["size"] for i in over})
        left -= over
    targets.update({i: level * weights[i] for i in left})
    assert [r.target for r in by] == pytest.approx([targets[i] for i in range(len(by))])
    assert all(abs(r.taken - r.target) <= 3 * mixing.BLOCK for r in by)
    mixed = mixing.apply_mixture(docs, taken)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == sum(r.taken for r in by)
    assert sorted(map(str, taken.collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    # each shard takes the words of its quota of blocks: all of them but what the last block of a stream lacks, and a document's shards add up
    sources = taken.groupBy("source").agg(F.first("source_size").alias("source_size"))
    quotas = {(r.source, r.shard): r.quota for r in mixing.shard_quotas(mixing.source_targets(sources)).collect()}
    dealt = {(r.source, r.shard): r.words for r in taken.select("source", F.inline("shards")).groupBy("source", "shard").agg(F.sum("words").alias("words")).collect()}
    assert dealt.keys() <= quotas.keys()
    assert all(0 <= quota * mixing.BLOCK - dealt.get(k, 0) < 2 * mixing.BLOCK for k, quota in quotas.items())
    assert all(sum(p.words for p in r.shards) == r.taken for r in taken.collect())
    twice = docs.unionByName(docs.limit(20))
    plan = mixing.mix(twice)
    total = mixing.apply_mixture(twice, plan).select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert total == plan.agg(F.sum("taken")).first()[0]


def test_deobfuscation():
    text = " ".join(["idiot clown moron trash hello there the thing stupid loser"] * 40)
    model = toxicity.Model(toxicity.language_model(toxicity.trigrams(text).astype(float)), {"idiot": 9.0}, 1.0, -4.0)
    assert model.decode("1d10t") == "idiot" and model.decode("cl0wn") == "clown" and model.decode("m0r0n") == "moron"
    assert model.restore("you i d i o t") .endswith("idiot") and model.restore("idiooooot") == "idiot" and model.restore("i.d.i.o.t") == "idiot"
    assert model.score("what an 1d!0t") > 0.9 and model.score("hello there") < 0.1 and model.score("") < 0.1

    token = "1d!0t"  # every reading of the lattice, scored one by one
    def total(path):
        a = b = 0
        s = 0.0
        for letters, cost in path:
            s += cost
            for c in letters:
                if c or b:
                    s, a, b = s + model.lm[a, b, c], b, c
        return s + (model.lm[a, b, 0] if b else 0.0)
    best = max(itertools.product(*model.readings(token)), key=total)
    assert model.decode(token) == "".join(toxicity.LETTERS[c - 1] if c else " " for letters, _ in best for c in letters)


@pytest.mark.parametrize("text", ["id.iot", "i*diot", "id_iot", "i..d..i..o..t", "i,d,i,o,t", "idi/ot", "i!d!i!o!t", "iddiot", "idioott", "1diiot", "i  d  i  o  t",
                                  "i\nd\ni\no\nt", "i d\tio t", "id io t", "id iot", "idi ot", "1 d 1 0 t", "i. d. i. o. t"])
def test_every_disguise_is_decoded(text):
    known = " ".join(["idiot clown moron trash hello there the thing stupid loser foot egg"] * 40)
    model = toxicity.Model(toxicity.language_model(toxicity.trigrams(known).astype(float)), {"idiot$": 9.0}, 1.0, -4.0)
    assert model.restore(f"hello {text} there") == "hello idiot there" and model.score(f"hello {text} there") > 0.9
    assert model.restore("hello foot egg there the loser") == "hello foot egg there the loser"


def test_tokens_of_a_slice_are_read_once(monkeypatch):
    """The evidence of texts is the greatest weight of their features; a token that they share is read once, however few are remembered."""
    known = " ".join(["idiot clown moron trash hello there the thing stupid loser foot egg"] * 40)
    weights = {"idiot$": 9.0, "moro": 5.0, "los$": 2.0, "stupi": 3.0, "trash": 1.0, "fo$": 4.0}
    model = toxicity.Model(toxicity.language_model(toxicity.trigrams(known).astype(float)), weights, 1.0, -4.0)
    texts = ["", "1d10t there", "the 1d10t, m0r0ns", "los. loser", "Stuppid!! t r a s h", "i d\x1ci\u00a0o\n\nt", "f o\u3000longer ab c", "tra$h " * 9, "m" + "o" * 300 + "rons", "foo fooo", "漢2 é"]
    read, decode = [], model.decode
    monkeypatch.setattr(model, "decode", lambda token: read.append(token) or decode(token))
    monkeypatch.setattr(toxicity, "REMEMBERED", 1)
    monkeypatch.setattr(toxicity, "WEIGHED", 1, raising=False)
    got = model.evidence(texts * 3)
    assert len(read) == len(set(read)) and "1d10t" in read and all(len(t) <= toxicity.LONGEST for t in model.strength)
    assert got == [max((weights.get(f, 0.0) for f in model.features(t)), default=0.0) for t in texts] * 3 and len(set(got)) > 4
    assert [model.score(t) for t in texts] == model.scores(texts)
    for t in texts:
        assert model.tokens(t) == set(t.lower().split()) | {" ".join(m[0].split()) for m in toxicity.SPACED.finditer(t.lower())}


def test_letters_beyond_latin_1_stay():
    known = " ".join(["idiot clown moron дурак глупец 漢字仮名 œuvre ğüzel"] * 40)
    model = toxicity.Model(toxicity.language_model(toxicity.trigrams(known).astype(float)), {"дурак$": 9.0}, 1.0, -4.0)
    assert model.restore("2дурак! 漢字9仮名 œuvre2 ğüzel6 и.д.и.о.т") == "дурак 漢字 仮名 œuvre ğüzel идиот"
    assert model.score("ты 6дурак6") > 0.9 and model.restore("1d10t 漢2") == "idiot 漢"


def test_toxicity_and_quality_on_held_out(spark, sf, none, odd):
    wide = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{wide}/labels.parquet")
    for name, label, least in (("op3_toxicity", "toxic", 0.85), ("op7_quality", "quality", 0.95)):
        rows = queries.QUERIES[name](spark, wide).join(labels, "doc_id").where("held_out").collect()
        assert len(rows) > 50 and np.mean([r.predicted == r[label] for r in rows]) >= least and all(0 <= r.score <= 1 for r in rows)
    df, rows = odd
    empty = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    some = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, toxic int, quality int")
    narrow = df.select("doc_id", "text", "lang")
    for given in (empty, some):
        assert toxicity.score(narrow, toxicity.fit(df, given)).count() == len(rows)
        assert quality.score(narrow, quality.fit(df, given)).count() == len(rows)
    assert toxicity.score(none.select("doc_id", "text"), toxicity.fit(none, empty)).count() == 0


def test_trees_learn_and_walk_like_one_row_at_a_time():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.grow(x[:2000], y[:2000], trees=30)
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    for row in x[:5]:
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert forest.raw(row[None])[0] == pytest.approx(total)
    assert quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_signature_estimates_likeness():
    a, b = minhash.mixed(np.arange(1, 1001, dtype=np.uint64)), minhash.mixed(np.arange(101, 1101, dtype=np.uint64))
    agree = np.mean(minhash.signature(np.sort(a)) == minhash.signature(np.sort(b)))
    assert abs(agree - 900 / 1100) < 4 * math.sqrt(0.15 / minhash.BINS)
    few = minhash.signature(np.sort(minhash.mixed(np.arange(1, 4, dtype=np.uint64))))
    assert len(set(few.tolist())) <= 3


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    tox = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert tox.columns == docs.columns
    rejected = {r.doc_id for r in queries.QUERIES["op3_toxicity"](spark, sf).where("predicted = 1").collect()}
    assert ids(tox) == ids(docs) - rejected
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ids(kept) == {i for i, c in classes(rows, 5).items() if i == c} and kept.columns == docs.columns
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "ids"} <= set(out.columns)


def test_pipeline_encoding_searches_and_decodes(spark, odd, pieces):
    import corpus_pipeline
    df, rows = odd
    out = corpus_pipeline.encode(spark, df, "").collect()
    assert sorted(r.decoded for r in out) == sorted((r[1] or "").replace("▁", " ") for r in rows)
    own = {tuple(x[0]): x[1] for x in sentencepiece_nbest.encode_texts([r[1] for r in rows], 4, pieces)}
    for r in out:
        best = own[tuple(r.ids)]
        assert r.nbest == [list(x) for _, x in best] and r.scores == [s for s, _ in best] and r.score == r.scores[0] and r.n_ids == len(r.ids)
    assert max(len(r.nbest) for r in out) == 4


def test_very_long_texts_and_words(spark):
    """A text of five megabytes and a word of one without blanks end, in bounded slices, and decode back."""
    rng = np.random.default_rng(5)
    word = "".join(rng.choice(list("etaoinshrdlu"), 1_000_000))
    rows = [(1, lorem(1_000_000, 2)), (2, word), (3, "short"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in sentencepiece_nbest.encode(df, PIECES, n=4, decoded="decoded").collect()}
    assert all(out[i].decoded == (t or "") and len(out[i].nbest) == len(out[i].scores) <= 4 for i, t in rows)
    assert all(list(r.scores) == sorted(r.scores, reverse=True) and (not r.ids or r.ids == r.nbest[0]) for r in out.values())
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, PIECES).collect()}
    assert counts == {i: len(r.ids) for i, r in out.items()}


def test_chains_equal_the_trie():
    vocabulary = lattice.load(PIECES)
    words = ["▁" + lorem(1, i) * 30 + "é漢" for i in range(5)]
    trie = lattice._shared(words, vocabulary)
    for i, word in enumerate(words):
        node, path = trie.end[i], []
        while node > 0:
            path.append(node)
            node = trie.parent[node]
        for mine, theirs in zip(lattice.chain(word, vocabulary), (trie.score, trie.gap, trie.tokens, trie.arc, trie.piece), strict=True):
            assert np.allclose(mine, theirs[path[::-1]], atol=1e-9)


def test_slices_by_bytes():
    import pyarrow as pa

    from panelcast.llm.common import sliced
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 50, "c", "d", "e" * 30, ""])], names=["text"])
    assert [len(s) for s in sliced(iter([batch]), "text", 3, 40)] == [2, 1, 3, 1]
    assert [len(s) for s in sliced(iter([batch]), "text", 100, 1000)] == [7]


def test_forks_equal_the_lattice():
    """Words of letters with repeated ones, plain signs around them: deciding each fork by itself is the best path of the whole lattice."""
    rng = np.random.default_rng(11)
    model = toxicity.Model(toxicity.language_model(toxicity.trigrams(lorem(3000, 3) + " aabb bee oops llama è éé " * 40).astype(float)))
    for _ in range(4000):
        word = "".join(rng.choice(list("aabbelnorsté漢"), rng.integers(1, 9)))
        token = "".join(rng.choice(list(".,;-*("), rng.integers(0, 3))) + word + "".join(rng.choice(list(".,;:)?"), rng.integers(0, 3)))
        if toxicity.MARK.search(token):
            assert toxicity.WORDS.findall(model.reading(token)) == toxicity.WORDS.findall(model.decode(token)), token
        pieces = " ".join("".join(rng.choice(list("abelnorsté漢"), rng.integers(1, 4))) for _ in range(rng.integers(2, 7)))
        assert model.reading(pieces) == model.decode(pieces), pieces


def test_large_buckets_meet_as_matrix_products(monkeypatch):
    """All links between outer members and inner ones of other classes, one for each outer member and class, whatever the cuts."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 80)
    sets = [np.unique(np.where(rng.random(80) < rng.uniform(0, 0.25), rng.integers(0, 1 << 60, 80), base)) for _ in range(60)]
    assert (minhash.shared_counts(sets[:7], sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:7]]).all()
    assert minhash.shared_counts([base[:0]], sets[:2]).tolist() == [[0, 0]]
    classes = rng.integers(0, 5, 60)
    rows = [{"bucket": 1, "part": 0, "side": side, "id": i, "c": int(classes[i]), "hashes": sets[i].tolist()} for side, ids in ((0, range(60)), (1, range(40, 60))) for i in ids]
    want = {(min(i, j), max(i, j)) for j in range(40, 60) for i in range(60) if classes[i] != classes[j]
            and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    for outer, columns in ((256, 4096), (3, 7)):
        monkeypatch.setattr(minhash, "OUTER", outer)
        monkeypatch.setattr(minhash, "COLUMNS", columns)
        batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=11)
        got = {(r["a"], r["b"]) for b in minhash._meetings(80)(iter(batches)) for r in b.to_pylist()}
        assert want and got <= want
        assert {(j, int(classes[i])) for pair in want for i, j in (pair, pair[::-1]) if j >= 40} == {(j, int(classes[i])) for pair in got for i, j in (pair, pair[::-1]) if j >= 40}
