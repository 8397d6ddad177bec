"""Toxicity of restored text: a noisy channel is decoded before the words are scored.

Language model: character trigrams of all documents (lower-case letters, one symbol for
letters beyond Latin-1, one for anything else), counted per task and summed, interpolated
with shorter contexts.  In a decoded text letters beyond Latin-1 stand for themselves.

Channel: a letter may have been written as a look-alike digit or sign, repeated, or
set apart by signs or blanks.  The possible readings of a token form a lattice whose
best path under the language model is found by Viterbi.  A token with one reading is
that reading; every other token is decoded, and so is every run of pieces of up to three
characters set apart by blanks or line ends.  Readings are kept in a bounded memory; while
documents are scored, the weights of tokens are kept instead, and a token that documents of
one slice share is read once.

Score: words and word beginnings of the restored text are features.  Each is weighed
by the signed root of its likelihood ratio in labelled documents, so rare coincidences
weigh little, the document's evidence is its strongest feature, and a logistic curve of
one variable turns it into a score.  The curve is fitted to evidence from which a document's own
label is left out.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..session import materialise
from .common import release, sliced

#: Labelled documents that the weights are learned from: at most about so many, chosen by a hash of the key.
MAX_LABELLED = 20_000
#: Features of the model.
MAX_FEATURES = 50_000
#: Tokens whose reading a worker remembers.
REMEMBERED = 300_000
#: Tokens whose weight a worker remembers while it scores; it keeps no readings then.
WEIGHED = 600_000
#: Documents that are scored at a time.
TOGETHER = 500

# Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}

SIZE = 64
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
#: The symbol of all other characters that words are made of.
OTHER = SIZE - 1
CODE = np.array([OTHER * (chr(c).isalnum() and not chr(c).isdecimal()) for c in range(0x110000)], np.int64)
CODE[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)


class Codes(dict):
    """Symbols of the characters met so far."""

    def __missing__(self, c: str) -> int:
        self[c] = code = int(CODE[ord(c)])
        return code


CODES = Codes()
#: A token with more than one reading: a look-alike, a letter twice or more, or signs between letters.
MARK = re.compile(r"[01345789@$!|+€]|([^\W\d_])\1|[^\W\d_][\W_]+[^\W\d_]", re.S)
#: A letter twice or more.
REPEATED = re.compile(r"(.)\1+", re.S)
#: Signs that stand for no letter.
PLAIN = ".,;:?\"'()[]{}<>/\\-_*~#%&=^`"
#: Two or more pieces of up to three characters, set apart by any blanks; and the same where a piece is one character, 1 if it is so short.
SPACED = re.compile(r"(?<!\S)\S{1,3}(?:\s+\S{1,3})+(?!\S)")
SHORT = re.compile("11+")
#: Characters of the longest token or run whose reading is remembered.
LONGEST = 200
WORDS = re.compile(r"[^\W\d_]+")
READ, BREAK, AGAIN, TWICE, CLOSE = math.log(0.2), math.log(0.6), math.log(0.5), math.log(0.2), math.log(0.3)


def trigrams(text: str) -> np.ndarray:
    """Counts of (a, b, c) at a * 4096 + b * 64 + c; runs of other characters are one symbol 0."""
    code = CODE[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = code[np.append(True, (code[1:] > 0) | (code[:-1] > 0))]
    return np.bincount(code[:-2] * SIZE * SIZE + code[1:-1] * SIZE + code[2:], minlength=SIZE**3) if len(code) > 2 else np.zeros(SIZE**3, np.int64)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a letter after two others."""
    c3 = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIZE)
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    return np.log((c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5))


@dataclass
class Model:
    lm: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self):
        self.rows = self.lm.tolist()
        self.memory: dict[str, tuple[str, ...]] = {}
        self.strength: dict[str, float] = {}
        self.options: dict[tuple[str, int], list] = {}
        self.heads = {f[:4] for f in self.weights}  # the features of a word share its first four characters

    def readings(self, token: str) -> list[list[tuple[tuple[int, ...], float]]]:
        """For each run of one character its readings: (letters, log probability)."""
        out = []
        for c, same in itertools.groupby(token):
            key = c, min(len(list(same)), 3)  # three and more are alike
            if key not in self.options:
                self.options[key] = self.options_of(*key)
            out.append(self.options[key])
        return out

    @staticmethod
    def options_of(c: str, n: int) -> list[tuple[tuple[int, ...], float]]:
        """The readings of a character written n times."""
        own = CODES[c]
        if own:
            return [((own,), 0.0)] if n < 2 else [((own, own), 0.0), ((own,), TWICE)] if n < 3 else [((own,), AGAIN), ((own, own), AGAIN)]
        options: list = [((0,), BREAK)]
        for letter in LOOKALIKES.get(c, ""):
            options += [((CODES[letter],) * k, READ) for k in range(1, min(n, 2) + 1)]
        if not c.isalnum():
            options.append(((), CLOSE))
        return options

    def decode(self, token: str) -> str:
        """The best reading of a lower-case token under the language model."""
        states = {(0, 0): (0.0, ())}
        for (own, _), options in zip(itertools.groupby(token), self.readings(token), strict=True):
            after: dict = {}
            for (p, q), (score, path) in states.items():
                for letters, cost in options:
                    a, b, total = p, q, score + cost
                    for c in letters:
                        if c or b:  # runs of breaks are one
                            total += self.rows[a][b][c]
                            a, b = b, c
                    if (a, b) not in after or after[a, b][0] < total:
                        after[a, b] = (total, (path, letters, own))
            states = after
        _, path = max(((s + (self.rows[a][b][0] if b else 0.0), p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
        out: list[str] = []
        while path:
            path, letters, own = path
            out.append("".join(own if c == OTHER else LETTERS[c - 1] if c else " " for c in letters))
        return "".join(reversed(out))

    def forked(self, word: str) -> str:
        """The best reading of a word of letters: each repeated letter is a fork whose two ends meet again at the next letter, so it is decided by itself."""
        rows, out, done = self.rows, [], 0
        for run in REPEATED.finditer(word):
            start, stop = run.span()
            c = CODES[word[start]]
            before = CODES[word[start - 1]] if start else 0
            after = CODES[word[stop]] if stop < len(word) else 0
            twice, once = rows[before][c][c] + rows[c][c][after], rows[before][c][after]
            keep = twice >= once + TWICE if stop - start == 2 else twice > once
            out += [word[done:start], word[start] * (1 + keep)]
            done = stop
        return "".join([*out, word[done:]])

    def closed(self, pieces: list[str]) -> str:
        """The best reading of pieces of letters without repeated ones: each blank between two parts words or is dropped, the only choice of the lattice."""
        rows, codes = self.rows, CODES
        states: list[tuple] = [(0, 0, 0.0, ())]
        for i, piece in enumerate(pieces):
            after: dict = {}
            for p, q, score, path in states:
                for a, b, total, blank in ((q, 0, score + BREAK + rows[p][q][0], True), (p, q, score + CLOSE, False)) if i else ((p, q, score, False),):
                    for letter in piece:
                        c = codes[letter]
                        total += rows[a][b][c]
                        a, b = b, c
                    if (a, b) not in after or after[a, b][0] < total:
                        after[a, b] = (total, (path, blank))
            states = [(a, b, total, path) for (a, b), (total, path) in after.items()]
        path = max(states, key=lambda s: s[2] + rows[s[0]][s[1]][0])[3]
        out: list[str] = []
        for piece in reversed(pieces):
            path, blank = path
            out += [piece, " "] if blank else [piece]
        return "".join(reversed(out))

    def reading(self, token: str) -> str:
        """The best reading of a token; signs around it that stand for no letter part words, as they do on the best path."""
        if " " not in token:
            if not MARK.search(token):
                return token
            if (word := token.strip(PLAIN)).isalpha():
                return self.forked(word)
        elif not REPEATED.search(token) and (pieces := token.split(" ")) and all(map(str.isalpha, pieces)):
            return self.closed(pieces)
        return self.decode(token)

    def read(self, token: str) -> list[str]:
        """Words of the reading of a token or run."""
        word = token.strip(PLAIN)
        if word.isalpha():  # the only signs are around it
            return [self.forked(word) if REPEATED.search(word) else word]
        return WORDS.findall(self.reading(token))

    def words(self, token: str) -> tuple[str, ...]:
        """Words of the restored form of a lower-case token, or of a run of pieces with one blank between."""
        found = self.memory.get(token)
        if found is None:
            found = tuple(self.read(token))
            if len(token) <= LONGEST:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[token] = found
        return found

    def restore(self, text: str) -> str:
        """The restored text: every token's reading, spaced-out words closed."""
        text = SPACED.sub(lambda m: " ".join(self.words(" ".join(m[0].split()))), text.lower())
        return " ".join(" ".join(self.words(t)) for t in text.split())

    def tokens(self, text: str) -> set[str]:
        """Distinct tokens of a text, its spaced-out runs among them, their blanks made one."""
        pieces = text.lower().split()
        out = set(pieces)
        short = "".join(["1" if len(p) < 4 else "0" for p in pieces])
        out.update([" ".join(pieces[m.start():m.end()]) for m in SHORT.finditer(short)])
        return out

    def features(self, text: str) -> set[str]:
        words: set[str] = set()
        for t in self.tokens(text):
            words.update(self.words(t))
        return {f for w in words for f in features_of(w)}

    def weighed(self, text: str) -> set[str]:
        """The features of a text that have a weight."""
        return {f for t in self.tokens(text) for w in self.words(t) if (w + "$")[:4] in self.heads for f in features_of(w) if f in self.weights}

    def strongest(self, token: str) -> float:
        """The weight of the strongest feature of a token, 0 without any."""
        get, best = self.weights.get, 0.0
        for w in self.read(token):
            if (w[:4] if len(w) > 3 else w + "$") in self.heads:
                best = max(best, get(w + "$", 0.0), get(w[:4], 0.0), get(w[:5], 0.0), get(w[:6], 0.0))
        return best

    def evidence(self, texts: list[str]) -> list[float]:
        """For each text the weight of its strongest feature, 0 without any."""
        tokens, known = [self.tokens(t) for t in texts], self.strength
        new = set().union(*tokens).difference(known)
        if len(known) + len(new) > WEIGHED:
            known.clear()
            new = set().union(*tokens)
        for t in new:
            known[t] = self.strongest(t)
        get = known.__getitem__
        out = [max(map(get, own), default=0.0) for own in tokens]
        for t in [t for t in new if len(t) > LONGEST]:
            del known[t]
        return out

    def scores(self, texts: list[str]) -> list[float]:
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * e + self.offset)))) for e in self.evidence(texts)]

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def features_of(word: str):
    """The word itself and its beginnings of four to six letters."""
    yield word + "$"
    for k in (4, 5, 6):
        if len(word) >= k:
            yield word[:k]


def weight(pos, neg, n_pos: float, n_neg: float):
    """Signed root of the likelihood ratio that a feature is more frequent in toxic documents; 0 if it is not."""
    a, b = np.maximum(np.asarray(pos, float), 0), np.maximum(np.asarray(neg, float), 0)
    share = n_pos / (n_pos + n_neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(a > 0, a * np.log(a / ((a + b) * share)), 0.0) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0.0)
    return np.where(a * n_neg > b * n_pos, np.sqrt(np.maximum(2 * g, 0.0)), 0.0)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic curve, both classes weighing the same."""
    if not len(x) or y.min() == y.max():
        return 0.0, (-4.0 if not len(y) or not y.max() else 4.0)
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    theta, design, ridge = np.zeros(2), np.stack([x, np.ones_like(x)], 1), np.diag([1e-3, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (w * (p - y)) + ridge @ theta
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + ridge, gradient)
        theta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        held, size = [], 0
        for t in batch.column(0):
            held.append(t.as_py() or "")
            size += len(held[-1])
            if size > 4_000_000:
                total += trigrams("\n".join(held))
                held, size = [], 0
        if held:
            total += trigrams("\n".join(held))
    code = np.flatnonzero(total)
    yield pa.record_batch([pa.array(code, pa.int64()), pa.array(total[code], pa.int64())], names=["code", "n"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn the language model from all documents and the weights from labelled ones.

    ``labels`` has (key, label); rows with a null key or label teach nothing, a key with
    several labels has the greatest.  Without both classes the score is a constant.
    """
    counts = np.zeros(SIZE**3)
    grams = docs.select(text).mapInArrow(_counted, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    for row in grams.toLocalIterator():  # at most 64^3 rows, whatever the corpus
        counts[row.code] = row.n
    lm = language_model(counts)
    taught = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).na.drop().groupBy("k").agg(F.max("y").alias("y"))
    n = taught.count()
    if n > max_labelled:
        taught = taught.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    # the labelled keys are bounded by max_labelled, so they may be sent to every task
    some = materialise(docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(taught), "k").select("y", "text"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pos, neg = Model(lm), Counter(), Counter()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (pos if y else neg).update(model.features(t or ""))
        names = list(pos.keys() | neg.keys())
        for i in range(0, len(names), 100_000):
            part = names[i:i + 100_000]
            yield pa.record_batch([pa.array(part), pa.array([pos[f] for f in part], pa.int64()), pa.array([neg[f] for f in part], pa.int64())], names=["f", "pos", "neg"])
        model = pos = neg = names = part = None
        release()

    classes = {r.y: r.n for r in some.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sum(v for k, v in classes.items() if k), classes.get(0, 0)
    if not n_pos or not n_neg:
        return Model(lm, {}, 0.0, 4.0 if n_pos else -4.0)
    features = some.mapInArrow(seen, "f string, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 1")
    a, b, share = F.col("pos").cast("double"), F.col("neg").cast("double"), n_pos / (n_pos + n_neg)
    ratio = a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0)
    more = features.where(a * n_neg > b * n_pos).withColumn("w", F.round(ratio, 6))
    best = more.orderBy(F.desc("w"), "f").limit(MAX_FEATURES).collect()  # the size of the model
    known = {r.f: (r.pos, r.neg) for r in best}

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(lm, known)
        for batch in batches:
            ys, xs = batch.column(0).to_pylist(), []
            for y, t in zip(ys, batch.column(1).to_pylist(), strict=True):
                own = np.array([known[f] for f in model.weighed(t or "")]).reshape(-1, 2)
                one = bool(y)
                w = weight(own[:, 0] - one, own[:, 1] - (not one), n_pos - one, n_neg - (not one)) if len(own) else np.zeros(1)
                xs.append(float(w.max()))
            yield pa.record_batch([pa.array(ys, pa.int32()), pa.array(xs, pa.float64())], names=["y", "x"])
        model = None
        release()

    points = some.mapInArrow(left_out, "y int, x double").collect()  # bounded by max_labelled
    slope, offset = logistic(np.array([p.x for p in points]), np.array([float(bool(p.y)) for p in points]))
    return Model(lm, {r.f: float(weight(r.pos, r.neg, n_pos, n_neg)) for r in best}, slope, offset)


def score(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Add score and predicted to every row; columns of these names are replaced, other columns stay.

    Null and empty texts have no evidence; repeated rows are scored alike; no rows give no rows.
    """
    docs = docs.drop(score, predicted)
    at = docs.columns.index(text)
    lm, weights, slope, offset = model.lm, model.weights, model.slope, model.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(lm, weights, slope, offset)
        for batch in sliced(batches, text, TOGETHER):
            s = np.array(own.scores([t or "" for t in batch.column(at).to_pylist()]), float)
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, score, predicted])
        own = batch = None
        release()
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType()), StructField(predicted, IntegerType())]))
