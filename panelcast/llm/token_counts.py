"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The count of a text is the number of ids of its best unigram segmentation.  A batch of
texts is cut into pre-tokens; the distinct ones are inserted in a trie, forward scores
are computed once per shared prefix and the terminal nodes hold the counts.  A text's
count is the sum over its pre-tokens.  There is no shuffle, and memory holds one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .common import sliced

#: Distinct pre-tokens put into one trie; more are dealt with in several tries.
PER_TRIE = 100_000
#: Rows of a batch worked on at a time, which bounds memory.
SLICE = 2_500


def count_texts(texts: list[str | None], vocabulary: lattice.Vocabulary) -> list[tuple[int, int, float]]:
    """(pre-tokens, tokens, score) of each text."""
    cut = [vocabulary.pre.findall(vocabulary.normalised(t or "")) for t in texts]
    distinct, tokens, scores = list(set().union(*cut)), [], []
    place = dict(zip(distinct, range(len(distinct)), strict=True))
    for i in range(0, len(distinct), PER_TRIE):
        trie = lattice.forward(distinct[i:i + PER_TRIE], vocabulary)
        tokens.append(trie.tokens[trie.end])
        scores.append(trie.score[trie.end])
    tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
    scores = np.concatenate(scores) if scores else np.zeros(0)
    out = []
    for words in cut:
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        out.append((len(words), int(tokens[at].sum()), float(scores[at].sum())))
    return out


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pretokens, n_tokens, score): ids and total score of the best segmentation of the whole text.

    ``model`` is the path of a SentencePiece model file that every executor can read.
    Null and empty texts have no tokens.  One row per input row, null keys and repeated
    rows included; other columns are not looked at; no rows give no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattice.load(model)
        for batch in sliced(batches, "text", SLICE):
            found = count_texts(batch.column("text").to_pylist(), vocabulary)
            pre, tokens, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column("key"), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64()), pa.array(score, pa.float64())],
                                  names=[key, "n_pretokens", "n_tokens", "score"])
    return rows.mapInArrow(run, f"`{key}` {kind}, n_pretokens bigint, n_tokens bigint, score double")
