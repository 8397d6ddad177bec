"""SentencePiece encoding and decoding with exact N-best segmentations.

The lattice of a pre-token is searched from its end: a partial path's cost so far plus
the forward Viterbi score of the node it has reached is the exact score of the best
completion, so an A-star search pops complete paths in the order of their scores and
never expands a node in vain.  Forward scores come from the shared trie of
:mod:`lattice`, which also says how much each pre-token's second-best path loses.

The N best segmentations of a whole text change the best one in few pre-tokens, always
among the N - 1 occurrences whose second-best path loses least; only those are
searched, and their lists are merged through a heap.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .common import release, sliced
from .lattice import BLANK, Vocabulary
from .token_counts import PER_TRIE, SLICE


def arcs_into(text: str, stop: int, vocabulary: Vocabulary):
    """(start, piece, score) of the lattice arcs that end at ``stop``; piece -1 is an unknown character."""
    single = False
    for size in range(1, min(stop, vocabulary.longest) + 1):
        piece = vocabulary.index.get(text[stop - size:stop])
        if piece is not None:
            single |= size == 1
            yield stop - size, piece, float(vocabulary.scores[piece])
    if not single:
        yield stop - 1, -1, vocabulary.unknown_score


def viterbi(text: str, vocabulary: Vocabulary) -> list[float]:
    """Forward scores of all positions of one text."""
    best = [0.0] + [-np.inf] * len(text)
    for stop in range(1, len(text) + 1):
        best[stop] = max(best[start] + score for start, _, score in arcs_into(text, stop, vocabulary))
    return best


def n_best(text: str, n: int, vocabulary: Vocabulary, ahead: list[float] | None = None) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) of a text, best first; of equal scores the path followed last comes first.

    So a search among many equal paths goes down one of them instead of widening.
    """
    ahead = viterbi(text, vocabulary) if ahead is None else ahead
    heap, found, turn = [(-ahead[-1], 0, len(text), 0.0, None)], [], 0
    least = [ahead[-1]]  # heap of the n best scores among the paths seen: every entry stands for one complete path
    while heap and len(found) < n:
        total, _, at, behind, path = heapq.heappop(heap)
        if at == 0:
            ids: list[int] = []
            while path is not None:  # the head of the chain is the first arc of the text
                piece, start, stop, path = path
                ids += vocabulary.spelled(piece, text[start:stop])
            found.append((-total, tuple(ids)))
            continue
        steps = [(behind + score + ahead[start], start, piece, score) for start, piece, score in arcs_into(text, at, vocabulary)]
        followed = max(s[0] for s in steps)  # goes on with the path that led here; the other arcs are new paths
        for value, start, piece, score in steps:
            if value < followed:
                if len(least) == n and value < least[0] - 1e-6:
                    continue  # n paths are better
                (heapq.heappush if len(least) < n else heapq.heappushpop)(least, value)
            turn -= 1
            heapq.heappush(heap, (-value, turn, start, behind + score, (piece, start, at, path)))
    return found


def merged(best: float, lists: list[tuple[int, list]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n best sums when one entry is chosen from each list; (score, {occurrence: rank above 0})."""
    out, heap, turn = [], [(-best, 0, -1, ())], 0
    lists = sorted(lists, key=lambda x: x[1][0][0] - x[1][1][0] if len(x[1]) > 1 else np.inf)
    lists = [x for x in lists if len(x[1]) > 1]
    cost = lambda i, r: lists[i][1][0][0] - lists[i][1][r][0]
    while heap and len(out) < n:
        total, _, last, chosen = heapq.heappop(heap)
        out.append((-total, {lists[i][0]: r for i, r in chosen}))
        base = -total
        steps = []
        if last >= 0:
            i, r = chosen[-1]
            if r + 1 < len(lists[i][1]):  # the next entry of the last list
                steps.append((base + cost(i, r) - cost(i, r + 1), i, (*chosen[:-1], (i, r + 1))))
            if r == 1 and i + 1 < len(lists):  # move the last choice on
                steps.append((base + cost(i, 1) - cost(i + 1, 1), i + 1, (*chosen[:-1], (i + 1, 1))))
        if last + 1 < len(lists):
            steps.append((base - cost(last + 1, 1), last + 1, (*chosen, (last + 1, 1))))
        for score, i, choice in steps:
            turn += 1
            heapq.heappush(heap, (-score, turn, i, choice))
    return out


def encode_texts(texts: list[str | None], n: int, vocabulary: Vocabulary):
    """For each text: (best ids as a numpy array, [(score, ids)] of its n best, best first)."""
    cut = [vocabulary.pre.findall(vocabulary.normalised(t or "")) for t in texts]
    distinct, packed, gaps, scores = list(set().union(*cut)), [], [], []
    place = dict(zip(distinct, range(len(distinct)), strict=True))
    for i in range(0, len(distinct), PER_TRIE):
        part = distinct[i:i + PER_TRIE]
        trie = lattice.forward(part, vocabulary)
        packed += spelled_out(part, trie, vocabulary)
        # the least loss among the arcs beside the best path
        least, node = trie.gap[trie.end], trie.end.copy()
        live = np.flatnonzero(node > 0)
        while len(live):
            least[live] = np.minimum(least[live], trie.gap[node[live]])
            node[live] = climbed(trie, node[live])
            live = live[node[live] > 0]
        gaps.append(least)
        scores.append(trie.score[trie.end])
    gaps = np.concatenate(gaps) if gaps else np.zeros(0)
    scores = np.concatenate(scores) if scores else np.zeros(0)
    lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    searched: dict[str, list] = {}
    out = []
    for words in cut:
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        ids = np.frombuffer(b"".join(map(packed.__getitem__, at.tolist())), np.int32)
        total = float(scores[at].sum())
        best = [(total, ids)]
        if n > 1 and len(at):
            loss = gaps[at]
            few = np.argpartition(loss, min(n - 2, len(loss) - 1))[:n - 1] if len(loss) > n - 1 else np.arange(len(loss))
            few = [int(i) for i in np.sort(few) if np.isfinite(loss[i])]
            for i in few:
                if words[i] not in searched:
                    searched[words[i]] = n_best(words[i], n, vocabulary)
            best, stops = [], np.cumsum(lengths[at])
            for score, change in merged(total, [(i, searched[words[i]]) for i in few], n):
                best.append((score, replaced(ids, stops, [(i, lengths[at[i]], searched[words[i]][r][1]) for i, r in sorted(change.items())])))
        out.append((ids, best))
    return out


def climbed(trie: lattice.Trie, nodes: np.ndarray) -> np.ndarray:
    """Where the best last piece of each node starts."""
    left = trie.arc[nodes].copy()
    out = nodes.copy()
    while (go := left > 0).any():
        out[go] = trie.parent[out[go]]
        left[go] -= 1
    return out


def spelled_out(words: list[str], trie: lattice.Trie, vocabulary: Vocabulary) -> list[bytes]:
    """Ids of the best path of each word, as bytes of 32-bit integers."""
    node, stop = trie.end.copy(), np.fromiter(map(len, words), np.int64, len(words))
    owner, piece, place, sizes = [], [], [], []
    live = np.flatnonzero(node > 0)
    while len(live):
        at = node[live]
        owner.append(live)
        piece.append(trie.piece[at])
        stop[live] -= trie.arc[at]
        place.append(stop[live].copy())
        node[live] = climbed(trie, at)
        live = live[node[live] > 0]
    if not owner:
        return [b""] * len(words)
    owner, piece, place = np.concatenate(owner), np.concatenate(piece), np.concatenate(place)
    order = np.lexsort((place, owner))
    owner, piece, place = owner[order], piece[order].astype(np.int32), place[order]
    bounds = np.searchsorted(owner, np.arange(len(words) + 1)) * 4
    raw = piece.tobytes()
    out = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    for w in np.unique(owner[piece < 0]):  # unknown characters become bytes
        mine = slice(bounds[w] // 4, bounds[w + 1] // 4)
        ids = [i for p, s in zip(piece[mine].tolist(), place[mine].tolist(), strict=True) for i in vocabulary.spelled(p, words[w][s:s + 1])]
        out[w] = np.asarray(ids, np.int32).tobytes()
    return out


def replaced(ids: np.ndarray, stops: np.ndarray, changes: list[tuple]) -> np.ndarray:
    """The ids of a text with other ids for some of its pre-tokens: (occurrence, number of ids, new ids) in order."""
    out, done = [], 0
    for i, length, part in changes:
        out += [ids[done:stops[i] - length], np.asarray(part, np.int32)]
        done = stops[i]
    return np.concatenate([*out, ids[done:]]) if changes else ids


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of ids: pieces and runs of bytes joined, the blank before the text taken off."""
    if not len(ids):
        return ""
    spell = decoder(vocabulary)
    text = b"".join(map(spell.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:].replace(BLANK, " ") if text.startswith(BLANK) else text.replace(BLANK, " ")


def decoder(vocabulary: Vocabulary) -> list[bytes]:
    if not hasattr(vocabulary, "spell"):
        vocabulary.spell = [p.encode() if vocabulary.normal[i] else b"" for i, p in enumerate(vocabulary.pieces)]
        for byte, i in enumerate(vocabulary.byte_ids):
            if i >= 0:
                vocabulary.spell[i] = bytes([byte])
    return vocabulary.spell


def _lists(parts: list[np.ndarray], kind, of=None) -> pa.ListArray:
    """A list column from one array per row, through flat buffers."""
    stops = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = of if of is not None else pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind))
    return pa.ListArray.from_arrays(pa.array(stops), values)


def encode(docs: DataFrame, model: str, n: int = 4, key: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """(key, ids, scores, nbest): ids of the best segmentation, scores and ids of the n best; with ``decoded`` also the text of the best ids.

    A text with fewer segmentations has fewer.  Null and empty texts have no ids and
    one segmentation, the empty one, of score 0.  One row per input row, null keys and
    repeated rows included; other columns are not looked at; no rows give no rows.
    A task holds slices of so many characters at a time, whatever the length of a text.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]
    names = [key, "ids", "scores", "nbest", *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattice.load(model)
        for part in sliced(batches, "text", SLICE):
            found = encode_texts(part.column("text").to_pylist(), n, vocabulary)
            best = [ids for _, x in found for _, ids in x]
            columns = [part.column("key"), _lists([x[0] for x in found], np.int32), _lists([np.array([s for s, _ in x[1]]) for x in found], np.float64),
                       _lists([x[1] for x in found], None, _lists(best, np.int32))]
            if decoded:
                columns.append(pa.array([decode_ids(x[0], vocabulary) for x in found], pa.string()))
            yield pa.record_batch(columns, names=names)
            found = best = columns = None
        release()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, scores array<double>, nbest array<array<int>>" + (f", `{decoded}` string" if decoded else ""))


def decode(rows: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the text of an id column (null: empty); ids outside the vocabulary are an error, other columns stay."""
    fields = rows.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattice.load(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            text = pa.array([decode_ids(np.asarray(x.values) if x.is_valid else (), vocabulary) for x in column], pa.string())
            yield pa.record_batch([*batch.columns, text], names=[*batch.schema.names, name])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` string"])
    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, n: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode again and report per document, without moving the ids: (key, n_ids, ids_crc32, scores, nbest_crc32, round_trip)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattice.load(model)
        crc = lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes())
        for batch in sliced(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            found = encode_texts(texts, n, vocabulary)
            same = [decode_ids(ids, vocabulary) == (t or "") for (ids, _), t in zip(found, texts, strict=True)]
            yield pa.record_batch([
                batch.column("key"), pa.array([len(x[0]) for x in found], pa.int64()), pa.array([crc(x[0]) for x in found], pa.int64()),
                pa.array([[s for s, _ in x[1]] for x in found], pa.list_(pa.float64())),
                pa.array([[crc(y) for _, y in x[1]] for x in found], pa.list_(pa.int64())), pa.array(same, pa.bool_()),
            ], names=[key, "n_ids", "ids_crc32", "scores", "nbest_crc32", "round_trip"])
    return rows.mapInArrow(run, f"`{key}` {kind}, n_ids bigint, ids_crc32 bigint, scores array<double>, nbest_crc32 array<bigint>, round_trip boolean")
