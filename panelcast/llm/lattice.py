"""A unigram piece vocabulary and its dynamic programme over a trie of pre-tokens.

The pieces and scores come from a SentencePiece model file.  The best segmentation of
a text is the path of greatest score through the lattice of its pieces; characters
that no piece spells are unknown and stand for their UTF-8 bytes.

Texts are cut into pre-tokens where no piece can cross (before a run of blanks, and
around characters that no piece holds).  The distinct pre-tokens of a batch are put
into a trie, level by level: a node is a distinct prefix, and its forward score is
computed once from its ancestors, however many pre-tokens share it.  A whole level is
one set of numpy operations; pieces that end at a node are found by walking up the
ancestors along a trie of reversed pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

BLANK = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray  # pieces that spell text (not control, unknown or byte pieces)
    byte_ids: np.ndarray  # ids of the 256 byte pieces, -1 without
    unknown: int
    index: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.index = {p: i for i, p in enumerate(self.pieces) if self.normal[i]}
        own = self.scores[self.normal]
        self.unknown_score = float(own.min()) - UNKNOWN_PENALTY if len(own) else -UNKNOWN_PENALTY
        self.longest = max(map(len, self.index), default=1)
        letters = sorted({c for p in self.index for c in p})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        # the trie of reversed pieces: (state, letter) -> state in an open table
        states, moves = {"": 0}, {}
        for piece in self.index:
            for k in range(1, len(piece) + 1):
                tail = piece[-k:]
                if tail not in states:
                    states[tail] = len(states)
                moves[states[tail[1:]] * self.width + int(self.letter[ord(tail[0])])] = states[tail]
        self.piece_at = np.full(len(states), -1, np.int32)
        for piece, i in self.index.items():
            self.piece_at[states[piece]] = i
        self.bits = max(4, (4 * len(moves)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.full(1 << self.bits, -1, np.int32)
        left = np.fromiter(moves, np.int64, len(moves))
        to = np.fromiter(moves.values(), np.int32, len(moves))
        slot, self.probes = self._slot(left), 0
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.next[slot[put]] = left[put], to[put]
            left, to, slot = left[~put], to[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        inner = "".join(map(re.escape, [BLANK, *([] if self.letter[10] else ["\n"])]))
        cut = "" if self.letter[10] else "|\n"
        # pieces hold blanks at their start only, else a text is one pre-token
        free = all(BLANK not in p.lstrip(BLANK) for p in self.index)
        self.pre = re.compile(f"{BLANK}*[^{inner}]+|{BLANK}+{cut}") if free else re.compile("(?s).+")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Successors in the trie of reversed pieces, -1 where there is none."""
        keys = states.astype(np.int64) * self.width + letters
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.next[slot], -1).astype(np.int32)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        out[letters == 0] = -1
        return out

    def normalised(self, text: str) -> str:
        """A blank is put before the text and blanks become a visible letter; nothing else changes."""
        return (BLANK + text.replace(" ", BLANK)) if text else ""

    def spelled(self, piece: int, text: str) -> list[int]:
        """Ids of a lattice arc: a piece, or the bytes of an unknown character."""
        if piece >= 0:
            return [piece]
        return [int(self.byte_ids[b]) if self.byte_ids[b] >= 0 else self.unknown for b in text.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    bytes_ = np.full(256, -1, np.int64)
    for i in range(n):
        if sp.is_byte(i):
            bytes_[int(pieces[i][3:5], 16)] = i
    normal = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
    return Vocabulary(pieces, np.array([sp.get_score(i) for i in range(n)]), normal, bytes_, sp.unk_id())


@dataclass
class Trie:
    """Nodes of a trie of words; node 0 is the root."""

    parent: np.ndarray
    score: np.ndarray  # forward: the best path from the root
    gap: np.ndarray  # to the second-best arc into the node (infinite without one)
    tokens: np.ndarray  # ids on the best path
    arc: np.ndarray  # letters of the best last piece
    piece: np.ndarray  # that piece, -1: unknown character
    end: np.ndarray  # node of each word


#: Words of more characters are chains of their own: they have nothing to share that would pay for a step of arrays per character.
LONG = 400


def chain(word: str, vocabulary: Vocabulary) -> tuple[list, ...]:
    """(score, gap, tokens, arc, piece) of every prefix of one word."""
    index, scores, longest, lone = vocabulary.index, vocabulary.scores.tolist(), vocabulary.longest, vocabulary.unknown_score
    score, gap, tokens, arc, piece = [0.0], [], [0], [], []
    infinite = float("inf")
    for stop in range(1, len(word) + 1):
        best, second, size_, piece_ = -infinite, -infinite, 1, -1
        for size in range(1, min(stop, longest) + 1):
            found = index.get(word[stop - size:stop])
            if found is None and size > 1:
                continue
            value = score[stop - size] + (lone if found is None else scores[found])
            if value > best:
                best, second, size_, piece_ = value, best, size, -1 if found is None else found
            elif value > second:
                second = value
        score.append(best)
        gap.append(best - second)
        arc.append(size_)
        piece.append(piece_)
        tokens.append(tokens[stop - size_] + (1 if piece_ >= 0 else len(word[stop - 1].encode("utf-8", "surrogatepass"))))
    return score[1:], gap, tokens[1:], arc, piece


def forward(words: list[str], vocabulary: Vocabulary) -> Trie:
    """Insert distinct words into a trie and compute every node's best forward score once; very long words hang from the root as chains."""
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    if not long:
        return _shared(words, vocabulary)
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    trie = _shared([words[i] for i in short], vocabulary)
    parts, end, used = [trie], np.zeros(len(words), np.int64), len(trie.parent)
    end[short] = trie.end
    for i in long:
        score, gap, tokens, arc, piece = chain(words[i], vocabulary)
        above = np.arange(used - 1, used - 1 + len(score))
        above[0] = 0
        parts.append(Trie(above, np.array(score), np.array(gap), np.array(tokens, np.int64), np.array(arc, np.int32), np.array(piece, np.int32), np.zeros(0, np.int64)))
        used += len(score)
        end[i] = used - 1
    return Trie(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("parent", "score", "gap", "tokens", "arc", "piece")), end)


def _shared(words: list[str], vocabulary: Vocabulary) -> Trie:
    order = sorted(range(len(words)), key=words.__getitem__)
    flat = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(words[i]) for i in order), np.int64, len(order))
    starts = np.cumsum(lengths) - lengths
    wide = np.where(flat < 0x80, 1, np.where(flat < 0x800, 2, np.where(flat < 0x10000, 3, 4)))
    letters = vocabulary.letter[flat]
    room = len(flat) + 1
    parent, char = np.zeros(room, np.int64), np.zeros(room, np.int32)
    score, gap = np.zeros(room), np.full(room, np.inf)
    tokens, arc, piece = np.zeros(room, np.int64), np.zeros(room, np.int32), np.full(room, -1, np.int32)
    at = np.zeros(len(order), np.int64)  # node of each word so far
    live, depth, used = np.flatnonzero(lengths > 0), 0, 1
    while len(live):
        here = starts[live] + depth
        code, above = flat[here], at[live]
        new = np.ones(len(live), bool)  # words are sorted, so equal prefixes are neighbours
        new[1:] = (code[1:] != code[:-1]) | (above[1:] != above[:-1])
        at[live] = used + np.cumsum(new) - 1
        first = here[new]
        nodes = np.arange(used, used + len(first))
        used += len(first)
        parent[nodes], char[nodes] = above[new], letters[first]
        best, second = np.full(len(nodes), -np.inf), np.full(len(nodes), -np.inf)
        single = np.zeros(len(nodes), bool)
        rows, node, state = np.arange(len(nodes)), nodes, np.zeros(len(nodes), np.int32)
        for size in range(1, min(depth + 1, vocabulary.longest) + 1):
            state = vocabulary.step(state, char[node])
            keep = state >= 0
            rows, node, state = rows[keep], parent[node[keep]], state[keep]
            if not len(rows):
                break
            found = vocabulary.piece_at[state]
            hit = np.flatnonzero(found >= 0)
            to, value = rows[hit], score[node[hit]] + vocabulary.scores[found[hit]]
            better = value > best[to]
            second[to] = np.where(better, best[to], np.maximum(second[to], value))
            up = to[better]
            best[up], arc[nodes[up]], piece[nodes[up]] = value[better], size, found[hit[better]]
            tokens[nodes[up]] = tokens[node[hit[better]]] + 1
            if size == 1:
                single[to] = True
            keep = node > 0
            rows, node, state = rows[keep], node[keep], state[keep]
        lone = np.flatnonzero(~single)  # no piece spells the character: it is unknown
        value = score[parent[nodes[lone]]] + vocabulary.unknown_score
        better = value > best[lone]
        second[lone] = np.where(better, best[lone], np.maximum(second[lone], value))
        up = lone[better]
        best[up], arc[nodes[up]], piece[nodes[up]] = value[better], 1, -1
        tokens[nodes[up]] = tokens[parent[nodes[up]]] + wide[first[up]]
        score[nodes], gap[nodes] = best, best - second
        depth += 1
        live = live[lengths[live] > depth]
    end = np.empty(len(order), np.int64)
    end[order] = at
    return Trie(parent[:used], score[:used], gap[:used], tokens[:used], arc[:used], piece[:used], end)
