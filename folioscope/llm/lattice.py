"""Piece lattices of many strings at once.

Strings are laid end to end; an edge is a vocabulary piece at a place of one of
them. Edges are found for all strings by rolling hashes and a hash table, and
dynamic programmes run over all strings together, one relative place at a time:
the edges that leave one place of a string end at different places, so a step is
plain indexing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from . import bytes_np

SPACE, ESCAPED = 0x2581, 0x110000  # the sign for a space in pieces; what stands for that sign itself
BITS = 20


class Vocabulary:
    """The pieces of a sentencepiece model, with scores, and its byte pieces."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = np.array(usable, np.int32)
        self.pieces = [sp.id_to_piece(i) for i in usable]
        self.scores = np.array([sp.get_score(i) for i in usable])
        self.cost = self.scores.tolist()
        self.unknown = float(self.scores[self.scores > -1e8].min()) - 10.0  # of a character that no piece has alone
        self.longest = max(map(len, self.pieces))
        self.index = {p: k for k, p in enumerate(self.pieces)}
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
        if any("▁" in p.lstrip("▁") or "\n" in p or " " in p for p in self.pieces):
            raise ValueError("pieces of this model go past the ends of words")
        self.bytes_of = [b""] * sp.get_piece_size()
        for i, p in zip(usable, self.pieces, strict=True):
            self.bytes_of[i] = p.replace("▁", " ").encode()
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                self.bytes_of[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self._build()

    def _build(self) -> None:
        """Two tables: a piece is in the second if its slot in the first is taken."""
        self.keys = np.array([self._hash(np.array([ord(c) for c in p], np.uint64)) for p in self.pieces], np.uint64)
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one hash")
        self.first, self.second = np.full(1 << BITS, -1, np.int32), np.full(1 << BITS, -1, np.int32)
        for k, key in enumerate(self.keys):
            a, b = int(key) >> (64 - BITS), int(key) & ((1 << BITS) - 1)
            if self.first[a] < 0:
                self.first[a] = k
            elif self.second[b] < 0:
                self.second[b] = k
            else:
                raise ValueError("the tables are too small")

    @staticmethod
    def _hash(chars: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in chars:
            h = h * bytes_np.BASE + c + np.uint64(1)  # a character 0 counts too
        return bytes_np.mix(h)[0]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The pieces with these hashes, -1 where there is none."""
        got = self.first[(keys >> np.uint64(64 - BITS)).astype(np.int64)]
        wrong = (got < 0) | (self.keys[got] != keys)
        other = self.second[(keys[wrong] & np.uint64((1 << BITS) - 1)).astype(np.int64)]
        got[wrong] = np.where((other >= 0) & (self.keys[other] == keys[wrong]), other, -1)
        return got


@lru_cache(maxsize=4)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


@dataclass
class Edges:
    """Edges of strings laid end to end, ordered by the relative place where they start.

    node k is the place before character k of its string; string i has the nodes
    starts[i] .. starts[i] + lengths[i]. piece: -1 for a character by itself.
    groups[t] .. groups[t + 1]: the edges that leave relative place t.
    """

    chars: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    groups: np.ndarray

    @property
    def nodes(self) -> int:
        return len(self.chars) + len(self.starts)


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    chars = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    chars[chars == SPACE] = ESCAPED
    chars[chars == 32] = SPACE
    return chars, lengths


def edges(vocab: Vocabulary, strings: list[str]) -> Edges:
    """All pieces in all strings; a space stands for the sign for one."""
    chars, lengths = code_points(strings)
    of = np.repeat(np.arange(len(strings)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)))
    relative = np.arange(len(chars)) - first[of]
    left = lengths[of] - relative
    source, size, piece = [], [], []
    h = np.zeros(len(chars), np.uint64)
    at = np.arange(len(chars))
    for n in range(1, vocab.longest + 1):
        keep = left[at] >= n
        at, h = at[keep], h[keep]
        if not len(at):
            break
        h = h * bytes_np.BASE + chars[at + n - 1] + np.uint64(1)
        got = vocab.find(bytes_np.mix(h))
        hit = np.flatnonzero(got >= 0) if n > 1 else np.arange(len(at))
        source.append(at[hit])
        piece.append(got[hit])
        size.append(np.full(len(hit), n))
    source, size, piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (source, size, piece))
    rel = relative[source] if len(source) else source
    order = np.argsort(rel.astype(np.uint16) if len(lengths) and lengths.max() < 65536 else rel, kind="stable")  # 16 bits: a radix sort
    source, size, piece, rel = source[order], size[order], piece[order], rel[order]
    node = source + (of[source] if len(source) else 0)  # a string of n characters has n + 1 nodes
    most = int(lengths.max()) if len(lengths) else 0
    return Edges(chars, first[:-1] + np.arange(len(strings)), lengths, node, node + size, piece, np.searchsorted(rel, np.arange(most + 1)))


def best_two(e: Edges, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Viterbi: the best and second-best score of each node, and the edge that ends its best path."""
    one, two = np.full(e.nodes, -np.inf), np.full(e.nodes, -np.inf)
    back = np.full(e.nodes, -1, np.int64)
    one[e.starts] = 0.0
    for a, b in zip(e.groups[:-1], e.groups[1:], strict=True):
        s, t = e.source[a:b], e.target[a:b]
        v, w, old = one[s] + score[a:b], two[s] + score[a:b], one[t]
        two[t] = np.maximum(np.minimum(old, v), np.maximum(two[t], w))
        better = v > old
        one[t[better]] = v[better]
        back[t[better]] = np.arange(a, b)[better]
    return one, two, back


def best_paths(e: Edges, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges of the best paths, string after string; their number in each string)."""
    at, who, found, owner = e.starts + e.lengths, np.arange(len(e.starts)), [], []
    while len(who):
        live = at > e.starts[who]
        at, who = at[live], who[live]
        step = back[at]
        found.append(step)
        owner.append(who)
        at = e.source[step]
    path, owner = np.concatenate(found or [np.empty(0, np.int64)]), np.concatenate(owner or [np.empty(0, np.int64)])
    order = np.lexsort((-np.arange(len(path)), owner))  # last edges were found first
    return path[order], np.bincount(owner, minlength=len(e.starts))


def total(e: Edges, p: np.ndarray) -> np.ndarray:
    """Forward sums over all paths to each node, a column for each column of p (edges x models)."""
    alpha = np.zeros((e.nodes, p.shape[1]))
    alpha[e.starts] = 1.0
    for a, b in zip(e.groups[:-1], e.groups[1:], strict=True):
        alpha[e.target[a:b]] += alpha[e.source[a:b]] * p[a:b]
    return alpha


def total_back(e: Edges, p: np.ndarray) -> np.ndarray:
    """Sums over all paths from each node to its string's end."""
    beta = np.zeros((e.nodes, p.shape[1]))
    beta[e.starts + e.lengths] = 1.0
    for a, b in zip(e.groups[:-1][::-1], e.groups[1:][::-1], strict=True):
        s = e.source[a:b]
        order = np.argsort(s, kind="stable")
        s = s[order]
        head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else s
        if len(s):
            beta[s[head]] += np.add.reduceat((beta[e.target[a:b]] * p[a:b])[order], head, axis=0)
    return beta
