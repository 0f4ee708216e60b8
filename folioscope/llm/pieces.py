"""Encoding, n-best segmentation and decoding over a public piece vocabulary.

The score of a segmentation is the sum of its pieces' scores; a character that is
no piece costs `unknown` and is written as its UTF-8 byte pieces, so decoding is
exact for every text. The forward Viterbi scores of a lattice's nodes are exact
costs to go for a search from its end, so backward A-star pops segmentations in
order of their score, the best one straight along the Viterbi path. A node is
expanded n times at most: the n best segmentations pass it by n best ways. Of
equal scores the one nearer to the beginning goes first, so ties, as in a run of
spaces, cost no more than other words.

No piece goes past the end of a word or holds a line feed, so a text's lattice is
a chain of its words' lattices. Each distinct word is solved once per worker. A
text's n-best list differs from its best one in the words whose second-best
segmentation is least behind, and only those words are searched by A-star; their
ids in each of the text's n best segmentations take the place of those of the best.

A word over LONG characters is solved by itself in memory in proportion to it.

Defined cases: null counts as the empty text, whose one segmentation is the sign
for the space that is put before every text; of segmentations that score the same
any order may come; repeated rows give repeated results; other columns pass
through unless the output has a column of that name.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .store import claim, trim, tune, unused

#: A line feed; spaces with the word after them; a word without a space before it.
WORDS = re.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Stands for the sign for a space where a text has that sign itself.
HIDDEN = "\U0010ffff"
N_BEST = 4
#: Distinct words remembered by a worker.
CACHE = 1 << 18
#: Ids and searched words remembered by a worker, and characters of a word that isn't solved together with others.
CACHE_IDS, CACHE_LISTED, LONG = 1 << 22, 1 << 13, 1024
BLOCK_CHARS = 1 << 18


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _shown(word: str) -> str:
    return word.replace("▁", HIDDEN).replace(" ", "▁")


def _into(vocab: lattice.Vocabulary, shown: str, target: int) -> list[tuple[int, int, float]]:
    """The edges that end at a place: (place they start from, piece, score)."""
    known, out = vocab.index, []
    for source in range(max(0, target - vocab.longest), target):
        piece = known.get(shown[source:target], -1)
        if piece >= 0:
            out.append((source, piece, vocab.cost[piece]))
        elif target - source == 1:
            out.append((source, -1, vocab.unknown))
    return out


def _forward(vocab: lattice.Vocabulary, shown: str) -> tuple[list[float], list[float], list[tuple[int, int]]]:
    """Viterbi scores of all places, second-best ones, and the last edge (source, piece) of each best path."""
    one, two, back = [0.0], [-float("inf")], [(-1, -1)]
    for target in range(1, len(shown) + 1):
        best = second = -float("inf")
        edge = (-1, -1)
        for source, piece, cost in _into(vocab, shown, target):
            score = one[source] + cost
            if score > best:
                best, second, edge = score, max(best, two[source] + cost), (source, piece)
            else:
                second = max(second, score)
        one.append(best)
        two.append(second)
        back.append(edge)
    return one, two, back


def _spelled(vocab: lattice.Vocabulary, word: str, place: int, piece: int) -> list[int]:
    return [int(vocab.ids[piece])] if piece >= 0 else [int(vocab.byte_ids[b]) for b in word[place].encode("utf-8", "surrogatepass")]


def a_star(vocab: lattice.Vocabulary, word: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a word (a leading space is part of it): (score, ids), best first."""
    shown, end = _shown(word), len(word)
    ahead, _, _ = _forward(vocab, shown)  # the cost to go of the backward search
    order, popped, edges = count(), [0] * (end + 1), {}
    heap = [(-ahead[end], end, next(order), 0.0, None)]
    out = []
    while heap and len(out) < n:
        _, node, _, done, path = heapq.heappop(heap)
        if node == 0:
            ids = []
            while path:
                source, piece, path = path
                ids += _spelled(vocab, word, source, piece)
            out.append((done, ids))
            continue
        if popped[node] == n:
            continue
        popped[node] += 1
        if node not in edges:
            edges[node] = _into(vocab, shown, node)
        for source, piece, cost in edges[node]:
            if popped[source] < n:
                heapq.heappush(heap, (-(done + cost + ahead[source]), source, next(order), done + cost, (source, piece, path)))
    return out


def _utf8(char: int) -> bytes:
    return chr({lattice.ESCAPED: lattice.SPACE, lattice.SPACE: 32}.get(char, char)).encode("utf-8", "surrogatepass")


class Encoder:
    """Solves words once and remembers them."""

    def __init__(self, model: str):
        self.vocab = lattice.vocabulary(model)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.best, self.gap, self.size = np.empty(0), np.empty(0), np.empty(0, np.int64)
        self.begin, self.flat = np.empty(0, np.int64), np.empty(0, np.int32)
        self.listed: dict[tuple[str, int], list[tuple[float, np.ndarray]]] = {}

    def learn(self, words: list[str]) -> None:
        for w in words:
            if len(w) > LONG:
                self._learn_long(w)
        v, words = self.vocab, [w for w in words if len(w) <= LONG]
        e = lattice.edges(v, words)
        score = np.where(e.piece >= 0, v.scores[e.piece], v.unknown)
        one, two, back = lattice.best_two(e, score)
        path, number = lattice.best_paths(e, back)
        piece = e.piece[path]
        ids, width = v.ids[piece], np.ones(len(path), np.int64)
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            owner = np.repeat(np.arange(len(words)), number)
            spelled = [[int(v.byte_ids[b]) for b in _utf8(int(c))] for c in e.chars[e.source[path[odd]] - owner[odd]]]
            width[odd] = [len(x) for x in spelled]
            where = np.concatenate(([0], np.cumsum(width)))
            ids = np.repeat(ids, width)
            for k, x in zip(odd, spelled, strict=True):
                ids[where[k] : where[k] + len(x)] = x
        cut = np.concatenate(([0], np.cumsum(number)))
        spent = np.concatenate(([0], np.cumsum(width)))[cut]
        ends = e.starts + e.lengths
        for k, w in enumerate(words):
            self.slot[w] = len(self.best) + k
        self.best, self.gap = np.concatenate((self.best, one[ends])), np.concatenate((self.gap, one[ends] - two[ends]))
        self.size, self.begin = np.concatenate((self.size, np.diff(spent))), np.concatenate((self.begin, spent[:-1] + len(self.flat)))
        self.flat = np.concatenate((self.flat, ids.astype(np.int32)))

    def _learn_long(self, word: str) -> None:
        one, two, back = _forward(self.vocab, _shown(word))
        path, at = [], len(word)
        while at:
            path.append(back[at])
            at = back[at][0]
        ids = np.fromiter(chain.from_iterable(_spelled(self.vocab, word, *edge) for edge in reversed(path)), np.int32)
        self.slot[word] = len(self.best)
        self.best, self.gap = np.append(self.best, one[-1]), np.append(self.gap, one[-1] - two[-1])
        self.size, self.begin, self.flat = np.append(self.size, len(ids)), np.append(self.begin, len(self.flat)), np.concatenate((self.flat, ids))

    def slots(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of the texts (a space is put before each), the slots of all, and where each text's begin."""
        split = [WORDS.findall(" " + t) for t in texts]
        if len(self.slot) > CACHE or len(self.flat) > CACHE_IDS:
            self.clear()
        new = {w for words in split for w in words if w not in self.slot}
        if new:
            self.learn(list(new))
        sizes = [len(w) for w in split]
        flat = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        return split, flat, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def ids(self, slots: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.begin[slots], self.size[slots])]

    def ways(self, word: str, n: int) -> list[tuple[float, np.ndarray]]:
        """How far the word's n best segmentations are behind its best, and their ids, all of which decode to the word."""
        if (word, n) not in self.listed:
            found = a_star(self.vocab, word, n)
            if len(self.listed) > CACHE_LISTED:
                self.listed.clear()
            best, raw = self.ids(np.array([self.slot[word]])), word.encode("utf-8", "surrogatepass")
            others = [(max(0.0, found[0][0] - s), np.array(ids, np.int32)) for s, ids in found if ids != best.tolist()]
            self.listed[word, n] = [(0.0, best), *others[: n - 1]]  # of those that score the same, that of best_paths comes first
            if any(self._bytes(ids) != raw for _, ids in self.listed[word, n]):
                raise ValueError("a segmentation does not decode to its word")
        return self.listed[word, n]

    def nearest(self, words: list[str], slots: np.ndarray, n: int) -> list[tuple[float, list[tuple[int, np.ndarray]]]]:
        """How far the n best segmentations of a text are behind its best, and the (place, ids) of the words that differ, in page order."""
        behind = self.gap[slots]
        if len(behind) > n - 1:
            near = np.argpartition(behind, n - 2)[: n - 1] if n > 1 else np.empty(0, np.int64)
            near = near[np.lexsort((near, behind[near]))]
        else:
            near = np.argsort(behind, kind="stable")
        found: list[tuple[float, list[tuple[int, np.ndarray]]]] = [(0.0, [])]
        for k in near[np.isfinite(behind[near])].tolist():
            ways = self.ways(words[k], n)
            found = sorted(((a + b, [*other, (k, ids)] if x else other) for a, other in found for x, (b, ids) in enumerate(ways)), key=lambda f: f[0])[:n]
        return [(a, sorted(other, key=lambda o: o[0])) for a, other in found]

    def parts(self, best: np.ndarray, ends: np.ndarray, sizes: np.ndarray, other: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """The ids of a segmentation, in parts: those of the best one but for the words that differ. ends, sizes: of the words' ids in best."""
        out, at = [], 0
        for k, ids in other:
            out += [best[at : int(ends[k] - sizes[k])], ids]
            at = int(ends[k])
        return [*out, best[at:]]

    def segmentations(self, words: list[str], slots: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a text: (score, ids), best first."""
        best, sizes, top = self.ids(slots), self.size[slots], float(self.best[slots].sum())
        ends = np.cumsum(sizes)
        return [(top - s, np.concatenate(self.parts(best, ends, sizes, other))) for s, other in self.nearest(words, slots, n)]

    def n_best(self, words: list[str], slots: np.ndarray, n: int) -> list[float]:
        """Scores of the n best segmentations of a text."""
        top = float(self.best[slots].sum())
        return [top - s for s, _ in self.nearest(words, slots, n)]

    def rows(self, texts: list[str], n: int, with_ids: bool) -> Iterator[list[tuple]]:
        """Some texts at a time; for each n_pieces, ids_crc32, n_best_scores, n_best_pieces, n_best_crc32, round_trip and, if asked for, ids and n_best_ids."""
        for some in text_blocks(texts):
            words, flat, at = self.slots(some)
            sizes, all_ids = self.size[flat], self.ids(flat)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            raw, place, out = self._bytes(all_ids), 0, []
            for k, t in enumerate(some):
                a, b = int(at[k]), int(at[k + 1])
                best, own_ends, own = all_ids[ends[a] : ends[b]], ends[a + 1 : b + 1] - ends[a], b" " + t.encode("utf-8", "surrogatepass")
                # The words' other segmentations decode to the words, so a text's decode to it if its best one does.
                same = raw[place : place + len(own)] == own
                place += len(own)
                top, scores, counts, sums, lists = float(self.best[flat[a:b]].sum()), [], [], [], []
                for behind, other in self.nearest(words[k], flat[a:b], n):
                    parts, sum_ = self.parts(best, own_ends, sizes[a:b], other), 0
                    for part in parts:
                        sum_ = zlib.crc32(part, sum_)
                    scores.append(top - behind)
                    counts.append(sum(map(len, parts)))
                    sums.append(sum_)
                    if with_ids:
                        lists.append(np.concatenate(parts))
                row = (counts[0], sums[0], scores, counts, sums, same)
                out.append((*row, best, lists) if with_ids else row)
            yield out

    def _bytes(self, ids: np.ndarray) -> bytes:
        v = self.vocab
        return v.flat[_ranges(v.begin[ids], v.size[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8, without the space that was put before it."""
        return self._bytes(ids)[1:]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then those of begin[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


_encoders: dict[str, Encoder] = {}


def _forget() -> None:
    """A function of the module, so that a worker runs it on its own memory and no closure carries the driver's."""
    _encoders.clear()


def encoder(model: str) -> Encoder:
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def text_blocks(texts: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def encode_documents(documents: DataFrame, model: str | None = None, text: str = "text", n: int = N_BEST, with_ids: bool = False) -> DataFrame:
    """documents with the n best segmentations, best first: scores, numbers of pieces, crc32 of the ids and, if asked for, the ids.

    n_pieces, ids_crc32 and ids are of the best one; round_trip: all of them decode to the text.
    """
    tune(documents.sparkSession)
    path = model or model_path()
    kind = "n_pieces long, ids_crc32 long, n_best_scores array<double>, n_best_pieces array<long>, n_best_crc32 array<long>, round_trip boolean" + ", ids array<int>, n_best_ids array<array<int>>" * with_ids
    names = [f.split()[0] for f in kind.split(", ")]

    @F.pandas_udf(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("pieces", _forget)
        own = encoder(path)
        for batch in batches:
            for rows in own.rows([t or "" for t in batch.tolist()], n, with_ids):
                yield pd.DataFrame(rows, columns=names)
            trim()

    name = unused(documents, "encoded")
    out = documents.withColumn(name, encoded(F.col(text)))
    return out.select(*[c for c in documents.columns if c not in names], *[F.col(f"{name}.{c}").alias(c) for c in names])
