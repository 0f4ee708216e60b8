"""Vectorised splitting and hashing of UTF-8 texts with numpy.

Texts are joined into blocks of a few MB, so that a corpus of short documents
costs no Python call per word, and a long document no more memory than itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK_BYTES = 1 << 18


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Powers:
    """base**i and base**-i modulo 2**64, kept as far as blocks of short texts need them; longer ones are made anew."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(n, BASE), np.full(n, np.uint64(_inverse(int(BASE))))
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > BLOCK_BYTES + 1:
            return self._made(n)
        if len(self.up) < n:
            self.up, self.down = self._made(BLOCK_BYTES + 1)
        return self.up[:n], self.down[:n]


POWERS = Powers()
#: Bytes that separate words: space and 9-13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES, at least one text each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, a space after each, and where each begins (and the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs that aren't white space; data ends with a space."""
    inside = ~IS_SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span."""
    up, down = POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of `width` words.

    A-Z are lower-cased; words are runs of anything but ASCII white space. A text
    of fewer words has one shingle, the whole sequence; one without words, none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in blocks(raw):
        data, at = joined(raw[a:b])
        data = LOWER[data]
        starts, ends = word_spans(data)
        words = span_hashes(data, starts, ends)
        first = np.searchsorted(starts, at)
        whole = len(words) - width + 1
        if whole > 0:
            rolled = words[:whole].copy()
            for k in range(1, width):
                rolled = mix(rolled * BASE + words[k : whole + k])
        for k in range(b - a):
            s, e = int(first[k]), int(first[k + 1])
            if e - s >= width:
                h = np.sort(rolled[s : e - width + 1])
                yield h[np.concatenate(([True], h[1:] != h[:-1]))]
            elif e > s:
                h = words[s : s + 1].copy()
                for word in words[s + 1 : e]:
                    h = mix(h * BASE + word)
                yield mix(h + np.uint64(e - s))
            else:
                yield np.empty(0, np.uint64)
