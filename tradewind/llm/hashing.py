"""Vectorised hashes of words, of runs of values and of numbers, for work inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

#: An odd base with its inverse modulo 2 ** 64, and what tells the hashes of words from others.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
WORDS = np.uint64(0x3C6EF372FE94F82B)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.cumprod(p)
    return _POWERS[base][:n]


class RunHashes:
    """Hashes of runs of a sequence's items: equal runs have equal hashes, wherever they stand.

    The value at a place stands for ``reach`` items from there on; runs hold at
    least so many.  Values that mix several items keep regular patterns of few
    items (which a plain polynomial modulo 2 ** 64 takes for each other) apart.
    """

    def __init__(self, values: np.ndarray, reach: int = 1) -> None:
        self.sums, self.reach = np.zeros(len(values) + 1, np.uint64), reach
        np.cumsum(values * _powers(BASE, len(values)), out=self.sums[1:])
        self.inverse = _powers(INVERSE, len(values) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the runs from begin to end, whose lengths count too."""
        h = (self.sums[end - (self.reach - 1)] - self.sums[begin]) * self.inverse[begin]
        return mix(h + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def fixed(self, length: int) -> np.ndarray:
        """Hashes of all runs of one length, by begin."""
        n = len(self.sums) - length
        on = length - self.reach + 1
        return mix((self.sums[on : on + n] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


#: Bytes that a value of byte_grams() stands for, and words of word_grams().
BYTE_REACH, WORD_REACH = 8, 2


def byte_grams(data: np.ndarray) -> np.ndarray:
    """A value for each place of a byte array, which mixes the eight bytes from there on."""
    padded = np.append(data, np.zeros(BYTE_REACH - 1, np.uint8))
    return mix(np.ndarray((len(data),), "<u8", padded, strides=(1,)) + np.uint64(1))


def word_grams(words: np.ndarray) -> np.ndarray:
    """A value for each word, which mixes it with the next one."""
    after = np.append(words[1:], np.uint64(0))
    return mix(words * np.uint64(0x9FB21C651E98DF25) + (after ^ (after >> np.uint64(31))))


#: Values of a byte at the first places of a word.
_PLACES = 64
_AT_PLACE = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) + WORDS)


class SpanHashes:
    """Hashes of words and of their beginnings: every byte and its place in the word give a random value, and the values are added up."""

    def __init__(self, data: np.ndarray, begin: np.ndarray) -> None:
        first = np.zeros(len(data), np.int64)
        first[begin] = begin
        at = np.arange(len(data)) - np.maximum.accumulate(first)
        which = at * 256 + data
        values = _AT_PLACE[np.minimum(which, len(_AT_PLACE) - 1)]
        if (far := np.flatnonzero(at >= _PLACES)).size:
            values[far] = mix(which[far].astype(np.uint64) + np.uint64(1) + WORDS)
        self.sums = np.append(np.uint64(0), np.cumsum(values))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes from words' begins to the given ends."""
        return mix(self.sums[end] - self.sums[begin] + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words_of(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts, and the number of words of each text."""
    hashes, counts = [], []
    at = 0
    while at < len(texts):  # about a megabyte at a time
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
            size += len(texts[to]) + 1
            to += 1
        joined = b"\n".join(texts[at:to]) + b"\n"
        data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        white = WHITE[data]
        begin = np.flatnonzero(~white[1:] & white[:-1]) + 1
        if not white[0]:
            begin = np.append(0, begin)
        end = np.flatnonzero(white[1:] & ~white[:-1]) + 1
        if len(begin):
            hashes.append(SpanHashes(data, begin).of(begin, end))
        stops = np.cumsum([len(t) + 1 for t in texts[at:to]])
        counts.append(np.diff(np.searchsorted(begin, stops), prepend=0))
        at = to
    none = np.zeros(0, np.uint64)
    return (np.concatenate(hashes) if hashes else none), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


def word_digest(texts: list[bytes]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that hashes the words from begins to ends (numbered over all texts) as their bytes, joined by one space."""
    data = b" ".join([b" ".join(t.split()) for t in texts])
    white = np.frombuffer(data, np.uint8) == 32
    # an empty text leaves two spaces side by side
    begin = np.flatnonzero(~white & np.append(True, white[:-1]))
    end = np.flatnonzero(~white & np.append(white[1:], True)) + 1

    def digest(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        pieces = zip(begin[first].tolist(), end[last - 1].tolist(), strict=True)
        return np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in pieces], np.uint64)

    return digest
