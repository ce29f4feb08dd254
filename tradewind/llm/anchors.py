"""Sampled k-mers that stand for all windows of a sequence.

A window of W values holds W - k + 1 k-mers; the one with the smallest hash
(the leftmost of equals) is the window's anchor.  Equal windows have equal
anchors at equal places, wherever they stand, so repeats are found among the
anchors, of which there are about 2 for every W - k + 2 values.  The windows
that share one anchor occurrence begin next to each other; the stretch from the
first one's begin to the last one's end is the occurrence's edge.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from tradewind.llm.hashing import RunHashes, mix

#: Hashes of the texts from begins to ends, told in items.
Digest = Callable[[np.ndarray, np.ndarray], np.ndarray]
_PLACE_BITS = 26
_BLOCK = 1 << 22


class Anchors(NamedTuple):
    """Anchor occurrences of a chunk's sequences, one after another."""

    key: np.ndarray  # hash of the k-mer
    edge: np.ndarray  # hash of the edge with the anchor's place in it
    place: np.ndarray  # of the k-mer
    first: np.ndarray  # begin of the first window
    last: np.ndarray  # begin of the last window
    owner: np.ndarray  # the sequence's number


def window_anchors(kmers: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of width neighbouring values, for every begin."""
    n = len(kmers) - width + 1
    out = np.zeros(max(n, 0), np.int64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        part = kmers[at : to + width - 1]
        m = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        if reach < width:
            m = np.minimum(m[: to - at], m[width - reach : width - reach + to - at])
        out[at:to] = (m[: to - at] & low).astype(np.int64) + at
    return out


def anchors_of(values: np.ndarray, lengths: np.ndarray, window: int, k: int, hashes: RunHashes, digest: Digest | None = None) -> Anchors:
    """Anchors of all sequences whose values follow each other in one array; edges by a digest of their text where it is given."""
    kmers = hashes.fixed(k)
    where = window_anchors(kmers, window - k + 1)
    ends = np.cumsum(lengths)
    room = np.maximum(lengths - window + 1, 0)  # begins of windows in each sequence
    owner = np.repeat(np.arange(len(lengths)), room)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room) + np.repeat(ends - lengths, room)
    at = where[begin]
    new = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at))[: len(head)] - 1
    place, first, last = at[head], begin[head], begin[tail] if len(head) else begin[:0]
    edge = mix((digest or hashes.of)(first, last + window) + (place - first).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    # anchors have small hashes: mixed again, their keys spread evenly over buckets
    return Anchors(mix(kmers[place]), edge, place, first, last, owner[head])


def covered(length: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marks of all places in any of the runs from begin to end."""
    step = np.bincount(begin, minlength=length + 1) - np.bincount(end, minlength=length + 1)
    return np.cumsum(step[:length]) > 0
