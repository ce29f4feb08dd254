"""Deep-shallow sorting of suffixes, and the classes that equal prefixes form in their order.

Shallow part: multikey quicksort.  A segment of suffixes that agree up to a
depth is split in three by a pivot, the median of three of its suffixes' next
eight bytes: smaller ones, larger ones and equal ones, which go on eight bytes
deeper.  All segments advance side by side down to a fixed depth.  Deep part:
what still shares that prefix is inserted into a blind trie, which keeps only
the places where suffixes branch: a search follows the branching bytes without
looking at those between, compares the suffix with the one leaf that it ends
at, and so learns where it belongs.
"""

from __future__ import annotations

import numpy as np


class _Branch:
    __slots__ = ("depth", "below")

    def __init__(self, depth: int, below: dict) -> None:
        self.depth, self.below = depth, below


class BlindTrie:
    """Suffixes by their branching places; equal ones share a leaf."""

    def __init__(self, suffixes: list[bytes]) -> None:
        self.suffixes = suffixes
        self.root: _Branch | list[int] | None = None

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        """Length of the common prefix."""
        n = min(len(a), len(b))
        differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (differ.bit_length() + 7) // 8

    def insert(self, i: int) -> None:
        s, node = self.suffixes[i], self.root
        if node is None:
            self.root = [i]
            return
        while isinstance(node, _Branch):  # blind descent
            node = node.below.get(self._at(s, node.depth)) or next(iter(node.below.values()))
        other = self.suffixes[node[0]]
        n = self.common(s, other)
        if n == len(s) == len(other):
            node.append(i)
            return
        above, node = None, self.root
        while isinstance(node, _Branch) and node.depth < n:
            above, node = node, node.below[self._at(s, node.depth)]
        if isinstance(node, _Branch) and node.depth == n:
            node.below[self._at(s, n)] = [i]
            return
        branch = _Branch(n, {self._at(other, n): node, self._at(s, n): [i]})
        if above is None:
            self.root = branch
        else:
            above.below[self._at(s, above.depth)] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, _Branch):
                stack += [node.below[c] for c in sorted(node.below, reverse=True)]
            elif node:
                out += node
        return out


def multikey_quicksort(table: np.ndarray, order: np.ndarray, head: np.ndarray, skip: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a byte table in the order of ``shallow`` bytes behind the first ``skip``, within the segments that head begins.

    Returns the order and the begins of the segments that are equal so far.
    """
    order, head, depth = order.copy(), head.copy(), np.full(len(order), skip)
    while True:
        size = np.diff(np.append(np.flatnonzero(head), len(head)))
        at = np.flatnonzero((np.repeat(size, size) > 1) & (depth < skip + shallow))
        if not len(at):
            return order, head
        word = np.ascontiguousarray(table[order[at][:, None], depth[at][:, None] + np.arange(8)]).view(">u8").reshape(-1).astype(np.uint64)
        first = np.flatnonzero(head[at])
        last = np.append(first[1:], len(at)) - 1
        three = np.sort(np.column_stack((word[first], word[(first + last) // 2], word[last])), axis=1)
        segment = np.cumsum(head[at]) - 1
        pivot = three[segment, 1]
        side = (word > pivot).astype(np.int8) - (word < pivot)
        to = np.lexsort((side, segment))
        order[at], side = order[at][to], side[to]
        depth[at] += 8 * (side == 0)
        head[at[1:]] |= (side[1:] != side[:-1]) & (segment[1:] == segment[:-1])


def sort_suffixes(suffixes: list[bytes], group: np.ndarray, skip: int = 0, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The order by group and suffix, and each one's common prefix with the one before (-1 at a group's first).

    The first ``skip`` bytes are equal within a group.
    """
    n = len(suffixes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = np.array([len(s) for s in suffixes])
    width = max(8, int(length.max()), skip + shallow)
    table = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in suffixes]), np.uint8).reshape(n, width)
    order = np.argsort(group, kind="stable")
    head = np.append(True, group[order][1:] != group[order][:-1])
    if skip and not ((table[order[1:], :skip] == table[order[:-1], :skip]).all(axis=1) | head[1:]).all():
        skip = 0  # the group's key was one hash of two beginnings
    order, head = multikey_quicksort(table, order, head, skip, shallow)
    at = np.append(np.flatnonzero(head), n)
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a > 1:
            trie = BlindTrie([suffixes[i][skip:] for i in order[a:b]])
            for i in range(b - a):
                trie.insert(i)
            order[a:b] = order[a:b][trie.ordered()]
    rows, size = table[order], length[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.append(-1, common)


def classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A class number for each suffix: equal for those with equal prefixes of a depth (of those that long)."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out
