"""Connected components of a graph of links, by alternating stars.

Every round shuffles the links a fixed number of times and writes them to the
shared folder; the number of rounds grows with the logarithm of the longest
chain.  Minima are aggregated before they are joined, so a node with very many
links is a skewed join, which Spark splits, and never one task's group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.storage import Stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in links(a, b); component is the smallest node reachable.

    Links may repeat, point either way or lead from a node to itself; rows with
    a null end are ignored.  Nodes without links aren't in the result.
    """
    pairs = (
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    now = Stored(pairs, "links")
    state = _state(now.rows)
    while True:
        after = Stored(_small_star(_large_star(now.rows)), "links")
        now.drop()
        now, before, state = after, state, _state(after.rows)
        if state == before:
            break
    roots = now.rows.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def _state(pairs: DataFrame) -> tuple:
    """Equal before and after a round only if the round changed nothing."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("bigint"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


class Forest:
    """A spanning forest of the pairs that are added."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        label = self.label
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def roots(self) -> np.ndarray:
        """Every node's root."""
        while True:
            up = self.label[self.label]
            if (up == self.label).all():
                return self.label
            self.label[:] = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds pairs; those that join two trees become edges."""
        label = self.roots()
        apart = label[a] != label[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            rx, ry = self._root(x), self._root(y)
            if rx != ry:
                self.label[max(rx, ry)] = min(rx, ry)
                self.edges.append((x, y))
