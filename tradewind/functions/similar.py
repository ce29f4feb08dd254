"""The matching-block ratio of strings, and joins of strings by it."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from itertools import combinations
from math import ceil, floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: The most characters of a short string, of which subsequences are keys, and of a middle one.
SHORT, MIDDLE = 14, 40


@pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks, the longest first, over the characters of both; of two empty strings 1."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def _ratio_from(least: float) -> Callable[..., Column]:
    """block_ratio() where it is ``least`` or more; else it may be null."""

    @pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        met = (SequenceMatcher(None, x, y) for x, y in zip(a, b))
        return pd.Series([m.ratio() if m.quick_ratio() >= least else None for m in met], dtype=float)

    return ratio


def _grams(s: str) -> Column:
    """A string's pairs of neighbouring characters, each with its running number among equal ones; of short strings the string itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(F.col(s), i, F.lit(2)))
    numbered = F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, 1, i + 1), lambda h: h == g)).cast("string")))
    return F.when(F.length(s) >= 2, numbered).otherwise(F.array(s))


def _spread(n: int, least: float) -> range:
    """The lengths that a partner of a string of n characters can have."""
    return range(ceil(round(n * least / (2 - least), 9)), floor(round(n * (2 - least) / least, 9)) + 1)


def _class(n: int) -> int:
    """0 for short strings, 1 for middle ones, 2 for long ones."""
    return (n > SHORT) + (n > MIDDLE)


def _subsequences(least: float) -> Callable[..., Column]:
    """Of a short string all that is left in common with a short partner: a pair has so many characters in blocks, in order."""

    @pandas_udf("array<string>")
    def keys(s: pd.Series) -> pd.Series:
        def of(x: str) -> list[str]:
            n = len(x)
            left = {ceil(round((n + m) * least / 2, 9)) for m in _spread(n, least) if m <= SHORT}
            return list({"".join(c) for k in left for c in combinations(x, k)})

        return s.map(of)

    return keys


def _combined(least: float, first: bool) -> Callable[..., Column]:
    """Keys out of a string's kept pairs of characters, beginning with its class and a partner's, the left string's first.

    Where one of both is long a key is one pair of characters, else three.
    """

    @pandas_udf("array<string>")
    def keys(s: pd.Series, kept: pd.Series) -> pd.Series:
        def of(x: str, grams: list[str]) -> list[str]:
            own, found = _class(len(x)), []
            for other in {_class(m) for m in _spread(len(x), least)}:
                if max(own, other):
                    together = 3 if max(own, other) == 1 else 1
                    among = grams if together == 3 else grams[: len(grams) - 2]
                    found += [f"{own if first else other}{other if first else own}" + "".join(c) for c in combinations(among, together)]
            return found

        return pd.Series([of(x, list(g)) for x, g in zip(s, kept)], dtype=object)

    return keys


def _kept(strings: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """(s, kept): of each string(s, grams) the rarest grams, the rarest first, of which a partner has three.

    A partner of n characters shares at least ``least / 2`` of both lengths in
    blocks, so no fewer than ``1.5 * least - 1`` of them, less one, as pairs; it
    is ``least / (2 - least)`` as long at least.  All but the last two of these
    grams hold one of a partner's.
    """
    n = F.length("s")
    short = F.ceil(F.round(n * (least / (2 - least)), 9))
    shared = F.ceil(F.round((n + short) * (1.5 * least - 1) - 1, 9))
    held = strings.select("s", F.explode("grams").alias("gram")).join(frequency, "gram")
    ranked = held.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("df", "gram")))["gram"].alias("all"))
    return ranked.select("s", F.slice("all", F.lit(1), (n - 1 - shared + 3).cast("int")).alias("kept"))


def _keyed(strings: DataFrame, grams: DataFrame, frequency: DataFrame, least: float, first: bool) -> DataFrame:
    """(s, key) by which strings meet."""
    short = strings.where(F.length("s") <= SHORT).select("s", F.explode(_subsequences(least)("s")).alias("key"))
    longer = _kept(grams, frequency, least).select("s", F.explode(_combined(least, first)("s", "kept")).alias("key"))
    # a hash is enough: ratios are computed for all that meet
    return short.unionByName(longer).select("s", F.xxhash64("key").alias("key"))


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of left(s) and right(s) that may have the ratio; short ones have as many characters in common, in order.

    The longer string of a pair decides by which keys it meets: up to SHORT
    characters by what is left of both when all but the characters in blocks are
    deleted; up to MIDDLE by three of their rarest pairs of characters, beyond
    by one.  Frequent pairs of characters are never joined on.
    """
    # strings are few bytes and many keys: they are spread by number, not by bytes
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, two = (x.select("s").where("s <> ''").distinct().repartition(parts, "s") for x in (left, right))
    reach = F.floor(F.round(F.length("s") * ((2 - least) / least), 9)) > SHORT
    first, second = (x.where(reach).withColumn("grams", _grams("s")) for x in (one, two))
    frequency = first.union(second).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    ours = _keyed(one, first, frequency, least, True).withColumnRenamed("s", "a")
    theirs = _keyed(two, second, frequency, least, False).withColumnRenamed("s", "b")
    # keys are many more than strings, whatever the planner takes them for
    met = ours.hint("merge").join(theirs, "key")
    return met.where(F.least(F.length("a"), F.length("b")) >= _blocks(least)).select("a", "b").distinct()


def _blocks(least: float) -> Column:
    """The characters that a and b have in blocks at least."""
    return F.ceil(F.round((F.length("a") + F.length("b")) * (least / 2), 9))


def similar_strings(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, ratio): all pairs of left(s) and right(s) of ratio ``least`` or more, above 0.8.

    Ratios are computed for candidates that have as many characters in common as
    it takes.
    """
    if not 0.8 < least <= 1:
        raise ValueError("least lies above 0.8: up to it, strings can be similar without a common pair of characters")
    ratio = _ratio_from(least)("a", "b")
    return candidates(left, right, least).withColumn("ratio", ratio).where(F.col("ratio") >= least)
