"""Searching cards by dimensions: a search string is read into conditions, and conditions are compiled to filters that reach the scan.

A search is read on the driver, once, whatever the number of cards: known
phrases by a trie, the longest first; numbers with comparisons; beginnings of
rarities; what is left are words of the name.  Conditions on plain columns
become comparisons of the column alone, joined by AND, so that the scan can
push them; those on arrays and on the texts follow.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {"=": lambda c, v: c == v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v}
#: Fewest letters of a beginning that stands for a value.
BEGINNING = 3


@dataclass(frozen=True)
class Condition:
    """A column's value: one of values for plain columns, a comparison, or values that an array holds (any or all of them)."""

    column: str
    values: tuple
    op: str = "="
    array: bool = False


@dataclass
class Catalogue:
    """What searches can name.

    phrases: (column, value) by phrase; arrays: the columns among them that are
    arrays; numbers: columns by the words for them; prefixes: columns whose
    values' beginnings count, with the values; price: the column for "under $5";
    texts: columns that words of the name are looked for in; names: the words of
    names, which single words of phrases may be as well.
    """

    phrases: dict[str, tuple[str, Any]]
    texts: tuple[str, ...]
    arrays: frozenset[str] = frozenset()
    numbers: dict[str, str] = field(default_factory=dict)
    prefixes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    price: str | None = None
    names: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.trie: dict = {}
        for phrase, said in self.phrases.items():
            at = self.trie
            for w in words(phrase):
                at = at.setdefault(w, {})
            at.setdefault(None, said)

    def longest(self, tokens: list[str], i: int) -> tuple[int, tuple[str, Any] | None]:
        """How many words from a place on are the longest known phrase, and what it says."""
        at, found = self.trie, (0, None)
        for n, w in enumerate(tokens[i:], 1):
            if w not in at:
                break
            at = at[w]
            if None in at:
                found = (n, at[None])
        return found

    def beginning(self, word: str) -> tuple[str, Any] | None:
        """The one value that a word is a beginning of."""
        if len(word) < BEGINNING:
            return None
        hits = [(c, v) for c, values in self.prefixes.items() for v in values if v.lower().startswith(word)]
        return hits[0] if len(hits) == 1 else None


@dataclass
class Search:
    """A search as conditions and words of the name."""

    conditions: list[Condition] = field(default_factory=list)
    name: list[str] = field(default_factory=list)


def folded(text: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", folded(text))


def _numbers(text: str, catalogue: Catalogue) -> tuple[str, list[Condition]]:
    """Comparisons ("lore>=2", "lore 3", "3 lore", "lore2", "under $5") taken out of a text."""
    found: list[Condition] = []
    if catalogue.price:
        for pattern, op in ((r"\b(?:under|below|less than)\s*\$?\s*(\d+(?:\.\d+)?)", "<"), (r"\b(?:over|above|more than)\s*\$?\s*(\d+(?:\.\d+)?)", ">")):
            for m in re.finditer(pattern, text):
                found.append(Condition(catalogue.price, (float(m[1]),), op))
            text = re.sub(pattern, " ", text)
    for word in sorted(catalogue.numbers, key=len, reverse=True):
        column, said = catalogue.numbers[word], re.escape(word)
        for pattern, number, op in ((rf"\b{said}\s*(>=|<=|=|>|<)?\s*(\d+(?:\.\d+)?)\b", 2, 1), (rf"\b(\d+(?:\.\d+)?)\s*{said}\b", 1, None)):
            for m in re.finditer(pattern, text):
                found.append(Condition(column, (float(m[number]),), (op and m[op]) or "="))
            text = re.sub(pattern, " ", text)
    return text, found


def parse(text: str, catalogue: Catalogue) -> list[Search]:
    """The readings of a search: one that takes every known word as a condition, and, where single words are words of names as well, one that keeps those as such."""
    rest, compared = _numbers(folded(text), catalogue)
    tokens = words(rest)
    first, second, soft, i = Search(list(compared)), Search(list(compared)), False, 0
    while i < len(tokens):
        n, said = catalogue.longest(tokens, i)
        if not n:
            n, said = 1, catalogue.beginning(tokens[i])
        if said is None:
            first.name.append(tokens[i])
            second.name.append(tokens[i])
        else:
            condition = Condition(said[0], (said[1],), array=said[0] in catalogue.arrays)
            first.conditions.append(condition)
            if n == 1 and tokens[i] in catalogue.names:
                soft = True
                second.name.append(tokens[i])
            else:
                second.conditions.append(condition)
        i += n
    return [first, second] if soft else [first]


def _all(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def compiled(search: Search, texts: tuple[str, ...], match: str = "all", chips: dict[str, tuple] | None = None, arrays: frozenset[str] = frozenset()) -> Column:
    """The filter of a search and of chips (allowed values by column).

    Conditions on one plain column are alternatives if equal, and all hold if
    compared; match says whether any or all values of an array, and any or all
    words of the name, must be there.  Null fails every condition.
    """
    if match not in ("any", "all"):
        raise ValueError("match is any or all")
    plain: list[Column] = []
    listed: list[Column] = []
    equal: dict[tuple[str, bool], list] = {}
    for c in search.conditions:
        if c.op == "=":
            equal.setdefault((c.column, c.array), []).extend(c.values)
        else:
            plain.append(OPERATORS[c.op](F.col(c.column), c.values[0]))
    for column, values in (chips or {}).items():
        if column in arrays:
            listed.append(F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False)))
        else:
            plain.append(F.col(column).isin(*values))
    for (column, array), values in equal.items():
        if not array:
            plain.append(F.col(column) == values[0] if len(values) == 1 else F.col(column).isin(*values))
        elif match == "any":
            listed.append(F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False)))
        else:
            listed.append(_all(F.coalesce(F.array_contains(column, v), F.lit(False)) for v in values))
    if search.name:
        haystack = F.lower(F.concat_ws(" ", *texts))
        held = [F.contains(haystack, F.lit(w)) for w in search.name]
        listed.append(_all(held) if match == "all" else reduce(lambda a, b: a | b, held))
    return _all([*plain, *listed]) if plain or listed else F.lit(True)


def screened(cards: DataFrame, text: str, catalogue: Catalogue, match: str = "all", chips: dict[str, tuple] | None = None) -> DataFrame:
    """Cards that a search finds by any of its readings, with the first reading that does."""
    filters = [compiled(s, catalogue.texts, match, chips, catalogue.arrays) for s in parse(text, catalogue)]
    reading = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(filters))):
        reading = F.when(f, i).otherwise(reading)
    return cards.where(reduce(lambda a, b: a | b, filters)).withColumn("reading", reading)
