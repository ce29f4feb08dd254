"""License scans by a positional index of rare words.

Templates are clauses of licences (see license_texts.py) and short phrases, each
with a label and key phrases that must stand within its reach for it to count.
A template's words carry the inverse frequency over all templates; it is indexed
under its rarest words, so many that a text which holds ``min_coverage`` of the
template's weight holds one of them.  A file's words that stand in the index
are looked up, those of the highest weight first; a hit fixes where the template
would begin, its other words are intersected by relative position, and the
weight in place is its coverage.  Base phrases need every word, longer templates
``min_coverage`` of their weight and every key phrase.

The index has the size of the template list, whatever the table's size.  Each
document is read whole, once, in the task that reads its row.

Defined results: a null or empty text has no words, no places, an empty list of
labels, null places and score 0; rows may repeat and null ids pass through;
other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.license_texts import CLAUSES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Template(NamedTuple):
    """A phrase and its label; keys are phrases that must stand from its begin to ``reach`` words behind its end."""

    label: str
    phrase: str
    keys: tuple[str, ...] = ()
    reach: int = 0


#: The phrases whose places are counted as n_base.
BASE = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)

#: Short phrases that name a licence, in their public wording.
NAMES = (
    Template("gpl-2", "gnu general public license", ("version 2",), 12),
    Template("gpl-3", "gnu general public license", ("version 3",), 12),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2", "apache license", ("version 2",), 8),
    Template("mpl-2", "mozilla public license", ("2 0",), 6),
    Template("epl", "eclipse public license"),
    Template("bsl", "boost software license version 1 0"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal"),
    Template("proprietary", "all rights reserved"),
)
MORE = (*NAMES, *(Template(label, text, keys) for label, text, keys in CLAUSES))


class PositionalIndex:
    """Templates by their rarest word, with the places of their words."""

    def __init__(self, base: tuple[Template, ...], more: tuple[Template, ...], min_coverage: float) -> None:
        self.base, self.min_coverage = len(base), min_coverage
        self.templates = [(t, t.phrase.encode().split(), [k.encode().split() for k in t.keys]) for t in (*base, *more)]
        holders = Counter(w for _, words, _ in self.templates for w in set(words))
        self.idf = {w: math.log(1 + len(self.templates) / n) for w, n in holders.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, words, _) in enumerate(self.templates):
            for w in self._indexed(i, words):
                self.postings[w] += [(i, k) for k, x in enumerate(words) if x == w]
        self.rare = set(self.postings)

    def _indexed(self, i: int, words: list[bytes]) -> list[bytes]:
        """The rarest words (of equals the longest) of a template: one for those that need every word, else more than the weight that may be missing."""
        rare = sorted(dict.fromkeys(words), key=lambda w: (-self.idf[w], -len(w), w))
        if i < self.base or len(words) < 6:
            return rare[:1]
        spare = (1 - self.min_coverage) * sum(self.idf[w] for w in words)
        chosen, weight = [], 0.0
        for w in rare:
            chosen.append(w)
            weight += self.idf[w] * words.count(w)
            if weight > spare * (1 + 1e-9):
                break
        return chosen

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word's place, coverage) of every place."""
        there = self.rare.intersection(words)
        if not there:
            return []
        places: dict[bytes, list[int]] = {w: [] for w in there}
        for at, word in enumerate(words):
            if word in places:
                places[word].append(at)
        found: dict[tuple[int, int], float] = {}
        for word in sorted(there, key=lambda w: (-self.idf[w], w)):
            for i, k in self.postings[word]:
                for at in places[word]:
                    start = at - k
                    if (i, start) in found or start < 0 and i < self.base:
                        continue
                    share = self._coverage(i, start, words)
                    if share:
                        found[i, start] = share
        return [(i, start, share) for (i, start), share in found.items()]

    def _coverage(self, i: int, start: int, words: list[bytes]) -> float:
        template, own, keys = self.templates[i]
        here = words[max(start, 0) : start + len(own)] if start + len(own) > 0 else []
        if here == own:
            share = 1.0
        elif i < self.base or len(own) < 6:
            return 0.0
        else:
            there = [b""] * max(-start, 0) + here
            weight = sum(self.idf[w] for w in own)
            share = sum(self.idf[w] for w, x in zip(own, there) if w == x) / weight
            if share < self.min_coverage:
                return 0.0
        if keys:
            region = words[max(start, 0) : max(start, 0) + len(own) + template.reach]
            if not all(_stands(k, region) for k in keys):
                return 0.0
        return share


def _stands(phrase: list[bytes], words: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[a : a + n] == phrase for a in range(len(words) - n + 1) if words[a] == phrase[0])


def scan_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    base: tuple[Template, ...] = BASE,
    more: tuple[Template, ...] = MORE,
    min_coverage: float = 0.8,
) -> DataFrame:
    """One row per document: doc_id, n_words, matches (label, start, words, coverage, base), ordered by start."""
    kind = docs.schema[doc_id].dataType.simpleString()
    match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64()), ("base", pa.bool_())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PositionalIndex(base, more, min_coverage)
        for batch in batches:
            n_words, matches = [], []
            for value in batch.column(1):
                body = value.as_buffer()
                words = WORD.findall(bytes(body).lower()) if body is not None else []
                n_words.append(len(words))
                hits = sorted((start, i, share) for i, start, share in index.scan(words))
                matches.append(
                    [
                        {"label": index.templates[i][0].label, "start": max(start, 0), "words": len(index.templates[i][1]), "coverage": share, "base": i < index.base}
                        for start, i, share in hits
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(matches, pa.list_(match))], ["doc_id", "n_words", "matches"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        scanned, f"doc_id {kind}, n_words bigint, matches array<struct<label:string,start:bigint,words:bigint,coverage:double,base:boolean>>"
    )


def license_digest(found: DataFrame) -> DataFrame:
    """Counts, places, labels and score of scan_licenses().

    The score is the share of doubt that the matches remove: one minus the
    product of (1 - coverage * weight) over all matches, where a base phrase
    weighs 0.6 and another template 0.9.
    """
    labels = lambda source: F.array_join(F.array_sort(F.array_distinct(F.expr(f"transform({source}, m -> m.label)"))), ",")
    of_base = "filter(matches, m -> m.base)"
    doubt = "aggregate(matches, 1.0D, (d, m) -> d * (1.0D - m.coverage * CASE WHEN m.base THEN 0.6D ELSE 0.9D END))"
    return found.select(
        "doc_id",
        "n_words",
        F.expr(f"CAST(size({of_base}) AS BIGINT)").alias("n_base"),
        F.expr(f"array_min(transform({of_base}, m -> m.start))").alias("first_word"),
        F.expr(f"array_max(transform({of_base}, m -> m.start))").alias("last_word"),
        labels(of_base).alias("base_labels"),
        labels("matches").alias("labels"),
        F.expr(f"1.0D - {doubt}").alias("score"),
    )
