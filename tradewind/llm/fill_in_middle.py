"""Fill-in-the-middle: documents cut into prefix, middle and suffix at unit boundaries.

A unit is a run of ASCII letters or one other code point.  A byte automaton
whose transitions carry counts (a unit begins, a code point begins, a sentinel
ends) reads the UTF-8 bytes once.  It is given as a table of states and byte
classes; three classes in a row fix its state whatever it was before (the
tables are checked for that), so the scan looks the state of every place up by
the classes of the last three bytes, for a whole block at once.  The first pass
leaves counts for each text and block; a second pass looks only into the block
that holds a cut for its place.

What a document becomes depends on its id alone: h1 to h4 are the first four
8-digit groups of the sha256 of ``seed:id``.

Defined results: a null text counts as empty and stays plain; a null id is the
empty id; ids of any type go by their text; rows may repeat and are cut alike;
texts of any length are read in blocks of ``BLOCK`` bytes; an empty table gives
no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Classes of bytes: any other first byte of a code point, a further byte of one, the sentinels' brackets and names, other letters.
OTHER, FURTHER, OPEN, CLOSE, NAME, LETTER = range(6)
#: States: after a code point that is no letter, after "<", after "<" and a sentinel's name, in a run of letters, after a sentinel.
APART, OPENED, NAMED, LETTERS, FOUND = range(5)
UNIT, POINT, SENTINEL = 1, 2, 4


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[128:192] = FURTHER
    table[[*range(65, 91), *range(97, 123)]] = LETTER
    table[[*b"PSM"]] = NAME
    table[ord("<")], table[ord(">")] = OPEN, CLOSE
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what is counted) by state and class."""
    after, counts = np.zeros((5, 6), np.uint8), np.zeros((5, 6), np.uint8)
    for state in range(5):
        in_word = state in (NAMED, LETTERS)
        begins = POINT if in_word else UNIT | POINT
        after[state] = [APART, APART, OPENED, APART, LETTERS, LETTERS]
        counts[state] = [UNIT | POINT, 0, UNIT | POINT, UNIT | POINT, begins, begins]
    after[OPENED, NAME] = NAMED
    after[NAMED, CLOSE], counts[NAMED, CLOSE] = FOUND, UNIT | POINT | SENTINEL
    return after, counts


def _by_three() -> np.ndarray:
    """What a byte counts, by the classes of the two bytes before it and its own."""
    after, counts = _automaton()
    out = np.zeros((6, 6, 6), np.uint8)
    for a, b, c in np.ndindex(6, 6, 6):
        told = {int(counts[after[after[s, a], b], c]) for s in range(5)}
        if len(told) > 1:
            raise ValueError("the automaton needs more than three bytes")
        out[a, b, c] = told.pop()
    return out.ravel()


CLASSES, COUNTS = _classes(), _by_three()


def scan(data: bytes, preceding: bytes = b"\n\n") -> np.ndarray:
    """What each byte counts; preceding holds the two bytes before."""
    kinds = CLASSES[np.frombuffer(preceding + data, np.uint8)].astype(np.int16)
    return COUNTS[kinds[:-2] * 36 + kinds[1:-1] * 6 + kinds[2:]]


def before(text: bytes, at: int) -> bytes:
    """The two bytes before a place; line ends before the first."""
    return (b"\n\n" + text[max(0, at - 2) : at])[-2:]


class Counted(NamedTuple):
    """The first pass over a text: units, code points and sentinels of each of its blocks."""

    units: list[int]
    points: list[int]
    sentinels: int


def counted(text: bytes) -> Counted:
    units, points, sentinels = [], [], 0
    for at in range(0, len(text), BLOCK):
        found = scan(text[at : at + BLOCK], before(text, at))
        units.append(int(np.count_nonzero(found & UNIT)))
        points.append(int(np.count_nonzero(found & POINT)))
        sentinels += int(np.count_nonzero(found & SENTINEL))
    return Counted(units, points, sentinels)


def located(text: bytes, found: Counted, unit: int) -> tuple[int, int]:
    """(byte, code points before it) where a unit begins; the end for the number of all units."""
    points = 0
    for i, n in enumerate(found.units):
        if unit < n:
            at = i * BLOCK
            flags = scan(text[at : at + BLOCK], before(text, at))
            place = int(np.flatnonzero(flags & UNIT)[unit])
            return at + place, points + int(np.count_nonzero(flags[:place] & POINT))
        unit, points = unit - n, points + found.points[i]
    return len(text), points


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        hashes = [batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < 2 * BLOCK):  # some megabytes of outputs at a time
                size += len(texts[to].as_py() or b"")
                to += 1
            yield _some(ids.slice(at, to - at), [t or b"" for t in texts.slice(at, to - at).to_pylist()], [h[at:to] for h in hashes])
            at = to


def _some(ids: pa.Array, texts: list[bytes], hashes: list[list[int]]) -> pa.RecordBatch:
    """Rows of some texts; short ones are scanned together."""
    small = [i for i, t in enumerate(texts) if len(t) <= BLOCK]
    joined = b"\n".join(texts[i] for i in small) + b"\n"
    flags = scan(joined)
    starts = dict(zip(small, np.cumsum([0] + [len(texts[i]) + 1 for i in small]).tolist()))
    found = {}
    if small:
        begins = np.fromiter((starts[i] for i in small), np.int64)
        ends = begins + np.fromiter((len(texts[i]) for i in small), np.int64)
        total = lambda bit: (lambda s: (s[ends] - s[begins]).tolist())(np.append(0, np.cumsum((flags & bit) > 0)))
        found = {i: Counted([u], [p], s) for i, u, p, s in zip(small, total(UNIT), total(POINT), total(SENTINEL))}
        units = np.flatnonzero(flags & UNIT)
        points = np.append(0, np.cumsum((flags & POINT) > 0))
        first = dict(zip(small, np.searchsorted(units, begins).tolist()))
    out: dict[str, list] = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", "output")}
    for i, (text, h1, h2, h3, h4) in enumerate(zip(texts, *hashes)):
        own = found[i] if i in found else counted(text)
        n = sum(own.units)
        out["n"].append(n)
        if not text or own.sentinels or h3 % 100 >= 90:
            for c, v in (("form", "plain"), ("prefix_chars", None), ("middle_chars", None), ("output", text)):
                out[c].append(v)
            continue
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        if i in found:
            place = lambda k: int(units[first[i] + k]) - starts[i] if k < n else len(text)
            a, b = place(low), place(high)
            chars = [int(points[starts[i] + x] - points[starts[i]]) for x in (a, b)]
        else:
            (a, first_chars), (b, until) = located(text, own, low), located(text, own, high)
            chars = [first_chars, until]
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        spm = h4 % 100 < 20
        out["form"].append("spm" if spm else "psm")
        out["prefix_chars"].append(chars[0])
        out["middle_chars"].append(chars[1] - chars[0])
        out["output"].append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}
    return pa.RecordBatch.from_arrays([ids, *(pa.array(out[c], k) for c, k in kinds.items())], ["doc_id", *kinds])


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output."""
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    hashed = given.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    groups = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    schema = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    return hashed.select("doc_id", "text", *groups).mapInArrow(_fill, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<P>|<S>|<M>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
