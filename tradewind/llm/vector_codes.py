"""Vector codes by product quantisation over distinct parts.

Components become integers, vectors are cut into equal parts, and every part
position has a codebook of its own.  Rows that share a part at a position share
its code, so Lloyd's rounds run over the distinct parts with their numbers of
rows as weights: the more vectors repeat, the less there is to assign, and a
part that a third of all rows hold is one row.  Codes and errors come back to
the vectors by joins on the parts.

All sums and distances are of integers and exact, so results don't depend on
how rows are dealt: products run through floating-point matrices only where
every value that can occur is below 2 ** 53.  A task sends each codebook
entry's sums once; the driver gets the codebooks' sums, ``parts * entries``
rows whatever the table's size.

Defined results: vectors that are null or hold null or non-finite components
are left out, empty ones too; vectors of unequal lengths are filled up with
zeros to the longest, and to a multiple of the number of parts; integers beyond
2 ** 26 either way count as 2 ** 26, so that squared errors fit into 64 bits;
rows may repeat and are coded each; ids come in their own order, null ones last,
and of equal ids the parts decide; fewer vectors than entries give a smaller
codebook; an empty table gives no rows; columns with other names aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.storage import stored

LARGEST = 1 << 26
#: Rows whose distances to a codebook are in memory at once.
ROWS = 4096


class Codebooks(NamedTuple):
    """Entries by part position, entry and component; ``count`` entries are in use at each position."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Of all components' decimal digits, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, position: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each part; ties go to the lower entry."""
        own = self.entries[position]
        codes, errors = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        largest = max(int(np.abs(own).max(initial=0)), int(np.abs(parts).max(initial=0)), 1)
        kind = np.float64 if 4 * own.shape[1] * largest**2 < 1 << 53 else np.int64
        own, squares = own.astype(kind), (own.astype(np.int64) ** 2).sum(1).astype(kind)
        for at in range(0, len(parts), ROWS):
            some = parts[at : at + ROWS].astype(kind)
            far = (some * some).sum(1)[:, None] - 2 * (some @ own.T) + squares
            codes[at : at + ROWS] = np.argmin(far, 1)
            errors[at : at + ROWS] = far.min(1)
        return codes, errors


def _integers(vector: Column, scale: int) -> Column:
    """The scaled components, rounded down, within the range."""
    whole = lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    return F.transform(vector, whole)


def _usable(vector: Column) -> Column:
    """Neither null nor empty, and all components finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, odd), F.lit(False))


def _arrays(batch: pa.RecordBatch) -> np.ndarray:
    """The parts of a batch, which are all of one length."""
    lists = batch.column("part")
    return lists.flatten().to_numpy().reshape(len(lists), -1).astype(np.int64)


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    positions = batch.column("position").to_numpy()
    for p in np.unique(positions).tolist():
        yield p, np.flatnonzero(positions == p)


def _sums(books: Codebooks):
    """(position, entry, item, total) of a task: item -1 is the number of rows, others the components' sums."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = books.entries.shape
        totals, any_rows = np.zeros((shape[0], shape[1], shape[2] + 1), np.int64), False
        for batch in batches:
            parts, weights, any_rows = _arrays(batch), batch.column("weight").to_numpy(), True
            for p, at in _by_position(batch):
                codes, _ = books.nearest(p, parts[at])
                np.add.at(totals[p], codes, np.column_stack((weights[at], parts[at] * weights[at][:, None])))
        if any_rows:
            p, e = np.nonzero(totals[:, :, 0])
            wide = shape[2] + 1
            yield pa.RecordBatch.from_pydict(
                {
                    "position": np.repeat(p, wide).astype(np.int32),
                    "entry": np.repeat(e, wide).astype(np.int32),
                    "item": np.tile(np.arange(-1, shape[2], dtype=np.int32), len(p)),
                    "total": totals[p, e].ravel(),
                }
            )

    return summed


def _assigned(books: Codebooks):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _arrays(batch)
            codes, errors = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
            for p, at in _by_position(batch):
                codes[at], errors[at] = books.nearest(p, parts[at])
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part"), pa.array(codes), pa.array(errors)], ["position", "part", "code", "error"])

    return assigned


def learned(distinct: DataFrame, first: np.ndarray, rounds: int) -> Codebooks:
    """Codebooks after some rounds over distinct(position, part, weight), from the first entries."""
    books = Codebooks(first)
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books), "position int, entry int, item int, total bigint")
        found = sums.groupBy("position", "entry", "item").agg(F.sum("total").alias("total")).collect()
        totals = np.zeros((*first.shape[:2], first.shape[2] + 1), object)
        for r in found:
            totals[r.position, r.entry, r.item + 1] = r.total
        entries = books.entries.copy()
        for p, e in zip(*np.nonzero(totals[:, :, 0])):
            entries[p, e] = [t // totals[p, e, 0] for t in totals[p, e, 1:]]
        books = Codebooks(entries)
    return books


def vector_codes(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    code has ``parts`` numbers of two hex digits, or as many as the entries need.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("v")).where(_usable(F.col("v")))
    longest = given.agg(F.max(F.size("v"))).first()[0] or 0
    size = -(-longest // parts)
    filled = F.concat(_integers(F.col("v"), scale), F.array_repeat(F.lit(0), F.lit(size * parts) - F.size("v")))
    cut = [F.slice("whole", i * size + 1, size).alias(f"part{i}") for i in range(parts)]
    # read again by every step: the same row numbers each time
    kept = stored(given.withColumn("whole", filled).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", *cut), "parts")
    names = [f"part{i}" for i in range(parts)]
    first = kept.select("vec_id", *names).orderBy(F.asc_nulls_last("vec_id"), *names).limit(entries).collect()
    n = len(first)
    start = np.array([[r[c] for r in first] for c in names], np.int64).reshape(parts, n, size)

    one = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.col(c).alias("part")) for i, c in enumerate(names)]))
    placed = kept.select("row", one.alias("p")).select("row", "p.position", "p.part")
    distinct = stored(placed.groupBy("position", "part").agg(F.count("*").alias("weight")), "distinct-parts")
    books = learned(distinct, start, rounds) if n else Codebooks(start)
    assigned = distinct.mapInArrow(_assigned(books), "position int, part array<int>, code int, error bigint")
    digits = max(2, len(f"{max(n - 1, 0):x}"))
    hexed = F.lower(F.lpad(F.hex("code"), digits, "0"))
    coded = placed.join(assigned, ["position", "part"]).select("row", "error", F.struct("position", hexed.alias("code")).alias("c"))
    by_row = coded.groupBy("row").agg(F.sum("error").alias("error"), F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["code"]), "").alias("code"))
    own = stored(kept.select("row", "vec_id", "label").join(by_row, "row").drop("row"), "codes")
    labels = own.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = own.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
