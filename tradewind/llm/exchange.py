"""Corpus-wide answers about hashed keys, for operators that work chunk by chunk.

Documents are dealt to chunks, a fixed number of neighbouring rows of an input
split.  A chunk asks about its distinct keys once: it sorts them, cuts them by
bucket, and sends each bucket one row with all keys as packed bytes.  A
bucket's task sees every question about its keys, and answers each row in
order.  The answers return to the chunk, where the same keys are made again
from the texts.  So the volume is that of distinct keys per chunk, a key that
is frequent in the corpus costs each chunk one entry however often it stands
there, and no task holds more than a chunk or a bucket.  The number of buckets
grows with the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.storage import partitions

BUCKET_BYTES, CHUNK_BYTES = 16 << 20, 2 << 20


def chunked(docs: DataFrame, doc_id: str, text: str, rows_log2: int, *more: object) -> DataFrame:
    """(rid, chunk, doc_id, text as bytes, *more); the same rows get the same chunk in every run over the same files."""
    rid = F.monotonically_increasing_id()
    return docs.select(rid.alias("rid"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), *more).withColumn(
        "chunk", F.shiftright("rid", rows_log2)
    )


class Sizes(NamedTuple):
    """How a table is dealt: buckets, no fewer than shuffle partitions, and 2 ** rows_log2 rows a chunk."""

    buckets: int
    rows_log2: int


def sizes(docs: DataFrame, text: str) -> Sizes:
    """A bucket for every few megabytes of text, and chunks of about two megabytes."""
    size, rows = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    mean = (size or 0) / max(rows, 1) + 64
    return Sizes(max(partitions(docs.sparkSession), -(-(size or 0) // BUCKET_BYTES)), max(0, min(12, int(CHUNK_BYTES / mean).bit_length() - 1)))


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each chunk together; a chunk's rows follow each other."""
    held, now = [], None
    for batch in batches:
        chunks = batch.column(batch.schema.get_field_index("chunk")).to_numpy()
        cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and chunks[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(chunks[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def texts(table: pa.Table) -> list[bytes]:
    """The text column's values."""
    return table["text"].to_pylist()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each key; it doesn't fall where keys rise."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of every bucket with sorted keys."""
    own = bucket_of(keys, buckets)
    at = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
    return [(int(own[a]), a, b) for a, b in zip(at.tolist(), at[1:].tolist())]


def pack(values: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blobs: list[bytes], width: int) -> np.ndarray:
    """What pack() made, one after another."""
    low = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :width] = low
    return out.view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as their number, the first one, and the gaps in as many bytes as the largest needs."""
    gaps = np.diff(values) if len(values) else values
    width = (int(gaps.max(initial=0)).bit_length() + 7) // 8
    return np.uint32(len(values)).tobytes() + bytes((width,)) + values[:1].astype("<u8").tobytes() + (pack(gaps, width) if width else b"")


def unpack_sorted(blob: bytes) -> np.ndarray:
    """What pack_sorted() made."""
    size, width = int.from_bytes(blob[:4], "little"), blob[4]
    out = np.zeros(size, np.uint64)
    if size:
        out[0] = int.from_bytes(blob[5:13], "little")
        out[1:] = unpack([blob[13:]], width) if width else 0
    return np.cumsum(out, dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts of any size: how many there are, a byte for each, and eight more for those of 255 and above."""
    return np.uint32(len(n)).tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u8").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    """What pack_counts() made."""
    size = int.from_bytes(blob[:4], "little")
    n = np.frombuffer(blob, np.uint8, size, 4).astype(np.int64)
    n[n == 255] = np.frombuffer(blob[4 + size :], "<u8").astype(np.int64)
    return n


def ask(chunks: DataFrame, questions: Callable[[pa.Table], list[tuple]], schema: str) -> DataFrame:
    """Rows (chunk, bucket, kind, ...) of all chunks; questions() gives the rows of one, without the chunk."""
    names = ["chunk", *(p.split()[0] for p in schema.split(","))]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in by_chunk(batches):
            if rows := questions(table):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(rows), pa.int64())} | {n: list(c) for n, c in zip(names[1:], zip(*rows, strict=True))})

    fixed = lambda batches: (_cast(b, schema) for b in asked(batches))
    return chunks.mapInArrow(fixed, f"chunk bigint, {schema}")


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _cast(batch: pa.RecordBatch, schema: str) -> pa.RecordBatch:
    kinds = [pa.int64(), *(_TYPES[p.split()[1]] for p in schema.split(","))]
    return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(batch.columns, kinds, strict=True)], batch.schema.names)


def answer(asked: DataFrame, answers: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """Rows (chunk, bucket, kind, ...) of all buckets; answers() gets a bucket's questions as columns and gives its rows."""
    names = [p.split()[0] for p in schema.split(",")]
    kinds = [_TYPES[p.split()[1]] for p in schema.split(",")]

    def one(table: pa.Table) -> pa.Table:
        rows = answers({c: table[c].to_pylist() for c in table.column_names})
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return asked.groupBy("bucket").applyInArrow(one, schema)


def replies_of(table: pa.Table, kind: int, column: str) -> list[bytes]:
    """A chunk's answers of a kind, bucket by bucket."""
    rows = sorted((b, v) for b, k, v in zip(*(table[c].to_pylist() for c in ("bucket", "kind", column)), strict=True) if k == kind)
    return [v for _, v in rows]


def answers_of(table: pa.Table, kind: int, column: str, width: int) -> np.ndarray:
    """A chunk's answers of a kind in the order of its sorted keys."""
    return unpack(replies_of(table, kind, column), width)


def counts_of(table: pa.Table, kind: int, column: str) -> np.ndarray:
    """The same for counts."""
    blobs = replies_of(table, kind, column)
    return np.concatenate([unpack_counts(b) for b in blobs]) if blobs else np.zeros(0, np.int64)
