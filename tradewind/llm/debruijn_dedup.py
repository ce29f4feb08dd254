"""Repeated passages by a compacted de Bruijn graph over words.

The graph's nodes are sampled k-mers of words (see anchors.py), its edges the
stretches of text around them that hold all windows of ``window`` words with
that k-mer as anchor.  Edges that stand at two places or more repeat; where a
node has one class of edges only, the path through it doesn't branch and needs
no further look, and consecutive windows of such edges compact into one span
when the graph's answers return to the documents.  At branching nodes the
windows themselves are compared, between one representative of each class.
Edges and windows are the same only if the digests of their words' bytes, read
at their source coordinates, and their k-mers agree (112 bits for edges).  A
word is removed if a window over it stands anywhere else, in the same document
too.

Defined results: a null or empty text has no words and keeps nothing (the hash
of an empty string); documents shorter than the window lose nothing; rows may
repeat and then repeat each other; null ids pass through, as rows count and not
ids; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tradewind.llm.exchange import chunked, sizes, texts
from tradewind.llm.hashing import WORD_REACH, word_digest, word_grams, words_of
from tradewind.llm.repeats import Plan, Sequences, find, runs


def _sequences(table: pa.Table) -> Sequences:
    body = texts(table)
    values, lengths = words_of(body, lower=False)
    return Sequences(word_grams(values), lengths, np.zeros(len(lengths), np.int64), WORD_REACH, word_digest(body))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, k: int = 12, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, spans (begin, end in words), kept_sha256 and, with_text, clean_text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    buckets, rows_log2 = sizes(docs, text)
    plan = Plan(_sequences, window, k, earlier=False, width=4, buckets=buckets)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def finish(table: pa.Table, s: Sequences, marked: np.ndarray) -> pa.Table:
        removed, spans, digests, clean = [], [], [], []
        for body, (a, b, begins, ends) in zip(texts(table), runs(marked, s.lengths), strict=True):
            words = body.split()
            gone = marked[a:b]
            left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if len(begins) else words)
            removed.append(int(gone.sum()))
            spans.append([{"begin": x, "end": y} for x, y in zip(begins.tolist(), ends.tolist())])
            digests.append(hashlib.sha256(left).hexdigest())
            clean.append(left.decode() if with_text else None)
        columns = {
            "doc_id": table["doc_id"],
            "n_words": pa.array(s.lengths.astype(np.int64)),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, span),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        return pa.table(columns | ({"clean_text": pa.array(clean, pa.string())} if with_text else {}))

    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<struct<begin:bigint,end:bigint>>, kept_sha256 string"
    return find(plan, chunked(docs, doc_id, text, rows_log2), finish, schema + ", clean_text string" * with_text)
