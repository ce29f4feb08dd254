"""Repeated byte strings by sorted suffixes.

A byte is removed if a string of ``length`` bytes over it also starts in a
document with a smaller id.  Sampled anchors (see anchors.py and repeats.py)
settle all stretches that are copied whole; what is left are anchors with
several surroundings, one text for each.  Those texts are sorted as suffixes
from the anchor on, and reversed before it, by deep-shallow sorting.  In both
orders the neighbours' common prefixes give classes of equal text to every
depth, so two texts share a string exactly if they share its part from the
anchor on and its part before; the smallest id in each such class decides.

An anchor with more than ``sort_classes`` different surroundings (a passage
that very many documents share) is not sorted by one task: its strings are
spread by hash, and each is counted where its hash is dealt.

Defined results: a null or empty text has no bytes and keeps none; rows with
equal ids don't remove from each other; a null id counts as larger than all
others; an empty table gives no rows.  clean_text is the kept bytes as UTF-8
without characters that were cut apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.deep_shallow import classes, sort_suffixes
from tradewind.llm.exchange import chunked, cuts, pack, sizes, texts, unpack
from tradewind.llm.hashing import BYTE_REACH, byte_grams
from tradewind.llm.repeats import KEY, SORTED, Pairs, Plan, Sequences, find, runs


class SuffixSorter:
    """Questions and answers of pass 2 for anchors whose surroundings are sorted."""

    @staticmethod
    def questions(plan: Plan, table: pa.Table, s: Sequences, p: Pairs, chosen: np.ndarray) -> list[tuple]:
        data = b"".join(texts(table))
        at = p.example[chosen]
        first, end, place = p.anchors.first[at], p.anchors.last[at] + plan.window, p.anchors.place[at]
        number = p.value[chosen]
        out = []
        for b, i, j in cuts(p.key[chosen], plan.buckets):
            head = np.column_stack((place[i:j] - first[i:j], end[i:j] - first[i:j])).astype("<u4").tobytes()
            body = b"".join([data[x:y] for x, y in zip(first[i:j].tolist(), end[i:j].tolist())])
            out.append((b, SORTED, pack(p.key[chosen][i:j], KEY), head + body, pack(number[i:j], plan.width)))
        return out

    @staticmethod
    def answers(plan: Plan, columns: dict[str, list]) -> list[tuple]:
        key, number = unpack(columns["keys"], KEY), unpack(columns["counts"], plan.width).astype(np.int64)
        before, after, left, right = [], [], [], []
        for keys, blob in zip(columns["keys"], columns["more"]):
            n = len(keys) // KEY
            head = np.frombuffer(blob[: 8 * n], "<u4").reshape(n, 2).astype(np.int64)
            ends = np.cumsum(head[:, 1]) + 8 * n
            for (a, size), end in zip(head.tolist(), ends.tolist()):
                own = blob[end - size : end]
                left.append(own[:a][::-1])
                right.append(own[a:])
            before.append(head[:, 0])
            after.append(head[:, 1] - head[:, 0])
        before, after = np.concatenate(before), np.concatenate(after)
        # the k-mer itself is equal for all of a key; should hashes collide, a full compare tells them apart
        from_anchor, before_anchor = sort_suffixes(right, key, skip=plan.k), sort_suffixes(left, key)
        masks = np.zeros((len(key), plan.mask_bytes), np.uint8)
        for offset in range(plan.window - plan.k + 1):
            here = np.flatnonzero((before >= offset) & (after >= plan.window - offset))
            if not len(here):
                continue
            both = classes(*from_anchor, plan.window - offset)[here] * (len(key) + 1) + classes(*before_anchor, offset)[here]
            _, which = np.unique(both, return_inverse=True)
            least = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, which, number[here])
            masks[here[number[here] > least[which]], offset >> 3] |= 1 << (offset & 7)
        at = np.cumsum([0] + [len(x) // KEY for x in columns["keys"]]).tolist()
        return [(c, b, SORTED, masks[i:j].tobytes()) for c, b, i, j in zip(columns["chunk"], columns["bucket"], at, at[1:])]


def repeated_strings(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 50,
    k: int = 20,
    sort_classes: int = 4096,
    with_text: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (begin, end in bytes), kept_sha256 and, with_text, clean_text.

    The columns of keep pass through.  ``length`` is at least 8 bytes, and ``k``,
    the bytes of an anchor, at most ``length``.
    """
    k = min(k, length)
    if k < BYTE_REACH:
        raise ValueError(f"strings and anchors take {BYTE_REACH} bytes or more")
    names = [f"kept_{i}" for i in range(len(keep))]
    kind = docs.schema[doc_id].dataType.simpleString()
    least, most = docs.agg(F.min(doc_id).cast("bigint"), F.max(doc_id).cast("bigint")).first()
    base, beyond = least or 0, (most or 0) - (least or 0) + 1
    buckets, rows_log2 = sizes(docs, text)

    def sequences(table: pa.Table) -> Sequences:
        body = texts(table)
        data = np.frombuffer(b"".join(body), np.uint8)
        numbers = [beyond if i is None else i - base for i in table["doc_id"].to_pylist()]
        return Sequences(byte_grams(data), np.array([len(b) for b in body], np.int64), np.array(numbers, np.int64), BYTE_REACH)

    plan = Plan(sequences, length, k, True, (beyond.bit_length() + 7) // 8, buckets, sort_classes, SuffixSorter)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def finish(table: pa.Table, s: Sequences, marked: np.ndarray) -> pa.Table:
        removed, spans, digests, clean = [], [], [], []
        for body, (a, b, begins, ends) in zip(texts(table), runs(marked, s.lengths), strict=True):
            pairs = list(zip(begins.tolist(), ends.tolist()))
            edges = [0, *(x for p in pairs for x in p), len(body)]
            left = b"".join([body[x:y] for x, y in zip(edges[::2], edges[1::2])])
            removed.append(len(body) - len(left))
            spans.append([{"begin": x, "end": y} for x, y in pairs])
            digests.append(hashlib.sha256(left).hexdigest())
            clean.append(left.decode(errors="ignore") if with_text else None)
        columns = {
            "doc_id": table["doc_id"],
            "n_bytes": pa.array(s.lengths),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array([len(x) for x in spans], pa.int64()),
            "spans": pa.array(spans, span),
            "kept_sha256": pa.array(digests, pa.string()),
        } | {n: table[n] for n in names}
        return pa.table(columns | ({"clean_text": pa.array(clean, pa.string())} if with_text else {}))

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<begin:bigint,end:bigint>>, kept_sha256 string"
    schema += "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep)) + ", clean_text string" * with_text
    chunks = chunked(docs, doc_id, text, rows_log2, *(F.col(c).alias(n) for n, c in zip(names, keep)))
    return find(plan, chunks, finish, schema).withColumnsRenamed(dict(zip(names, keep)))
