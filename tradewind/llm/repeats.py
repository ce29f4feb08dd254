"""Windows that repeat across a corpus, found by sampled k-mers and decided exactly.

Three passes over chunks of documents, with an exchange between them:

1. Every anchor occurrence asks, by its k-mer, how its edge class (the text
   around it that holds all its windows) fares: whether it repeats, and whether
   the k-mer also has other classes, so that it branches.  Occurrences in a
   class that repeats are settled, since all their windows do.
2. Only where a k-mer branches, one representative of each class sends its
   windows, and those that repeat in another class are found; with ``earlier``,
   one in each chunk that holds the class's smallest number.
3. Each document marks what its windows cover.

``earlier`` counts a window as repeated only if a smaller document number holds
it; otherwise any second place counts, in the same document too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tradewind.llm.anchors import Anchors, Digest, anchors_of
from tradewind.llm.exchange import answer, answers_of, ask, cuts, pack, replies_of, unpack
from tradewind.llm.hashing import RunHashes
from tradewind.llm.storage import stored

KEY, EDGE = 6, 8
SETTLED, SENDS, BY_HASH = 1, 2, 4
#: Kinds of questions: edge classes, hashed windows, and windows as sorted text.
CLASSES, WINDOWS, SORTED = 1, 2, 3


class Sequences(NamedTuple):
    """A chunk's sequences: values one after another, their lengths, and each sequence's document number.

    A value stands for ``reach`` items from its place on (see RunHashes).  Where
    digest() is given, edges and windows are told apart by their texts' digests.
    """

    values: np.ndarray
    lengths: np.ndarray
    numbers: np.ndarray
    reach: int
    digest: Digest | None = None


class Plan(NamedTuple):
    """What to look for.  sequences() reads them from a chunk's table; numbers take ``width`` bytes."""

    sequences: Callable[[pa.Table], Sequences]
    window: int
    k: int
    earlier: bool
    width: int
    buckets: int
    sort_classes: int = 0  # k-mers with no more classes than this send text that is sorted, others hashes
    sorter: Callable | None = None

    @property
    def mask_bytes(self) -> int:
        """Bytes of the marks of a sorted anchor's windows, one bit for each."""
        return (self.window - self.k + 8) // 8


class Pairs(NamedTuple):
    """A chunk's distinct (k-mer, edge class) pairs in the order of their keys."""

    anchors: Anchors
    hashes: RunHashes
    key: np.ndarray
    edge: np.ndarray
    value: np.ndarray  # smallest number, or the number of occurrences
    pair: np.ndarray  # of each occurrence
    example: np.ndarray  # an occurrence with the value, for each pair


def pairs_of(plan: Plan, s: Sequences) -> Pairs:
    """Anchors of a chunk, by pair."""
    hashes = RunHashes(s.values, s.reach)
    a = anchors_of(s.values, s.lengths, plan.window, plan.k, hashes, s.digest)
    number = s.numbers[a.owner]
    order = np.lexsort((a.place, number, a.edge, a.key))
    key, edge = a.key[order], a.edge[order]
    new = np.append(True, (key[1:] != key[:-1]) | (edge[1:] != edge[:-1])) if len(order) else np.zeros(0, bool)
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    value = number[order][head] if plan.earlier else np.diff(np.append(head, len(order)))
    return Pairs(a, hashes, key[head], edge[head], value.astype(np.int64), pair, order[head])


def settle(plan: Plan) -> Callable[[dict[str, list]], list[tuple]]:
    """Answers pass 1 for a bucket."""

    def settled(columns: dict[str, list]) -> list[tuple]:
        keys = unpack(columns["keys"], KEY)
        edges, values = unpack(columns["more"], EDGE), unpack(columns["counts"], plan.width).astype(np.int64)
        order = np.lexsort((values, edges, keys))
        k, e, v = keys[order], edges[order], values[order]
        new_key = np.append(True, k[1:] != k[:-1])
        new = new_key | np.append(True, e[1:] != e[:-1])
        head, of_class, of_key = np.flatnonzero(new), np.cumsum(new) - 1, np.cumsum(new_key) - 1
        classes = np.bincount(of_key[head])[of_key]  # of the pair's k-mer
        code = np.zeros(len(order), np.uint8)
        if plan.earlier:
            least = v == v[head][of_class]  # in several chunks, where rows repeat an id
            code[~least] |= SETTLED
            heads = np.flatnonzero(new_key)
            many = np.minimum.reduceat(v, heads) != np.maximum.reduceat(v, heads)
            sends = (classes > 1) & least & many[of_key]
        else:
            total = np.add.reduceat(v, head)
            code[total[of_class] > 1] |= SETTLED
            open_ = np.bincount(of_key[head], weights=total == 1) > 0  # some class stands once
            sends = (classes > 1) & new & open_[of_key]
        code[sends] |= SENDS
        code[sends & (classes > plan.sort_classes)] |= BY_HASH
        back = np.empty_like(code)
        back[order] = code
        at = np.cumsum([0] + [len(x) // KEY for x in columns["keys"]]).tolist()
        return [(c, b, CLASSES, back[i:j].tobytes()) for c, b, i, j in zip(columns["chunk"], columns["bucket"], at, at[1:])]

    return settled


class Sent(NamedTuple):
    """Windows that a chunk's representatives send by hash: distinct hashes, values, and (occurrence, begin) -> hash."""

    hashes: np.ndarray
    value: np.ndarray
    owner: np.ndarray
    begin: np.ndarray
    which: np.ndarray
    own: np.ndarray


def sent_windows(plan: Plan, s: Sequences, p: Pairs, code: np.ndarray) -> Sent:
    """The windows of representatives in pairs that are marked to send by hash."""
    occurrence = p.example[(code & BY_HASH) > 0]
    first, last = p.anchors.first[occurrence], p.anchors.last[occurrence]
    n = last - first + 1
    begin = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    owner = np.repeat(occurrence, n)
    own = s.numbers[p.anchors.owner[owner]].astype(np.int64) if plan.earlier else np.ones(len(owner), np.int64)
    hashes, which = np.unique((s.digest or p.hashes.of)(begin, begin + plan.window), return_inverse=True)
    value = np.zeros(len(hashes), np.int64)
    if plan.earlier:
        value[:] = np.iinfo(np.int64).max
        np.minimum.at(value, which, own)
    else:
        np.add.at(value, which, own)
    return Sent(hashes, value, owner, begin, which, own)


def windows_repeat(plan: Plan, columns: dict[str, list]) -> list[tuple]:
    """Answers hashed windows of pass 2: 1 where a smaller number, or another class, holds the window."""
    keys, values = unpack(columns["keys"], 8), unpack(columns["counts"], plan.width).astype(np.int64)
    distinct, inverse = np.unique(keys, return_inverse=True)
    if plan.earlier:
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, values)
        yes = values > least[inverse]
    else:
        yes = np.bincount(inverse, weights=values)[inverse] > 1
    at = np.cumsum([0] + [len(x) // 8 for x in columns["keys"]]).tolist()
    back = yes.astype(np.uint8)
    return [(c, b, WINDOWS, back[i:j].tobytes()) for c, b, i, j in zip(columns["chunk"], columns["bucket"], at, at[1:])]


ASKED = "bucket int, kind int, keys binary, more binary, counts binary"
REPLIED = "chunk bigint, bucket int, kind int, codes binary"


def marks(plan: Plan, s: Sequences, replies: pa.Table) -> np.ndarray:
    """Pass 3: which values of a chunk are covered by windows that repeat."""
    from tradewind.llm.anchors import covered

    p = pairs_of(plan, s)
    code = _codes(replies, CLASSES, len(p.key))
    a = p.anchors
    whole = (code[p.pair] & SETTLED) > 0
    if plan.earlier:
        whole |= s.numbers[a.owner] > p.value[p.pair]
    begin, end = [a.first[whole]], [a.last[whole] + plan.window]
    sent = sent_windows(plan, s, p, code)
    yes = _codes(replies, WINDOWS, len(sent.hashes))[sent.which] > 0
    if plan.earlier:
        yes |= sent.own > sent.value[sent.which]
    found = [(sent.owner[yes], sent.begin[yes])]
    if plan.sorter:
        chosen = p.example[((code & SENDS) > 0) & ((code & BY_HASH) == 0)]
        masks = np.frombuffer(b"".join(replies_of(replies, SORTED, "codes")), np.uint8).reshape(-1, plan.mask_bytes)
        if len(masks) != len(chosen):
            raise RuntimeError("the input's rows changed between two reads")
        for bit in range(plan.window - plan.k + 1):
            on = masks[:, bit >> 3] >> (bit & 7) & 1 > 0
            found.append((chosen[on], a.place[chosen[on]] - bit))
    # every occurrence of a representative's pair in the same document repeats like it
    owner, at = (np.concatenate(c) for c in zip(*found, strict=True))
    begin.append(at)
    end.append(at + plan.window)
    pair_of, offset = p.pair[owner], a.place[owner] - at
    rest = np.flatnonzero(~whole & (code[p.pair] & SENDS > 0))
    rest = rest[p.example[p.pair[rest]] != rest]
    if len(rest) and len(pair_of):
        order = np.argsort(pair_of, kind="stable")
        lo, hi = np.searchsorted(pair_of[order], p.pair[rest]), np.searchsorted(pair_of[order], p.pair[rest], "right")
        n = hi - lo
        pick = order[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        again = a.place[np.repeat(rest, n)] - offset[pick]
        begin.append(again)
        end.append(again + plan.window)
    return covered(len(s.values), np.concatenate(begin), np.concatenate(end))


def _codes(replies: pa.Table, kind: int, n: int) -> np.ndarray:
    got = answers_of(replies, kind, "codes", 1).astype(np.uint8)
    if len(got) != n:
        raise RuntimeError("the input's rows changed between two reads")
    return got


def find(plan: Plan, chunks: DataFrame, finish: Callable[[pa.Table, Sequences, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """finish() of every chunk's table, its sequences and their marks."""

    def questions(table: pa.Table) -> list[tuple]:
        p = pairs_of(plan, plan.sequences(table))
        return [
            (b, CLASSES, pack(p.key[i:j], KEY), pack(p.edge[i:j], EDGE), pack(p.value[i:j], plan.width)) for b, i, j in cuts(p.key, plan.buckets)
        ]

    settled = stored(answer(ask(chunks, questions, ASKED), settle(plan), REPLIED), "classes")

    def sending(table: pa.Table, replies: pa.Table) -> pa.Table:
        s = plan.sequences(table)
        p = pairs_of(plan, s)
        code = _codes(replies, CLASSES, len(p.key))
        sent = sent_windows(plan, s, p, code)
        rows = [(b, WINDOWS, pack(sent.hashes[i:j], 8), None, pack(sent.value[i:j], plan.width)) for b, i, j in cuts(sent.hashes, plan.buckets)]
        if plan.sorter:
            chosen = np.flatnonzero(((code & SENDS) > 0) & ((code & BY_HASH) == 0))
            rows += plan.sorter.questions(plan, table, s, p, chosen)
        chunk = table["chunk"][0].as_py() if table.num_rows else None
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        names = ("bucket", "kind", "keys", "more", "counts")
        return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64())} | {n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})

    def answered(columns: dict[str, list]) -> list[tuple]:
        out: list[tuple] = []
        for kind, how in ((WINDOWS, windows_repeat), (SORTED, plan.sorter.answers if plan.sorter else None)):
            at = [i for i, x in enumerate(columns["kind"]) if x == kind]
            if at:
                out += how(plan, {n: [c[i] for i in at] for n, c in columns.items()})
        return out

    asked = chunks.groupBy("chunk").cogroup(settled.groupBy("chunk")).applyInArrow(sending, f"chunk bigint, {ASKED}")
    replies = settled.unionByName(answer(asked, answered, REPLIED))

    def finished(table: pa.Table, replies: pa.Table) -> pa.Table:
        s = plan.sequences(table)
        return finish(table, s, marks(plan, s, replies))

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finished, schema)


def runs(marked: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, run begins, run ends) of each sequence, runs counted from its begin."""
    at = 0
    for n in lengths.tolist():
        own = marked[at : at + n]
        step = np.diff(own.astype(np.int8), prepend=0, append=0)
        yield at, at + n, np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        at += n
