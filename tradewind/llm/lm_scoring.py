"""Language-model scoring by a weighted backoff automaton.

The model is an n-gram model smoothed level by level with a Dirichlet prior:
p(w | h) = (c(hw) + prior * p(w | h')) / (c(h) + prior), where h' is h without
its first word.  Words seen in training get (c - D) / N at the lowest level,
and the mass D * V / N that the discount D = n1 / (n1 + 2 * n2) frees goes to
the class of all other words; so all classes sum to one after every history.

The automaton is compiled from the counts: every n-gram of up to ``order - 1``
words that stands in the training text is a state, a word that follows it there
is an arc with the smoothed weight and the longest state it leads to, and a
failure arc leads to the state without the first word, at the weight
prior / (c(h) + prior).  Documents are scored in one traversal from left to
right that carries the state, takes failure arcs until an arc for the word
exists, and adds up the weights.  Lanes of at most ``lane`` tokens advance side
by side; a lane begins with the state that the ``order - 1`` words before it
lead to, which is all that a state can depend on.

No task holds the whole automaton: a chunk of documents asks for the counts of
its own distinct n-grams (see exchange.py) and compiles the states and arcs
that its texts can reach, so what is gathered grows with the text.

Defined results: a null or empty text is its end alone; rows may repeat and
count each; a null id counts as training; an empty table gives no rows; with
no training text every word is unknown; columns besides id and text aren't read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.exchange import answer, ask, chunked, counts_of, cuts, pack_counts, pack_sorted, sizes, texts, unpack_counts, unpack_sorted
from tradewind.llm.hashing import mix, words_of
from tradewind.llm.storage import stored

END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
#: Bits that are sent of a longer n-gram's key besides those that name the bucket; words' keys are sent whole.
LONGER = 48


class Tokens(NamedTuple):
    """A chunk's tokens, each document framed by a begin and an end."""

    keys: list[np.ndarray]  # by order - 1: hash of the n-gram that ends at each place
    begins: np.ndarray  # place of each document's begin
    counts: np.ndarray  # tokens of each document, with the end
    scored: np.ndarray  # False at begins


def tokens(raw: list[bytes], order: int) -> Tokens:
    """Words in lower case (A-Z), framed, with the hashes of all n-grams; those that reach before a begin end there."""
    words, n = words_of(raw, lower=True)
    counts = n + 1
    begins = np.cumsum(counts + 1) - (counts + 1)
    total = int((counts + 1).sum())
    ids = np.zeros(total, np.uint64)
    scored = np.ones(total, bool)
    scored[begins] = False
    inner = scored.copy()
    inner[begins + counts] = False
    ids[inner], ids[begins], ids[begins + counts] = words, BEGIN, END
    keys = [ids]
    place = np.arange(total) - np.repeat(begins, counts + 1)
    for k in range(2, order + 1):
        before = np.append(np.uint64(0), keys[-1][:-1])
        longer = mix(before * np.uint64(0x9FB21C651E98DF25) + ids * np.uint64(2) + np.uint64(k))
        keys.append(np.where(place >= k - 1, longer, keys[-1]))  # a shorter n-gram with the begin stands for itself
    return Tokens(keys, begins, counts, scored)


class Grams(NamedTuple):
    """A chunk's distinct n-grams of one length."""

    keys: np.ndarray  # sorted
    train: np.ndarray  # how often each stands in the chunk's training texts
    where: np.ndarray  # number of the n-gram that ends at each place, -1 at begins for single words
    example: np.ndarray  # a place where it ends


def _distinct(t: Tokens, order: int, train: np.ndarray) -> list[Grams]:
    """By order - 1; single words leave the begin out, which longer n-grams hold as one of their own."""
    in_training = np.repeat(train, t.counts + 1)
    out = []
    for k in range(1, order + 1):
        use = np.flatnonzero(t.scored) if k == 1 else np.arange(len(t.scored))
        keys, first, inverse = np.unique(t.keys[0][use] if k == 1 else np.where(t.scored, t.keys[k - 1], BEGIN), return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=in_training[use], minlength=len(keys)).astype(np.int64)
        where = np.full(len(t.scored), -1)
        where[use] = inverse
        out.append(Grams(keys, n, where, use[first]))
    return out


def _sent(keys: np.ndarray, k: int, buckets: int) -> np.ndarray:
    """What of sorted keys is sent; it stays sorted."""
    return keys if k == 1 else keys >> np.uint64(max(0, 64 - LONGER - (buckets - 1).bit_length()))


def _count(columns: dict[str, list]) -> list[tuple]:
    """Totals for every question of a bucket; the last row of an order has its numbers of types, tokens, ones and twos."""
    out = []
    for kind in sorted(set(columns["kind"])):
        at = [i for i, k in enumerate(columns["kind"]) if k == kind]
        own = [unpack_sorted(columns["keys"][i]) for i in at]
        keys, n = np.concatenate(own), np.concatenate([unpack_counts(columns["counts"][i]) for i in at])
        distinct, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=n, minlength=len(distinct)).astype(np.int64)
        sizes = np.cumsum([0] + [len(x) for x in own]).tolist()
        replies = total[inverse]
        out += [
            (columns["chunk"][i], columns["bucket"][i], kind, pack_counts(replies[a:b]), None, None, None, None)
            for i, a, b in zip(at, sizes, sizes[1:])
        ]
        if kind == 1:
            out.append((None, None, kind, None, int((total > 0).sum()), int(total.sum()), int((total == 1).sum()), int((total == 2).sum())))
    return out


class Automaton:
    """The states and arcs that a chunk's texts can reach.

    State 0 is the empty history; then come the words, the begin, and level by
    level the longer n-grams.  Arcs of a level are sorted by state and word.
    """

    def __init__(self, grams: list[Grams], totals: list[np.ndarray], begins: np.ndarray, types: int, size: int, discount: float, priors: list[float]) -> None:
        """totals: by order - 1, how often each n-gram stands in all training texts."""
        self.order, order = len(grams), len(grams)
        words = len(grams[0].keys)
        self.words, n = words, max(size, 1)
        # the number of the state for the n-gram that ends at each place, by length; begins are states of one word
        first = [0, 1, *(1 + words + 1 + np.cumsum([0, *(len(g.keys) for g in grams[1:])])).tolist()]
        at = [np.zeros(len(grams[0].where), np.int64), np.where(grams[0].where >= 0, 1 + grams[0].where, 1 + words)]
        at += [first[k] + grams[k - 1].where for k in range(2, order)]
        self.at, self.word = at, grams[0].where
        in_begin = totals[1][grams[1].where[begins[:1]]] if order > 1 and len(begins) else np.zeros(1, np.int64)
        seen = [np.zeros(1, np.int64), np.append(totals[0], in_begin), *totals[1 : order - 1]]
        seen = np.concatenate(seen[:order]) if order > 1 else seen[0]  # of each state
        self.fail, self.fail_weight = np.zeros(len(seen), np.int64), np.zeros(len(seen))
        p = np.where(totals[0] > 0, (totals[0] - discount) / n, (discount * types / n) if size else 1.0)
        self.unknown = np.log10(discount * types / n) if size else 0.0
        known = np.flatnonzero(totals[0])
        self.arcs = [(known, np.log10(p[known]), (1 + known) if order > 1 else np.zeros(len(known), np.int64))]
        shorter = p  # by n-gram of the length before
        for k in range(2, order + 1):
            g, c, place, prior = grams[k - 1], totals[k - 1], grams[k - 1].example, priors[k - 2]
            inner = grams[k - 2].where[place] >= 0  # all but the begin itself
            of_history = at[k - 1][place - 1]
            p = (c + prior * shorter[grams[k - 2].where[place]]) / (seen[of_history] + prior)
            states = slice(first[k - 1], first[k]) if k > 2 else slice(1, 2 + words)
            self.fail_weight[states] = np.log10(prior / (seen[states] + prior))
            if k > 2:
                self.fail[states] = at[k - 2][grams[k - 2].example]
            arc = np.flatnonzero((c > 0) & inner)
            key = of_history[arc] * (words + 1) + grams[0].where[place[arc]]
            sort = np.argsort(key)
            to = at[k][place[arc]] if k < order else at[order - 1][place[arc]]
            self.arcs.append((key[sort], np.log10(p[arc])[sort], to[sort]))
            shorter = p
        self.level = np.zeros(len(seen), np.int64)
        for k in range(1, order):
            self.level[first[k] : first[k + 1]] = k

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of reading a word in each state."""
        weight, after, open_ = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        state = state.copy()
        for k in range(self.order, 0, -1):
            keys, weights, targets = self.arcs[k - 1]
            here = open_[self.level[state[open_]] == k - 1]
            if not len(here):
                continue
            want = state[here] * (self.words + 1) + word[here] if k > 1 else word[here]
            place = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            found = keys[place] == want if len(keys) else np.zeros(len(here), bool)
            hit, miss = here[found], here[~found]
            weight[hit] += weights[place[found]]
            after[hit] = targets[place[found]]
            if k > 1:
                weight[miss] += self.fail_weight[state[miss]]
                state[miss] = self.fail[state[miss]]
            else:
                weight[miss] += self.unknown
            keep = np.ones(len(state), bool)
            keep[hit] = False
            open_ = open_[keep[open_]]
        return weight, after

    def traverse(self, begins: np.ndarray, counts: np.ndarray, lane: int) -> np.ndarray:
        """The log10 probability of each document."""
        cut = -(-counts // lane)
        doc = np.repeat(np.arange(len(counts)), cut)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(cut) - cut, cut)) * lane  # tokens of the document before the lane
        size = np.minimum(lane, counts[doc] - first)
        warm = np.minimum(first, self.order - 1)
        at = begins[doc] + 1 + first - warm
        steps = size + warm
        rank = np.argsort(-steps, kind="stable")
        doc, at, steps, warm = doc[rank], at[rank], steps[rank], warm[rank]
        state = np.where(warm == first[rank], 1 + self.words if self.order > 1 else 0, 0)  # at a begin, its state
        total = np.zeros(len(doc))
        on = len(doc)
        for t in range(int(steps[0]) if on else 0):
            while on and steps[on - 1] <= t:
                on -= 1
            weight, state[:on] = self.step(state[:on], self.word[at[:on] + t])
            total[:on] += np.where(t >= warm[:on], weight, 0.0)
        return np.bincount(doc, weights=total, minlength=len(counts))


def score(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = 3,
    prior: tuple[float, ...] = (100.0, 4.0),
    lane: int = 512,
    folds: int = 7,
    held_out_fold: int = 2,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``prior`` is the weight of the shorter history after one word, two words and
    so on; the last one holds for all longer histories.
    """
    priors = [prior[min(k, len(prior) - 1)] for k in range(order - 1)]
    fold = F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))
    buckets, rows_log2 = sizes(docs, text)
    chunks = chunked(docs, doc_id, text, rows_log2, (fold == held_out_fold).alias("held_out"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def questions(table: pa.Table) -> list[tuple]:
        train = ~table["held_out"].to_numpy(zero_copy_only=False)
        out = []
        for k, g in enumerate(_distinct(tokens(texts(table), order), order, train), 1):
            out += [(b, k, pack_sorted(_sent(g.keys[i:j], k, buckets)), pack_counts(g.train[i:j])) for b, i, j in cuts(g.keys, buckets)]
        return out

    asked = ask(chunks, questions, "bucket int, kind int, keys binary, counts binary")
    replies = stored(
        answer(asked, _count, "chunk bigint, bucket int, kind int, totals binary, types bigint, size bigint, ones bigint, twos bigint"), "counts"
    )
    types, size, ones, twos = (v or 0 for v in replies.agg(*(F.sum(c) for c in ("types", "size", "ones", "twos"))).first())
    discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5

    def scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
        t = tokens(texts(docs), order)
        held = docs["held_out"].to_numpy(zero_copy_only=False)
        grams, totals = _distinct(t, order, ~held), []
        for k, g in enumerate(grams, 1):
            totals.append(counts_of(counts, k, "totals"))
            if len(totals[-1]) != len(g.keys):
                raise RuntimeError("the input's rows changed between two reads")
        model = Automaton(grams, totals, t.begins, types, size, discount, priors)
        c = totals[0][grams[0].where[t.scored]]
        ends = np.cumsum(t.counts)
        add = lambda v: np.diff(np.append(0, np.cumsum(v))[np.append(0, ends)])
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": docs["held_out"],
                "n_tokens": pa.array(t.counts.astype(np.int64)),
                "n_known": pa.array(add((c > 0).astype(np.int64))),
                "train_tokens": pa.array([size] * len(t.counts), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10((c + 1) / (size + types + 1)), ends - t.counts)),
                "score": pa.array(model.traverse(t.begins, t.counts, lane)),
            }
        )

    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(replies.where("chunk IS NOT NULL").select("chunk", "bucket", "kind", "totals").groupBy("chunk")).applyInArrow(scored, out)
