"""Toxic documents and their offending sentences, by multiple-instance learning.

A document is a bag of sentences.  A sentence has a probability of being toxic,
from the words that it holds; noisy-or combines them: a document is clean if
all its sentences are.  Only documents are labelled, so the sentences' weights
are learned from the bags, and the sentences that a label comes from are found
with them.

1. A bounded sample of labelled rows (those of smallest hash, ``train_rows`` at
   most) is joined to the documents and stored.
2. Tasks count, for every word and every beginning of a word, the sample's
   documents and toxic documents that hold it; Spark sums the counts, and the
   ``max_features`` with most evidence (likelihood ratio) for toxic documents
   are kept.  Beginnings stand for words that are inflected or compounded.
3. The sample's sentences, as sets of kept features, fit the weights and the
   bias of a sentence by gradient descent on the bags' likelihood.
4. One pass scores all sentences of all documents, text by text.

Defined results: a null or empty text has no sentences and scores zero; a null
id is never held out, and never learned from; rows may repeat and are scored
each; where an id's labels differ, it counts as toxic; without toxic rows to
learn from all scores are zero; other columns aren't read.  A sentence runs from
its first word to its last, between line ends and ``. ! ?`` (and their wide
forms); texts are read in blocks that end with a sentence, and only a sentence
of more than ``BLOCK`` bytes is cut into several.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.hashing import SpanHashes, mix
from tradewind.llm.storage import Stored

BLOCK = 2 << 20
#: Bytes of the beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Likelihood ratio (chi-squared with one degree of freedom) that chance exceeds once in a thousand features.
LEAST_EVIDENCE = 10.83

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[*b"\n.!?"]] = True
#: The last bytes of wide full stops, exclamation and question marks, by their first two.
_WIDE = {(0xE3, 0x80): (0x82,), (0xEF, 0xBC): (0x81, 0x9F)}


class Block(NamedTuple):
    """Neighbouring texts, or a part of one: words' features, and the sentences that hold them."""

    feature: np.ndarray  # hashes
    sentence: np.ndarray  # of each feature
    text: np.ndarray  # of each sentence, numbered in the batch
    begin: np.ndarray  # of each sentence: bytes from its text's first
    end: np.ndarray


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begins of texts in them, the texts' numbers, bytes before) of about a block each."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if len(t) > BLOCK:
            at = 0
            while at < len(t):
                to = len(t)
                if to - at > BLOCK:
                    low = t[at : at + BLOCK]
                    cut = max(low.rfind(c) for c in (b"\n", b".", b"!", b"?")) + 1 or low.rfind(b" ") + 1
                    to = at + (cut or BLOCK)
                yield t[at:to] + b"\n", np.zeros(1, np.int64), np.array([i]), np.array([at])
                at = to
            continue
        if held and size + len(t) > BLOCK:
            yield _joined(held)
            held, size = [], 0
        held.append((i, t))
        size += len(t) + 1
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) + 1 for _, t in held])
    return b"\n".join(t for _, t in held) + b"\n", np.cumsum(lengths) - lengths, np.array([i for i, _ in held]), np.zeros(len(held), np.int64)


def blocks(texts: list[bytes]) -> Iterator[Block]:
    """The sentences of all texts with their features."""
    for joined, starts, numbers, before in _pieces(texts):
        data = np.frombuffer(joined.lower(), np.uint8)
        ends, word = _END[data], _WORD[data]
        for (first, second), thirds in _WIDE.items():
            at = np.flatnonzero((data[:-2] == first) & (data[1:-1] == second) & np.isin(data[2:], thirds))
            ends[at + 2] = True
            word[np.concatenate((at, at + 1, at + 2))] = False
        begin = np.flatnonzero(word & ~np.append(False, word[:-1]))
        end = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
        if not len(begin):
            continue
        sentence = np.cumsum(ends)[begin]
        first = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
        last = np.append(first[1:], len(begin)) - 1
        sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(begin))))
        hashes = SpanHashes(data, begin)
        features, owners = [hashes.of(begin, end)], [sentence]
        for k in BEGINNINGS:
            long = end - begin >= k
            features.append(mix(hashes.of(begin[long], begin[long] + k) + np.uint64(k)))
            owners.append(sentence[long])
        text = np.searchsorted(starts, begin[first], side="right") - 1
        yield Block(np.concatenate(features), np.concatenate(owners), numbers[text], begin[first] - starts[text] + before[text], end[last] - starts[text] + before[text])


class Model(NamedTuple):
    """Features as sorted hashes, their weights, and the weight of any sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def kept(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, number of feature) of a block's known features, each once a sentence."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.zeros(1 << 16, bool)
        low[self.features & np.uint64(0xFFFF)] = True
        some = np.flatnonzero(low[block.feature & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.features, block.feature[some]), len(self.features) - 1)
        hit = self.features[at] == block.feature[some]
        both = np.unique(block.sentence[some][hit] * len(self.features) + at[hit])
        return both // len(self.features), both % len(self.features)

    def logits(self, block: Block) -> np.ndarray:
        """Each sentence's logit."""
        sentence, feature = self.kept(block)
        return self.bias + np.bincount(sentence, self.weights[feature], len(block.text))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Bags(NamedTuple):
    """Training documents: features of sentences that have any, and how many have none."""

    toxic: np.ndarray
    plain: np.ndarray  # sentences without features, by document
    document: np.ndarray  # of each sentence with features
    sentence: np.ndarray  # of each feature
    feature: np.ndarray


def fit(bags: Bags, features: np.ndarray, rounds: int, decay: float) -> Model:
    """Weights and bias of the largest likelihood less decay, by adaptive steps over all bags."""
    n, m = len(features), len(bags.toxic)
    w, first, second = np.append(np.zeros(n), -5.0), np.zeros(n + 1), np.zeros(n + 1)
    toxic = bags.toxic.astype(float)
    for k in range(1, rounds + 1):
        z = w[n] + np.bincount(bags.sentence, w[bags.feature], len(bags.document))
        doubt = np.bincount(bags.document, np.logaddexp(0, z), m) + bags.plain * np.logaddexp(0, w[n])
        # a bag is clean with probability exp(-doubt)
        slope = (1 - toxic) - toxic / np.expm1(np.clip(doubt, 1e-9, 60))
        by_sentence = slope[bags.document] * sigmoid(z)
        grad = np.append(np.bincount(bags.feature, by_sentence[bags.sentence], n), by_sentence.sum() + (slope * bags.plain).sum() * sigmoid(w[n])) / m
        grad[:n] += decay * w[:n]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Model(features, w[:n], float(w[n]))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").to_pylist()]


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n, n_toxic): documents of the task that hold each feature."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counted() -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        toxic = np.bincount(at, np.concatenate([t for _, t in held]), len(keys))
        n = np.bincount(at, minlength=len(keys))
        held.clear()
        return pa.RecordBatch.from_pydict({"feature": keys.view(np.int64), "n": n, "n_toxic": toxic.astype(np.int64)})

    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for some in blocks(_texts(batch)):
            owner = some.text[some.sentence]
            order = np.lexsort((some.feature, owner))
            f, d = some.feature[order], owner[order]
            new = np.append(True, (f[1:] != f[:-1]) | (d[1:] != d[:-1]))
            held.append((f[new], toxic[d[new]]))
            if sum(len(h) for h, _ in held) > 3_000_000:
                yield counted()
    if held:
        yield counted()


def _evidence(features: np.ndarray):
    """Packs each document's sentences as numbers of kept features."""
    model = Model(features, np.zeros(len(features)), 0.0)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for some in blocks(_texts(batch)):
                sentence, feature = model.kept(some)
                texts, first = np.unique(some.text, return_index=True)
                last = np.append(first[1:], len(some.text))
                a, b = np.searchsorted(sentence, first), np.searchsorted(sentence, last)
                yield pa.RecordBatch.from_pydict(
                    {
                        "toxic": toxic[texts].astype(np.int32),
                        "sentences": pa.array(last - first, pa.int64()),
                        "owners": [(sentence[i:j] - k).astype("<i4").tobytes() for i, j, k in zip(a, b, first)],
                        "features": [feature[i:j].astype("<i4").tobytes() for i, j in zip(a, b)],
                    }
                )

    return packed


def _bags(rows: list) -> Bags:
    toxic, plain, document, sentence, feature = [], [], [], [], []
    base = 0
    for i, r in enumerate(rows):
        own, at = np.unique(np.frombuffer(r.owners, "<i4"), return_inverse=True)
        toxic.append(r.toxic)
        plain.append(r.sentences - len(own))
        document.append(np.full(len(own), i))
        sentence.append(at + base)
        feature.append(np.frombuffer(r.features, "<i4").astype(np.int64))
        base += len(own)
    return Bags(np.array(toxic), np.array(plain), *(np.concatenate(x) for x in (document, sentence, feature)))


def held_out(doc_id: F.Column, folds: int, fold: int) -> F.Column:
    """Whether a document is left out of learning: its id's hash falls into the fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    folds: int = 4,
    held_out_fold: int = 2,
    train_rows: int = 20_000,
    min_documents: int = 3,
    max_features: int = 4096,
    rounds: int = 300,
    decay: float = 1e-5,
) -> Model:
    """Learns from labelled documents outside the held-out fold, ``train_rows`` at most.

    The driver gets the features of largest evidence and the sample's sentences
    as their numbers; both are bounded by the parameters.
    """
    given = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    given = given.where(~held_out(F.col("doc_id"), folds, held_out_fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    sample = Stored(own.join(F.broadcast(some), "doc_id").select("doc_id", "toxic", "text"), "labelled")
    n, n_toxic = sample.rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    features = np.zeros(0, np.uint64)
    if n_toxic and n_toxic < n:
        counts = sample.rows.select("toxic", "text").mapInArrow(_feature_counts, "feature bigint, n bigint, n_toxic bigint")
        counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("k")).where(F.col("n") >= min_documents)
        term = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
        clean, share = F.col("n") - F.col("k"), n_toxic / n
        found = counts.where(F.col("k") > F.col("n") * share).withColumn("evidence", 2 * (term(F.col("k"), F.col("n") * share) + term(clean, F.col("n") * (1 - share))))
        best = found.where(F.col("evidence") >= LEAST_EVIDENCE).orderBy(F.desc("evidence"), "feature").limit(max_features).select("feature").collect()
        features = np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))
    if not n_toxic:
        model = Model(features, np.zeros(0), -np.inf)
    else:
        rows = sample.rows.select("doc_id", "toxic", "text").mapInArrow(_evidence(features), "toxic int, sentences bigint, owners binary, features binary").collect()
        rows.sort(key=lambda r: (r.toxic, r.sentences, r.features, r.owners))  # the same sums whatever the tasks' order
        model = fit(_bags(rows), features, rounds, decay) if rows else Model(features, np.zeros(0), -np.inf)
    sample.drop()
    return model


def toxic_sentences(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """(doc_id, score, n_sentences, offending): one row per row of docs.

    offending lists the sentences of probability ``least`` or more as (start,
    length, score); ``substring(text, start + 1, length)`` is the sentence.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    places = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            doubt, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            found: list[list[dict]] = [[] for _ in texts]
            for some in blocks(texts):
                z = model.logits(some)
                np.add.at(doubt, some.text, np.logaddexp(0, z))
                np.add.at(count, some.text, 1)
                for s in np.flatnonzero(sigmoid(z) >= least).tolist():
                    t, a, b = texts[some.text[s]], int(some.begin[s]), int(some.end[s])
                    found[some.text[s]].append({"start": a, "length": len(t[a:b].decode()), "score": float(sigmoid(z[s : s + 1])[0])})
            for t, own in zip(texts, found):
                at = chars = 0
                for p in own:  # in the text's order
                    chars += len(t[at : p["start"]].decode())
                    at, p["start"] = p["start"], chars
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(-np.expm1(-doubt)), pa.array(count), pa.array(found, places)], ["doc_id", "score", "n_sentences", "offending"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        scored, f"doc_id {kind}, score double, n_sentences bigint, offending array<struct<start: bigint, length: bigint, score: double>>"
    )


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out_fold: int = 2, limit: float = 0.3, **options: object) -> DataFrame:
    """Trains and scores: (doc_id, held_out, score, predicted, n_sentences, offending)."""
    model = train(docs, labels, folds=folds, held_out_fold=held_out_fold, **options)
    scored = toxic_sentences(docs, model, least=limit)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, held_out_fold).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"), "n_sentences", "offending")
