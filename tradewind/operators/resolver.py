"""Names typed by people resolved to cards: fields with weights, prefixes, up to two edits, and a popularity prior.

A query word meets a vocabulary word exactly (1), as a prefix of at least four
letters (0.72 and 0.2 times the share typed), or within one edit or swap from
four letters (0.8), two from six (0.55, 0.6 from eight).  It counts with the
weight of the word it most likely means.  A card's score is the weighted mean of
its best hits, times 0.72 and 0.28 for the share of its name that was hit, and
0.1 times the share of its version; the full name adds 0.08.

Cards under ``least`` coverage are no answers.  As no hit counts more than its
word's weight, such a card hits one of the query's heaviest words, those without
which the others' weights stay under that share.  Only these words fetch
candidates, so frequent words are looked up in candidates but never joined with
all cards that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.functions.text import deletions, osa_distance, words
from tradewind.sinks.shared import staged

#: A hit's weight by field.
FIELD_WEIGHTS = {"name": 1.0, "version": 0.92, "extra": 0.36}


def _two_deletions(word: str) -> Column:
    """The word and it without any one or two letters: words within two edits or swaps share one of these."""
    return F.array_distinct(F.flatten(F.transform(deletions(word), lambda d: F.concat(F.array(d), F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.concat(F.substring(d, F.lit(1), i - 1), F.substring(d, i + 1, F.length(d))))))))


def expansions(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(q, word, quality) for the words of asked(q) against vocabulary(word); distances only for pairs that share a deletion."""
    q, word = F.length("q"), F.length("word")
    exact = asked.hint("merge").join(vocabulary.withColumn("q", F.col("word")), "q").select("q", "word", F.lit(1.0).alias("quality"))
    starts = vocabulary.where(word > 4).withColumn("q", F.explode(F.transform(F.sequence(F.lit(4), word - 1), lambda i: F.substring("word", F.lit(1), i))))
    # keys are many times their words, which the planner doesn't see: their tables are shuffled, never sent to the driver
    prefix = asked.hint("merge").join(starts, "q").select("q", "word", (0.72 + 0.2 * q / word).alias("quality"))
    dealt = lambda t, of, least, keys: t.where(F.length(of) >= least).withColumn("d", F.explode(keys(of)))
    one = dealt(asked, "q", 4, deletions).hint("merge").join(dealt(vocabulary, "word", 3, deletions), "d").select("q", "word")
    two = dealt(asked, "q", 6, _two_deletions).hint("merge").join(dealt(vocabulary, "word", 4, _two_deletions), "d").select("q", "word")
    pairs = one.unionByName(two).distinct().where(F.col("q") != F.col("word")).withColumn("edits", osa_distance("q", "word"))
    near = pairs.where((F.col("edits") == 1) | ((F.col("edits") == 2) & (q >= 6)))
    quality = F.when(F.col("edits") == 1, 0.8).when(q >= 8, 0.6).otherwise(0.55)
    found = exact.unionByName(prefix).unionByName(near.select("q", "word", quality.alias("quality")))
    return found.groupBy("q", "word").agg(F.max("quality").alias("quality"))


def resolve_cards(queries: DataFrame, cards: DataFrame, k: int = 5, least: float = 0.5, stop: tuple[str, ...] = (), collector: bool = False) -> DataFrame:
    """The k best cards(cid, name, version, extra, played, collected) of each of queries(qid, text), with their places.

    ``played`` and ``collected`` lie between 0 and 1 and break near-ties: 0.12
    and 0.03 of them are added, for collectors 0.03 and 0.1.  Null fields are
    empty; queries without words, or that no card answers, give no rows; equal
    ranks go to the smaller cid.
    """
    field = lambda c: F.transform(words(c), lambda w: F.struct(F.lit(c).alias("field"), w.alias("word"), F.lit(FIELD_WEIGHTS[c]).alias("f")))
    held = cards.select("cid", F.explode(F.concat(*(field(c) for c in FIELD_WEIGHTS))).alias("h")).select("cid", "h.*")
    n = cards.agg(F.count("*").alias("n"))  # one row
    named = F.countDistinct(F.when(F.col("field") != "extra", F.col("cid")))
    vocabulary = held.groupBy("word").agg(F.greatest(named, F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("word", F.least(F.lit(3.0), F.log(1 + F.col("n") / F.col("df"))).alias("idf"))
    asked = queries.select("qid", F.explode(words("text")).alias("q"))
    distinct = asked.select("q").distinct()
    met = staged(expansions(distinct, vocabulary.select("word")), "met")  # three steps below read it
    # all of these tables grow with the cards or the queries: none is sent to the driver
    meant = met.hint("merge").join(vocabulary, "word").groupBy("q").agg(F.max_by("idf", F.struct("quality", "idf")).alias("meant"))
    is_stop = lambda c: c.isin(*stop) if stop else F.lit(False)
    weight = F.when(is_stop(F.col("q")), 0.12).otherwise(F.coalesce("meant", F.lit(1.2)))
    own = W.partitionBy("qid")
    lighter = own.orderBy("w", F.desc("q"))  # the sum up to a word is what it and all lighter ones can give
    weighed = asked.hint("merge").join(meant, "q", "left").select("qid", "q", weight.alias("w"))
    weighed = weighed.select("*", F.sum("w").over(own).alias("total"), F.sum("w").over(lighter.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    hits = weighed.hint("merge").join(met, "q")
    fetching = hits.where(F.col("upto") >= least * F.col("total") - 1e-6).select("qid", "word").distinct()
    candidates = fetching.hint("merge").join(held.select("cid", "word"), "word").select("qid", "cid").distinct()
    found = candidates.hint("merge").join(held, "cid").hint("merge").join(hits, ["qid", "word"])
    hit = F.max(F.struct((F.col("quality") * F.col("f")).alias("s"), "field", "word")).alias("hit")
    by_word = found.groupBy("qid", "cid", "q", "w", "total").agg(hit)
    of = lambda c: F.size(F.collect_set(F.when((F.col("hit.field") == c) & ~is_stop(F.col("hit.word")), F.col("hit.word"))))
    summed = by_word.groupBy("qid", "cid").agg((F.sum(F.col("w") * F.col("hit.s")) / F.first("total")).alias("coverage"), of("name").alias("n_name"), of("version").alias("n_version"))
    summed = summed.where(F.round("coverage", 6) >= least)
    told = lambda c: F.size(F.filter(words(c), lambda w: ~is_stop(w)))
    facts = cards.select("cid", "played", "collected", told("name").alias("c"), told("version").alias("v"), F.array_join(words(F.concat_ws(" ", "name", "version")), " ").alias("full"))
    scored = summed.hint("merge").join(facts, "cid").hint("merge").join(queries.select("qid", F.array_join(words("text"), " ").alias("typed")), "qid")
    share = lambda hits_, all_: F.coalesce(F.col(hits_) / F.nullif(F.col(all_), F.lit(0)), F.lit(0.0))
    score = F.col("coverage") * (0.72 + 0.28 * share("n_name", "c")) + 0.1 * share("n_version", "v") + F.when(F.col("full") == F.col("typed"), 0.08).otherwise(0.0)
    by_play, by_worth = (0.03, 0.1) if collector else (0.12, 0.03)
    prior = by_play * F.coalesce("played", F.lit(0.0)) + by_worth * F.coalesce("collected", F.lit(0.0))
    ranked = scored.select("qid", "cid", F.round("coverage", 6).alias("coverage"), F.round(score + prior, 6).alias("rank"))
    place = F.row_number().over(own.orderBy(F.desc("rank"), "cid"))
    return ranked.withColumn("place", place).where(F.col("place") <= k)
