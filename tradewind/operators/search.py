"""Text and vector search: candidates by shared tokens or blocks, scores, and the best of each query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.functions.text import containment, deletions, osa_distance, trigrams, words


def best(rows: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key with their place; ties go to the smaller tie column."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), tie))).where(F.col("place") <= k)


def token_match(queries: DataFrame, cards: DataFrame, k: int = 8, least: int = 3, bonus: float = 6.0) -> DataFrame:
    """queries(qid, text) against cards(cid, text, number) by the summed idf of shared words.

    idf is ln(1 + N / df) over the cards; a query that holds a collector number
    "n/m" adds ``bonus`` to cards of that number.  Candidates are the cards that
    share a word, so nothing is multiplied out; frequent words are joined as
    skewed keys, which adaptive execution splits.
    """
    n = cards.agg(F.count("*").alias("n"))  # one row
    held = cards.select("cid", F.explode(words("text", least)).alias("word"))
    idf = held.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    asked = queries.select("qid", F.explode(words("text", least)).alias("word"))
    summed = asked.join(held.join(idf, "word"), "word").groupBy("qid", "cid").agg(F.round(F.sum("idf"), 6).alias("idf_sum"))
    numbers = queries.select("qid", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\d{1,3})\s*/\s*\d{2,3}\b"), F.lit(1)))).alias("number"))
    boosted = numbers.join(cards.select("cid", F.col("number").cast("string").alias("number")), "number").select("qid", "cid").distinct().withColumn("bonus", F.lit(bonus))
    scored = summed.join(boosted, ["qid", "cid"], "left").select("qid", "cid", F.round(F.col("idf_sum") + F.coalesce("bonus", F.lit(0.0)), 6).alias("score"))
    return best(scored, "qid", "score", "cid", k)


def trigram_version(queries: DataFrame, versions: DataFrame, floor: float = 0.22, margin: float = 0.12, least: int = 12) -> DataFrame:
    """queries(qid, name, text) to the version of that name whose text holds most of the query's trigrams.

    Decided only above ``floor`` and with ``margin`` over the next version;
    queries of fewer than ``least`` trigrams, and names of one version, abstain.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    asked = queries.select("qid", "name", bare("text").alias("t")).withColumn("q", trigrams("t")).where(F.size("q") >= least).drop("t")
    held = versions.select("name", "version", bare("text").alias("t")).withColumn("v", trigrams("t")).drop("t")
    scored = asked.join(held, "name").groupBy("qid", "version").agg(F.max(containment("q", "v")).alias("score"))
    top = scored.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "version")), asc=False), 1, 2).alias("top"), F.count("*").alias("n"))
    first, second = F.col("top")[0], F.get("top", F.lit(1))
    decided = (first["score"] >= floor) & (first["score"] - second["score"] >= margin)
    return top.where("n > 1").where(decided).select("qid", first["version"].alias("version"), F.round(first["score"], 6).alias("score"), F.round(first["score"] - second["score"], 6).alias("margin"))


def fused(lists: DataFrame, k: int = 60) -> DataFrame:
    """Ranked lists(qid, list_no, weight, place, id) fused by reciprocal ranks: the sum of weight / (k + place)."""
    return lists.groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("place"))), 9).alias("score"))


def resolve_names(queries: DataFrame, cards: DataFrame, k: int = 5) -> DataFrame:
    """queries(qid, text) to cards(cid, name) by words: exact, as a prefix of three letters or more, or within one edit or swap.

    A query word counts with its idf (that of the nearest vocabulary word) and the
    best similarity that any word of the card has to it: 1 exact, 0.9 as a
    prefix, 0.75 by an edit; the score is the weighted mean over the query's
    words.  Only the vocabulary is compared with query words, blocked by shared
    deletions, and distances are computed for those pairs alone.  Cards of the
    same words, and queries of the same, are scored once.
    """
    n = cards.agg(F.count("*").alias("n"))  # one row
    vocabulary = cards.select(F.explode(words("name")).alias("word")).groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    said = lambda rows, i, c: rows.groupBy(i).agg(F.array_sort(F.flatten(F.collect_list(words(c)))).alias("words"))
    same = W.partitionBy("words")
    # of cards of the same words no more than the k first can be among the best, and the first stands for them
    named = said(cards, "cid", "name").withColumn("words", F.array_distinct("words"))
    members = named.withColumn("nth", F.row_number().over(same.orderBy("cid"))).where(F.col("nth") <= k).withColumn("first", F.min("cid").over(same)).select("first", "cid", "words")
    held = members.where(F.col("first") == F.col("cid")).select("cid", F.explode("words").alias("word"))
    typed = said(queries, "qid", "text").withColumn("asked", F.min("qid").over(same)).select("qid", "asked", "words")
    asked = typed.where(F.col("qid") == F.col("asked")).select("qid", F.explode("words").alias("q"))
    distinct = asked.select("q").distinct()
    exact = distinct.join(vocabulary.withColumn("q", F.col("word")), "q").select("q", "word", "idf", F.lit(1.0).alias("s"))
    starts = vocabulary.withColumn("q", F.explode(F.expr("CASE WHEN length(word) > 3 THEN transform(sequence(3, length(word) - 1), i -> substring(word, 1, i)) ELSE array() END")))
    prefix = distinct.join(starts, "q").select("q", "word", "idf", F.lit(0.9).alias("s"))
    near = distinct.where(F.length("q") >= 4).withColumn("d", F.explode(deletions("q"))).join(vocabulary.where(F.length("word") >= 4).withColumn("d", F.explode(deletions("word"))), "d")
    near = near.select("q", "word", "idf").distinct().where(osa_distance("q", "word") == 1).select("q", "word", "idf", F.lit(0.75).alias("s"))
    pairs = exact.unionByName(prefix).unionByName(near)
    weight = pairs.groupBy("q").agg(F.max_by("idf", F.struct("s", "idf")).alias("w"))
    total = asked.join(weight, "q").groupBy("qid").agg(F.sum("w").alias("total"))
    by_word = asked.join(pairs, "q").join(held, "word").groupBy("qid", "cid", "q").agg(F.max("s").alias("s")).join(weight, "q")
    scored = by_word.groupBy("qid", "cid").agg(F.sum(F.col("w") * F.col("s")).alias("sum")).join(total, "qid").select("qid", "cid", F.round(F.col("sum") / F.col("total"), 6).alias("score"))
    firsts = best(scored, "qid", "score", "cid", k).select(F.col("qid").alias("asked"), F.col("cid").alias("first"), "score")
    found = best(firsts.join(members.select("first", "cid"), "first"), "asked", "score", "cid", k).select("asked", "cid", "score", "place")
    return typed.select("qid", "asked").join(found, "asked").select("qid", "cid", "score", "place")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int = 5, penalty: float = 0.12, wide: int = 25, block: int = 4096) -> DataFrame:
    """The k vectors(vec_id, embedding, bits) for each query: the ``wide`` largest dot products, ranked again less the share of differing bits.

    Vectors lie in blocks of rows; every query meets every block, one matrix
    product each, and a block passes on its ``wide`` best per query, so the
    exact result costs blocks times queries rows of shuffle.
    """
    blocked = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "bits", F.monotonically_increasing_id().alias("i")).withColumn("block", F.floor(F.col("i") / block))
    blocks = blocked.select(F.col("block").alias("met")).distinct()
    asked = queries.select(F.col("qid").alias("asked_id"), F.col("embedding").cast("array<double>").alias("asked"), F.col("bits").alias("asked_bits")).crossJoin(blocks)  # a query for each block

    def scored(own: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if own.empty or there.empty:
            return pd.DataFrame({c: [] for c in ("qid", "vec_id", "score", "bits", "asked_bits")})
        there = there.sort_values("vec_id")
        products = np.round(np.stack(own["asked"].to_list()) @ np.stack(there["embedding"].to_list()).T, 6)
        ids, bits, out = there["vec_id"].to_numpy(), there["bits"].to_numpy(), []
        for row, (qid, mine) in zip(products, own[["asked_id", "asked_bits"]].itertuples(index=False)):
            top = np.argsort(-row, kind="stable")[:wide]
            out.append(pd.DataFrame({"qid": qid, "vec_id": ids[top], "score": row[top], "bits": bits[top], "asked_bits": mine}))
        return pd.concat(out)

    found = asked.groupBy("met").cogroup(blocked.groupBy("block")).applyInPandas(scored, "qid bigint, vec_id bigint, score double, bits bigint, asked_bits bigint")
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("asked_bits")))
    shortlist = best(found, "qid", "score", "vec_id", wide).withColumn("ham", apart).drop("place", "bits", "asked_bits")
    blended = F.col("score") / F.coalesce(F.nullif(F.max("score").over(W.partitionBy("qid")), F.lit(0.0)), F.lit(1.0)) - penalty * F.col("ham") / 64
    return best(shortlist.withColumn("blended", F.round(blended, 6)), "qid", "blended", "vec_id", k)


def parse_search(text: str, phrases: dict[str, tuple[str, object]]) -> tuple[list[tuple[str, object]], str]:
    """(filters, rest): known phrases of a search string, the longest first, and comparisons like cost>=3; the rest is the name."""
    import re

    filters: list[tuple[str, object]] = []
    for m in re.finditer(r"\b([a-z_]+)\s*(>=|<=|=|>|<)\s*(\d+(?:\.\d+)?)", text.lower()):
        filters.append((f"{m[1]}{m[2]}", float(m[3])))
    rest = re.sub(r"\b[a-z_]+\s*(?:>=|<=|=|>|<)\s*\d+(?:\.\d+)?", " ", text.lower())
    for phrase in sorted(phrases, key=len, reverse=True):
        rest, n = re.subn(rf"\b{re.escape(phrase)}\b", " ", rest)
        if n:
            filters.append(phrases[phrase])
    return filters, " ".join(rest.split())


def filtered_cards(cards: DataFrame, filters: list[tuple[str, object]], name: str = "", match_all: bool = True) -> DataFrame:
    """Cards that meet all filters (or any): equality by column, or a comparison named column>=; name must stand in the card's text."""
    import re

    conditions = []
    for key, value in filters:
        column, op = re.fullmatch(r"(\w+?)(>=|<=|=|>|<)?", key).groups()
        c = F.col(column)
        conditions.append({None: c == value, "=": c == value, ">=": c >= value, "<=": c <= value, ">": c > value, "<": c < value}[op])
    kept = cards
    if conditions:
        met = F.array(*(F.coalesce(c, F.lit(False)) for c in conditions))
        kept = kept.where(F.forall(met, lambda x: x) if match_all else F.exists(met, lambda x: x))
    return kept.where(F.instr(F.lower("name"), name) > 0) if name else kept
