"""Accounts that may be one person: classes of equal names, similar names across platforms, and collisions on one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.functions.similar import similar_strings

#: Certainty of suggestions: the same display name, the same letters and digits, and accounts of one platform with and without common circles.
EXACT, NORMALISED, SAME_CIRCLE, APART = 1.0, 0.95, 0.9, 0.5
#: Classes of up to FEW accounts meet pair by pair, larger ones by bits in tiles of about TILE by TILE accounts.
FEW, TILE = 64, 8192


def name_key(name: str) -> Column:
    """A name's letters and digits in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def sorted_words(name: str) -> Column:
    """A name's words in lower case, in order of the alphabet, joined."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))), "")


def alias_suggestions(players: DataFrame) -> DataFrame:
    """Each account of players(player_id, name, platform) whose name another platform has too.

    (player_id, class_id, platform, evidence, confidence, n_other): class_id is
    the smallest account of the same letters and digits, so pairs are accounts
    of one class; evidence is exact where the display name itself is there, and
    n_other counts the accounts of other platforms.  No pairs are written, so a
    name that very many accounts share is as many rows.  Names without letters
    and digits match nothing.
    """
    keyed = players.withColumn("k", name_key("name")).where("k <> ''")
    classes = keyed.groupBy("k").agg(F.min("player_id").alias("class_id"), F.count("*").alias("n"), F.min("platform").alias("p1"), F.max("platform").alias("p2")).where("p1 <> p2")
    per = keyed.groupBy("k", "platform").agg(F.count("*").alias("own"))
    shown = keyed.groupBy(F.col("k"), "name").agg(F.min("platform").alias("s1"), F.max("platform").alias("s2"))
    found = keyed.join(classes, "k").join(per, ["k", "platform"]).join(shown, ["k", "name"])
    exact = F.col("s1") != F.col("s2")
    return found.select("player_id", "class_id", "platform", F.when(exact, "exact").otherwise("normalized").alias("evidence"), F.when(exact, EXACT).otherwise(NORMALISED).alias("confidence"), (F.col("n") - F.col("own")).alias("n_other"))


def _met_in_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """(kind, id, player_id, n): each account of the tile's first side with the number of the second's that it met, itself included if it's there."""
    first, second = rows[rows["side"] != 2], rows[rows["side"] != 1]
    events = pd.Index(second["event_id"].unique())
    at = events.get_indexer(first["event_id"])
    known = at >= 0
    first, at = first[known], at[known]
    bit, members = pd.factorize(second["player_id"])
    there = np.zeros((len(events), len(members) // 8 + 1), np.uint8)
    np.bitwise_or.at(there, (events.get_indexer(second["event_id"]), bit // 8), (1 << (bit % 8)).astype(np.uint8))
    ids, owner = np.unique(first["player_id"].to_numpy(), return_inverse=True)
    bounds = np.cumsum(np.bincount(owner, minlength=len(ids)))
    n = [int(np.bitwise_count(np.bitwise_or.reduce(there[own])).sum()) for own in np.split(at[np.argsort(owner, kind="stable")], bounds[:-1])] if len(ids) else []
    return pd.DataFrame({"kind": rows["kind"].iloc[0], "id": rows["id"].iloc[0], "player_id": ids, "n": np.array(n, "int64")})


def met_members(members: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, id, player_id, n): for accounts of members(kind, id, player_id) how many others of the class (kind, id) they met in an event of entries(event_id, player_id)."""
    sizes = members.groupBy("kind", "id").agg(F.count("*").alias("size")).where("size > 1")
    there = members.join(sizes, ["kind", "id"]).join(entries.where("event_id IS NOT NULL").select("event_id", "player_id").distinct(), "player_id")
    few = there.where(F.col("size") <= FEW).select("kind", "id", "player_id", "event_id")
    met = few.join(few.withColumnRenamed("player_id", "other"), ["kind", "id", "event_id"]).where("player_id <> other").groupBy("kind", "id", "player_id").agg(F.countDistinct("other").alias("n"))
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    many = there.where(F.col("size") > FEW).withColumn("own", F.pmod(F.xxhash64("player_id"), tiles).cast("int")).withColumn("facing", F.explode(F.sequence(F.lit(0), tiles - 1)))
    tile = lambda i, j, side: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"))
    dealt = F.when(F.col("own") == F.col("facing"), F.array(tile("own", "own", 0))).otherwise(F.array(tile("own", "facing", 1), tile("facing", "own", 2)))
    schema = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in ("kind", "id", "player_id")) + ", n bigint"
    found = many.select("kind", "id", "player_id", "event_id", F.inline(dealt)).groupBy("kind", "id", "i", "j").applyInPandas(_met_in_tile, schema)
    # every account with an event meets itself in one tile
    return met.unionByName(found.groupBy("kind", "id", "player_id").agg((F.sum("n") - 1).alias("n")))


def linked_accounts(players: DataFrame, entries: DataFrame) -> DataFrame:
    """Each account of players(player_id, name, platform) that another, of whatever platform, shares its name with.

    Accounts link if their names have the same letters and digits (one class_id,
    the smallest account of the class) or the same words in any order (one
    words_id), so that the two classes with their members hold every pair.
    n_links counts the accounts linked, n_exact those of them with the very
    display name, n_possible those that it never met in an event of
    entries(event_id, player_id): who met is two people.  n_other, evidence and
    confidence are those of alias_suggestions(): accounts of other platforms with
    the same letters and digits; evidence is null where there are none.  Names
    without letters and digits match nothing.
    """
    words = F.array_join(F.array_sort(F.regexp_extract_all(F.lower(F.coalesce("name", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))), " ")
    keyed = players.select("player_id", "name", "platform", name_key("name").alias("k"), words.alias("w")).where("k <> ''")
    counted = lambda by, *more: keyed.groupBy(*by).agg(*more)
    n = lambda name: F.count("*").alias(name)
    found = (
        keyed.join(counted(["k"], F.min("player_id").alias("class_id"), n("n_k"), F.count("platform").alias("known")), "k")
        .join(counted(["w"], F.min("player_id").alias("words_id"), n("n_w")), "w")
        .join(counted(["k", "w"], F.min("player_id").alias("both_id"), n("n_kw")), ["k", "w"])
        .join(counted(["k", "platform"], n("own")), ["k", "platform"], "left")
        .join(counted(["k", "name"], n("n_name"), F.min("platform").alias("s1"), F.max("platform").alias("s2")), ["k", "name"])
        .withColumn("n_links", F.col("n_k") + F.col("n_w") - F.col("n_kw") - 1)
        .where("n_links > 0")
    )
    # met in either class: where neither holds the other, those of both are counted twice
    part = lambda kind, sign, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id"), F.lit(sign).alias("sign"))
    by_key, by_words, by_both = part(0, 1, "class_id"), part(1, 1, "words_id"), part(2, -1, "both_id")
    classes = F.when(F.col("n_w") == F.col("n_kw"), F.array(by_key)).when(F.col("n_k") == F.col("n_kw"), F.array(by_words)).otherwise(F.array(by_key, by_words, by_both))
    members = found.select("player_id", F.inline(classes))
    met = met_members(members.drop("sign"), entries)
    n_met = members.join(met, ["kind", "id", "player_id"]).groupBy("player_id").agg(F.sum(F.col("sign") * F.col("n")).alias("n_met"))
    exact, other = F.col("platform").isNotNull() & (F.col("s1") != F.col("s2")), F.coalesce(F.col("known") - F.col("own"), F.lit(0))
    return found.join(n_met, "player_id", "left").select(
        "player_id", "class_id", "words_id", "platform",
        F.when(exact, "exact").when(other > 0, "normalized").alias("evidence"), F.when(exact, EXACT).when(other > 0, NORMALISED).alias("confidence"),
        other.alias("n_other"), "n_links", (F.col("n_name") - 1).alias("n_exact"), (F.col("n_links") - F.coalesce("n_met", F.lit(0))).alias("n_possible"),
    )


def similar_names(players: DataFrame, of: str, among: str, least: float = 0.85, top: int = 3) -> DataFrame:
    """(player_id, other_id, confidence): for accounts of a platform the most similar names of another, ``top`` accounts at most.

    The ratio is that of the names' letters and digits or of their sorted words,
    the larger; accounts whose name the other platform has as it is are left
    out.  Names are compared once however many accounts share them; of equal
    ratios the smaller other_id comes first.
    """
    keyed = players.select("player_id", "platform", name_key("name").alias("k"), sorted_words("name").alias("w")).where("k <> ''")
    theirs = keyed.where(F.col("platform") == among)
    ours = keyed.where(F.col("platform") == of).join(theirs.select("k").distinct(), "k", "left_anti")
    first = W.partitionBy("k", "w").orderBy("player_id")
    # more than ``top`` accounts of one name can't all be among the best
    offered = theirs.withColumn("place", F.row_number().over(first)).where(F.col("place") <= top).select("k", "w", F.col("player_id").alias("other_id"))
    names = lambda rows, c: rows.select(F.col(c).alias("s"))
    turned = theirs.where("w <> k")
    plain = similar_strings(names(ours, "k"), names(theirs, "k"), least).select(F.col("a").alias("k"), F.col("b").alias("other"), "ratio")
    sorted_ = similar_strings(names(ours, "w"), names(turned, "w"), least).select(F.col("a").alias("w"), F.col("b").alias("other"), "ratio")
    asked = ours.select("k", "w").distinct()
    by_key = asked.join(plain, "k").join(offered.withColumnsRenamed({"k": "other", "w": "_w"}), "other").select("k", "w", "other_id", "ratio")
    by_words = asked.join(sorted_, "w").join(offered.where("w <> k").withColumnsRenamed({"w": "other", "k": "_k"}), "other").select("k", "w", "other_id", "ratio")
    scored = by_key.unionByName(by_words).groupBy("k", "w", "other_id").agg(F.max("ratio").alias("ratio"))
    best = scored.withColumn("place", F.row_number().over(W.partitionBy("k", "w").orderBy(F.desc("ratio"), "other_id"))).where(F.col("place") <= top)
    return ours.join(best, ["k", "w"]).select("player_id", "other_id", F.round("ratio", 3).alias("confidence"))


def collisions(players: DataFrame, matches: DataFrame) -> DataFrame:
    """(player_id, primary_id, confidence, shared_stores, shared_opponents): accounts of one platform and name, each beside its busiest.

    matches(store, player1_id, player2_id).  Accounts that have played the
    busiest are other people and left out; a common store or two common
    opponents make one person likely.  Of equally busy accounts the smallest
    counts as the busiest.
    """
    sides = matches.select("store", F.col("player1_id").alias("player_id"), F.col("player2_id").alias("opponent")).union(matches.select("store", "player2_id", "player1_id")).where("player_id IS NOT NULL")
    busy = sides.groupBy("player_id").agg(F.count("*").alias("n"))
    keyed = players.select("player_id", F.concat("platform", F.lit("|"), name_key("name")).alias("k")).where(name_key("name") != "").join(busy, "player_id", "left")
    order = F.struct(-F.coalesce("n", F.lit(0)), "player_id")
    classes = keyed.groupBy("k").agg(F.min_by("player_id", order).alias("primary_id"), F.count("*").alias("members")).where("members > 1")
    pairs = keyed.join(classes, "k").where("player_id <> primary_id").select("player_id", "primary_id")
    met = pairs.join(sides.select("player_id", F.col("opponent").alias("primary_id")).distinct(), ["player_id", "primary_id"], "left_semi")
    left = pairs.join(met, ["player_id", "primary_id"], "left_anti")

    def shared(what: str, name: str) -> DataFrame:
        had = sides.where(F.col(what).isNotNull()).select("player_id", F.col(what).alias("x")).distinct()
        both = left.join(had, "player_id").join(had.withColumnRenamed("player_id", "primary_id"), ["primary_id", "x"])
        return both.groupBy("player_id").agg(F.count("*").alias(name))

    found = left.join(shared("store", "shared_stores"), "player_id", "left").join(shared("opponent", "shared_opponents"), "player_id", "left").na.fill(0, ["shared_stores", "shared_opponents"])
    likely = (F.col("shared_stores") > 0) | (F.col("shared_opponents") >= 2)
    return found.select("player_id", "primary_id", F.when(likely, SAME_CIRCLE).otherwise(APART).alias("confidence"), "shared_stores", "shared_opponents")
