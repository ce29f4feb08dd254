"""JSON documents: snapshots of decks read as variants and compared, and results written as ordered documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A card of a snapshot.
CARD = "array<struct<card_id: string, printing: string, quantity: int>>"


def snapshot(cards: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cards): the rows(card_id, printing, quantity) of each key as a JSON array, in order of card and printing."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("card_id", "printing", "quantity"))), lambda c: F.struct(c["card_id"].alias("card_id"), c["printing"].alias("printing"), c["quantity"].alias("quantity")))
    return cards.groupBy(*keys).agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("cards"))


def read_snapshots(versions: DataFrame) -> DataFrame:
    """versions(deck_id, version, cards) with cards as a variant, its shape, and how many cards it holds; null where the text isn't JSON or no array."""
    parsed = versions.withColumn("cards", F.try_parse_json("cards"))
    items = F.try_variant_get("cards", "$", CARD)
    total = F.aggregate(items, F.lit(0), lambda s, c: s + F.coalesce(c["quantity"], F.lit(0)))
    return parsed.withColumns({"shape": F.schema_of_variant("cards"), "n_cards": total})


def snapshot_changes(versions: DataFrame) -> DataFrame:
    """(deck_id, version, card_id, printing, before, now): cards whose number differs from the last readable version's.

    Every card of a deck's first version is new; versions that can't be read are
    passed over.  Printings that a snapshot leaves out are Normal; several
    entries of a card are added up.
    """
    # read once, and a card lies with its deck from here on: versions follow each other and are compared where they are
    good = versions.select("deck_id", "version", F.try_variant_get(F.try_parse_json("cards"), "$", CARD).alias("items")).where("items IS NOT NULL")
    order = good.withColumn("next", F.lead("version").over(W.partitionBy("deck_id").orderBy("version")))
    each = order.select("deck_id", "version", "next", F.explode("items").alias("c"))
    # a card counts for its own version, and as what was before for the next one
    n = F.coalesce("c.quantity", F.lit(0))
    here, after = F.struct("version", F.lit(0).alias("was"), n.alias("n")), F.struct(F.col("next").alias("version"), n.alias("was"), F.lit(0).alias("n"))
    sides = F.when(F.col("next").isNull(), F.array(here)).otherwise(F.array(here, after))
    counted = each.select("deck_id", F.col("c.card_id").alias("card_id"), F.coalesce("c.printing", F.lit("Normal")).alias("printing"), F.explode(sides).alias("s"))
    both = counted.groupBy("deck_id", F.col("s.version").alias("version"), "card_id", "printing").agg(F.sum("s.was").alias("before"), F.sum("s.n").alias("now"))
    return both.where("before <> now")


def pages(rows: DataFrame, key: str, order: list[Column], columns: list[str], size: int = 100) -> DataFrame:
    """(key, page, document): the rows of each key as JSON documents of ``size`` rows in order, {"key", "page", "rows": [...]}.

    A page is one row, so no key's rows ever meet in one value.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    placed = rows.withColumn("_place", place).withColumn("page", F.floor((F.col("_place") - 1) / size).cast("int"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_place", *columns))), lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    found = placed.groupBy(key, "page").agg(listed.alias("rows"))
    return found.select(key, "page", F.to_json(F.struct(key, "page", "rows"), {"ignoreNullFields": "false"}).alias("document"))
