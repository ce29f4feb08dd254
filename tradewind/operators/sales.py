"""Irregular sales: rollups, banded references, arrivals, outliers and lookups.

Tables of sales have item_id, card_id, grader, grade, printing, sale_price (in
whole cents), sold_date (event) and scraped_date (arrival).  Ties of dates go to
the higher price, then to the larger item_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.operators.scalar import middle, percent

GROUP = ("card_id", "grader", "grade", "pkey")
BANDS = (1, 7, 30, 90, 180, 365, 1095)
#: Printings that count as foil and as non-foil, in lower case.
FOIL = ("foil", "cold foil", "holofoil", "holo")
NON_FOIL = ("normal", "non-foil", "nonfoil")


def sale_bucket(printing: str = "printing", split: str = "split_printing", foil_split: str = "foil_split") -> Column:
    """The market a sale belongs to: its own printing, Foil or Non-Foil, or the empty string for a card of one market."""
    p = F.col(printing)
    foil = F.when(F.lower(F.coalesce(p, F.lit(""))).isin(*FOIL), "Foil").otherwise("Non-Foil")
    return F.when(F.col(split), F.coalesce(p, F.lit("Unknown"))).when(F.col(foil_split), foil).otherwise("")


def slot_bucket(printing: str) -> Column:
    """Foil, Non-Foil, or the lower-case printing; null where it is missing or unknown."""
    s = F.lower(F.trim(F.coalesce(F.col(printing), F.lit(""))))
    return F.when(s.isin("", "unknown"), None).when(s.isin(*FOIL), "Foil").when(s.isin(*NON_FOIL), "Non-Foil").otherwise(s)


def graded_rollup(sales: DataFrame, cards: DataFrame, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """Per group its count, last sale, mean of the last five, and the last sale's change from the newest one n to 2n days before it.

    The group's last day and the rank come from windows over the group; the
    aggregate shares their partitioning, so all bands cost one shuffle.
    """
    rows = sales.where("card_id IS NOT NULL AND grade IS NOT NULL AND sale_price IS NOT NULL AND NOT excluded").join(cards.select(F.col("product_id").alias("card_id"), "split_printing", "foil_split"), "card_id")
    rows = rows.withColumn("pkey", sale_bucket())
    group = W.partitionBy(*GROUP)
    order = group.orderBy(F.desc_nulls_last("sold_date"), F.desc("scraped_date"), F.desc("sale_price"), F.desc("item_id"))
    ranked = rows.withColumns({"rn": F.row_number().over(order), "last": F.max("sold_date").over(group)})
    at = "struct(sold_date, scraped_date, sale_price)"
    found = ranked.groupBy(*GROUP).agg(
        F.count("*").alias("sale_count"),
        F.max("last").alias("last_sold_date"),
        F.expr("max(sale_price) FILTER (WHERE rn = 1)").alias("last_sold_price"),
        F.expr("sum(sale_price) FILTER (WHERE rn <= 5)").alias("sum_5"),
        F.expr("count(*) FILTER (WHERE rn <= 5)").alias("last_5_count"),
        F.expr(f"min_by(sale_price, {at})").alias("first_price"),
        *(F.expr(f"max_by(sale_price, {at}) FILTER (WHERE sold_date BETWEEN last - {2 * n} AND last - {n})").alias(f"r{n}") for n in bands),
    )
    return found.select(
        *GROUP, "sale_count", "last_sold_date", "last_sold_price", (F.col("sum_5") / F.col("last_5_count")).alias("avg_last_5"), "last_5_count",
        *(percent("last_sold_price", f"r{n}", digits=1).alias(f"pct_{n}d") for n in bands),
        percent("last_sold_price", "first_price", "first_price <> last_sold_price", digits=1).alias("pct_rel"),
    )


def arrival_moves(sales: DataFrame, cards: DataFrame, cutoff: str, end: str, floor: str, min_before: int = 3) -> DataFrame:
    """Groups with a sale that arrived after cutoff and by end and was sold on or after floor: mean of their last five sales now and before.

    What arrived after end counts next time; what arrived in time but was sold
    before floor counts neither way.
    """
    flags = cards.select(F.col("product_id").alias("card_id"), "split_printing", "foil_split")
    rows = sales.where(F.col("sale_price").isNotNull() & F.col("sold_date").isNotNull() & (F.coalesce("scraped_date", F.lit(cutoff).cast("date")) <= F.lit(end).cast("date")))
    rows = rows.join(flags, "card_id").withColumns({"pkey": sale_bucket(), "recent": F.coalesce(F.col("scraped_date") > F.lit(cutoff).cast("date"), F.lit(False))}).where("pkey <> 'Unknown'")
    rows = rows.withColumn("fresh", F.col("recent") & (F.col("sold_date") >= F.lit(floor).cast("date"))).where("fresh OR NOT recent")
    key = ("card_id", "pkey")
    order = (F.desc("sold_date"), F.desc("scraped_date"), F.desc("sale_price"), F.desc("fresh"), F.desc("item_id"))
    ranked = rows.withColumns({"rn": F.row_number().over(W.partitionBy(*key).orderBy(*order)), "rn_side": F.row_number().over(W.partitionBy(*key, "fresh").orderBy(*order))})
    found = ranked.groupBy(*key).agg(
        F.count_if("fresh").alias("sold"),
        *(F.expr(f"{f} FILTER (WHERE {w})").alias(a) for a, f, w in (("sum_now", "sum(sale_price)", "rn <= 5"), ("n_now", "count(*)", "rn <= 5"), ("sum_was", "sum(sale_price)", "NOT fresh AND rn_side <= 5"), ("n_was", "count(*)", "NOT fresh AND rn_side <= 5"))),
    )
    moved = found.where(f"sold > 0 AND n_was >= {min_before}").select(*key, "sold", (F.col("sum_now") / F.col("n_now")).alias("now"), (F.col("sum_was") / F.col("n_was")).alias("was"))
    return moved.where("was > 0 AND now <> was").withColumn("pct", F.round((F.col("now") / F.col("was") - 1) * 100, 6))


def outliers(sales: DataFrame, factor: int = 6, days: int = 120, most: int = 12, least: int = 5) -> DataFrame:
    """Sales above factor times, or under a factor-th of, the median of their nearest neighbours in time.

    Neighbours are up to ``most`` other sales of the group within ``days`` days,
    nearest first (of equal distance in time those nearest in the group's order,
    earlier ones first).  They lie among the ``most`` rows before and after a
    sale, so a window frame holds them and groups of any size work.  Days are
    numbered year * 372 + month * 31 + day.
    """
    rows = sales.where("sale_price IS NOT NULL AND sold_date IS NOT NULL").withColumns(
        {"bucket": slot_bucket("printing"), "grader": F.lower(F.coalesce("grader", F.lit(""))), "day": F.expr("year(sold_date) * 372 + month(sold_date) * 31 + day(sold_date)")}
    )
    order = W.partitionBy("card_id", "bucket", "grader", "grade").orderBy("day", "sale_price", "item_id")
    near = F.struct("day", "sale_price")
    seen = rows.withColumns({"b": F.collect_list(near).over(order.rowsBetween(-most, -1)), "a": F.collect_list(near).over(order.rowsBetween(1, most))})
    side = lambda arr, k: f"transform({arr}, (x, i) -> struct(abs(x.day - day) AS gap, i AS place, {k} AS side, x.sale_price AS price))"
    both = f"slice(array_sort(filter(concat({side('reverse(b)', 0)}, {side('a', 1)}), x -> x.gap <= {days})), 1, {most})"
    prices = seen.withColumn("m", F.expr(f"array_sort(transform({both}, x -> x.price))")).where(F.size("m") >= least)
    found = prices.withColumn("median", F.expr(middle("m"))).where("median > 0")
    return found.where(f"sale_price > {factor} * median OR {factor} * sale_price < median").select("item_id", "card_id", "grade", "sale_price", "median", (F.col("sale_price") / F.col("median")).alias("ratio"))


def price_ladder(rollup: DataFrame, slots: DataFrame) -> DataFrame:
    """The price of each slot(slot_id, card_id, grader, grade, printing): its own printing's, or the next rung's.

    A group without a printing prices all five printings; one with a printing
    prices those that mean the same, and wins.  Rungs are the wanted printing,
    Normal, Holofoil and Cold Foil.  On a tier that is split (a group with a
    named printing exists) only rungs of the same bucket count.
    """
    all_five = F.array(*map(F.lit, ("Normal", "Holofoil", "Cold Foil", "Foil", "Non-Foil")))
    same = F.when(F.col("pkey") == "Foil", F.array(*map(F.lit, ("Foil", "Holofoil", "Cold Foil")))).when(F.col("pkey") == "Non-Foil", F.array(F.lit("Non-Foil"), F.lit("Normal"))).otherwise(F.array("pkey"))
    named = ~F.col("pkey").isin("", "Unknown")
    tier = ("card_id", "grader", "grade")
    priced = rollup.withColumns({"named": named, "value": F.coalesce("avg_last_5", F.col("last_sold_price").cast("double"))}).where("value IS NOT NULL")
    rungs = priced.withColumn("rung", F.explode(F.when(named, same).otherwise(all_five)))
    best = rungs.groupBy(*tier, "rung").agg(F.max(F.struct("named", "last_sold_date", "pkey", "value")).alias("best"))
    split = priced.where("named").select(*tier).distinct().withColumn("split", F.lit(True))
    wanted = slots.withColumn("want", F.coalesce("printing", F.lit("Normal")))
    steps = F.array("want", F.lit("Normal"), F.lit("Holofoil"), F.lit("Cold Foil"))
    tried = wanted.join(split, list(tier), "left").select("slot_id", *tier, "want", F.coalesce("split", F.lit(False)).alias("split"), F.posexplode(steps).alias("step", "rung"))
    found = tried.join(best, [*tier, "rung"]).withColumns({"mine": F.coalesce(slot_bucket("want"), F.lit("Non-Foil")), "at": F.coalesce(slot_bucket("rung"), F.lit("Non-Foil")), "pkey": F.col("best.pkey")})
    found = found.withColumn("has", slot_bucket("pkey")).where("NOT split OR (at = mine AND (has IS NULL OR has = mine))")
    first = found.groupBy("slot_id").agg(F.min_by(F.struct("rung", "best.value", "split", "has", "mine"), "step").alias("f"))
    exact = F.expr("f.rung IS NOT NULL AND (NOT f.split OR f.has <=> f.mine)")
    return slots.select("slot_id").join(first, "slot_id", "left").select("slot_id", "f.rung", "f.value", F.coalesce(exact, F.lit(False)).alias("exact"))
