"""Chain-linked market indexes over daily prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.operators.scalar import newest

#: Scopes: name, the columns of the key, and the rows that count.
SCOPES = (
    ("all", (), "kind = 'card'"),
    ("set", ("set_id",), "kind = 'card' AND set_id IS NOT NULL"),
    ("rarity", ("rarity",), "kind = 'card' AND rarity IS NOT NULL"),
    ("setrarity", ("set_id", "rarity"), "kind = 'card' AND set_id IS NOT NULL AND rarity IS NOT NULL"),
    ("chase", (), "kind = 'card' AND rarity IN ('Enchanted', 'Epic', 'Iconic')"),
    ("ink", ("ink",), "kind = 'card' AND ink IS NOT NULL"),
    ("sealed", (), "kind = 'sealed'"),
    ("sealedtype", ("product_type",), "kind = 'sealed' AND product_type IS NOT NULL"),
)
#: Returns are averaged as whole parts of so many, so that sums don't depend on the order of rows.
UNIT = 1_000_000_000


def daily_returns(prices: DataFrame, dims: DataFrame, max_gap: int = 7, clamp: float = 2.0) -> DataFrame:
    """Clamped returns of every series from one priced day to the next, at most max_gap days apart, with the product's scopes.

    The price is market, or low where that is missing; only positive ones from
    the product's floor_date on count.
    """
    series = W.partitionBy("product_id", "printing").orderBy("price_date")
    priced = prices.withColumn("v", F.coalesce("market", "low")).where("v > 0")
    kept = priced.join(dims.where("NOT (kind = 'sealed' AND product_type <=> 'Promo Single')"), "product_id").where("price_date >= floor_date")
    stepped = kept.withColumns({"prev": F.lag("v").over(series), "gap": F.datediff("price_date", F.lag("price_date").over(series))})
    ret = F.least(F.greatest(F.col("v") / F.col("prev"), F.lit(1 / clamp)), F.lit(clamp))
    return stepped.where(f"prev > 0 AND gap <= {max_gap}").withColumn("ret", F.round(ret * UNIT).cast("bigint"))


def market_index(prices: DataFrame, dims: DataFrame, scopes: tuple = SCOPES, min_abs: int = 5, min_coverage: float = 0.6) -> DataFrame:
    """(scope, scope_key, price_date, value, n, universe): equal-weight indexes that begin at 100 on their first kept day.

    ``universe`` is the largest n of the last 31 rows; days with under 5 returns
    or under 0.6 of the universe are dropped before returns are chained.  All
    scopes come out of one scan: a row is dealt to the scopes it belongs to, and
    partial aggregation leaves one row per scope, key and day.
    """
    labels = [
        F.when(F.expr(where), F.struct(F.lit(name).alias("scope"), (F.concat_ws("|", *key) if key else F.lit("")).alias("scope_key"))) for name, key, where in scopes
    ]
    rets = daily_returns(prices, dims).select("price_date", "ret", F.explode(F.array_compact(F.array(*labels))).alias("s"))
    daily = rets.groupBy("s.scope", "s.scope_key", "price_date").agg(F.sum("ret").alias("total"), F.count("*").alias("n"))
    key = W.partitionBy("scope", "scope_key").orderBy("price_date")
    kept = daily.withColumn("universe", F.max("n").over(key.rowsBetween(-30, 0))).where(f"n >= {min_abs} AND n >= {min_coverage} * universe")
    logs = kept.withColumn("cum", F.sum(F.log(F.col("total") / F.col("n") / F.lit(float(UNIT)))).over(key.rowsBetween(W.unboundedPreceding, 0)))
    based = F.exp(F.col("cum") - F.first("cum").over(key.rowsBetween(W.unboundedPreceding, 0)))
    return logs.select("scope", "scope_key", "price_date", F.round(based * 100, 4).alias("value"), "n", "universe")


def index_latest(index: DataFrame, windows: tuple[int, ...] = (1, 7, 30, 90, 180, 365)) -> DataFrame:
    """The newest value of each index and its moves, in one aggregate."""
    last = index.withColumn("last", F.max("price_date").over(W.partitionBy("scope", "scope_key")))
    found = last.groupBy("scope", "scope_key").agg(
        F.max("price_date").alias("price_date"), F.max_by("value", "price_date").alias("value"), F.max_by("n", "price_date").alias("n"), F.max_by("universe", "price_date").alias("universe"),
        *(newest("value", "price_date", f"price_date <= last - {n}").alias(f"v_{n}d") for n in windows),
    )
    moves = [F.expr(f"CASE WHEN v_{n}d > 0 THEN round((value - v_{n}d) / v_{n}d * 100, 2) END").alias(f"pct_{n}d") for n in windows]
    return found.select("scope", "scope_key", "price_date", "value", "n", "universe", *moves)


def pulse(index: DataFrame, date: str, days: int = 7, min_components: int = 100) -> DataFrame:
    """Moves over ``days`` and 30 days of the indexes that are current on a date; sets only with enough components.

    Nothing at all unless the index of all cards has that date.
    """
    day = F.lit(date).cast("date")
    found = index.groupBy("scope", "scope_key").agg(
        F.max(F.when(F.col("price_date") == day, F.col("value"))).alias("now"),
        F.max(F.when(F.col("price_date") == day, F.col("n"))).alias("n"),
        *(F.max_by("value", F.when(F.col("price_date") <= F.date_sub(day, d), F.col("price_date"))).alias(f"v_{d}") for d in (days, 30)),
    )
    current = index.where((F.col("scope") == "all") & (F.col("price_date") == day)).select("price_date").limit(1)
    kept = found.where(F.col("now").isNotNull() & F.col("scope").isin("all", "chase", "sealed", "set", "rarity") & ((F.col("scope") != "set") | (F.col("n") >= min_components)))
    return kept.crossJoin(F.broadcast(current)).select(  # one row or none
        "scope", "scope_key", *(F.expr(f"CASE WHEN v_{d} <> 0 THEN round((now / v_{d} - 1) * 100, 4) END").alias(a) for d, a in ((days, "week"), (30, "month")))
    )


def rebase(index: DataFrame) -> DataFrame:
    """Several indexes as percent changes since the first day that all of them have reached."""
    start = index.groupBy("scope", "scope_key").agg(F.min("price_date").alias("first")).agg(F.max("first").alias("common"))  # one row
    kept = index.crossJoin(F.broadcast(start)).where("price_date >= common")
    first = F.first("value").over(W.partitionBy("scope", "scope_key").orderBy("price_date"))
    return kept.select("scope", "scope_key", "price_date", F.round((F.col("value") / first - 1) * 100, 4).alias("change"))
