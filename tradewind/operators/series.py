"""Daily series: phantom spikes, and the value of a collection over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.operators.scalar import middle

SERIES = ("product_id", "printing")


def anomalous_days(prices: DataFrame, up: float, down: float, back: int = 30, least: int = 15) -> DataFrame:
    """Lows with the median of the ``back`` days before (null under ``least`` samples) and whether they leave the band around it."""
    day = F.datediff("price_date", F.lit("1970-01-01").cast("date"))
    rows = prices.where("low IS NOT NULL").select(*SERIES, "price_date", "low").withColumn("day", day)
    frame = W.partitionBy(*SERIES).orderBy("day").rangeBetween(-back, -1)
    seen = rows.withColumn("s", F.array_sort(F.collect_list("low").over(frame)))
    median = seen.withColumn("pre", F.expr(f"CASE WHEN size(s) >= {least} THEN {middle('s')} END")).drop("s")
    return median.withColumn("odd", F.expr(f"coalesce(pre > 0 AND (low / pre >= {up} OR low / pre <= {down}), false)"))


def smooth_spikes(prices: DataFrame, up: float = 2.5, down: float = 0.4, gap: int = 3, longest: int = 14, snap: tuple[float, float] = (0.7, 1.3), post: tuple[int, int, int] = (8, 21, 10)) -> DataFrame:
    """Every priced day with the smoothed low where it lies in a phantom stretch, else null.

    Anomalous days at most ``gap`` days apart form a stretch.  One of at most
    ``longest`` days is a phantom if the median of the days ``post[0]`` to
    ``post[1]`` after it (``post[2]`` samples at least) comes back to the median
    before it within ``snap``; all its days, those between anomalous ones too,
    get the mean of the two medians.  All steps are windows over the series, so
    the table is shuffled once.
    """
    series = W.partitionBy(*SERIES).orderBy("day")
    days = anomalous_days(prices, up, down)
    after = F.array_sort(F.collect_list("low").over(series.rangeBetween(post[0], post[1])))
    days = days.withColumn("p", after).withColumn("post", F.expr(f"CASE WHEN size(p) >= {post[2]} THEN {middle('p')} END")).drop("p")
    last_odd = F.last(F.when(F.col("odd"), F.col("day")), ignorenulls=True).over(series.rowsBetween(W.unboundedPreceding, -1))
    begins = days.withColumn("begins", F.col("odd") & F.coalesce(F.col("day") - last_odd > gap, F.lit(True)))
    stretch = begins.withColumn("stretch", F.sum(F.col("begins").cast("int")).over(series))
    of = W.partitionBy(*SERIES, "stretch")
    edges = stretch.withColumns(
        {
            "first": F.min(F.when(F.col("odd"), F.col("day"))).over(of),
            "last": F.max(F.when(F.col("odd"), F.col("day"))).over(of),
            "pre_median": F.min_by("pre", F.when(F.col("odd"), F.col("day"))).over(of),
            "post_median": F.max_by("post", F.when(F.col("odd"), F.col("day"))).over(of),
        }
    )
    inside = "stretch > 0 AND day BETWEEN first AND last"
    phantom = f"last - first + 1 <= {longest} AND pre_median > 0 AND post_median / pre_median BETWEEN {snap[0]} AND {snap[1]}"
    return edges.select(*SERIES, "price_date", "low", F.expr(f"CASE WHEN {inside} AND {phantom} THEN (pre_median + post_median) / 2 END").alias("smoothed"))


def sampled_dates(start: str, end: str, daily: int = 14) -> list[str]:
    """Dates of a long chart: weekly from start on, and every one of the last ``daily`` days."""
    from datetime import date, timedelta

    a, b = date.fromisoformat(start), date.fromisoformat(end)
    tail = [b - timedelta(days=k) for k in range(min(daily, (b - a).days + 1))]
    weeks = [a + timedelta(days=k) for k in range(0, (b - a).days + 1, 7)]
    return sorted({d.isoformat() for d in [*weeks, *tail] if d in tail or d < tail[-1]})


def collection_value(holdings: DataFrame, prices: DataFrame, since: str, until: str, basis: str = "low", dates: list[str] | None = None) -> DataFrame:
    """(price_date, value): what holdings(product_id, printing, quantity, acquired) were worth on each day.

    A holding counts from its acquired date on (null: from the start), at its
    newest price up to the day; prices before the range seed it, so an item
    without a price inside the range counts from the first day.  Each price row
    becomes the change that it makes on its day, so days and holdings are never
    multiplied: the changes are summed by day and added up over the days.
    """
    begin = F.greatest(F.lit(since).cast("date"), F.coalesce("acquired", F.lit(since).cast("date")))
    rows = prices.where(F.col(basis).isNotNull() & (F.col("price_date") <= F.lit(until).cast("date"))).select(*SERIES, "price_date", F.col(basis).alias("v"))
    held = holdings.groupBy(*SERIES, begin.alias("begin")).agg(F.sum("quantity").alias("quantity"))  # a product may be held several times
    joined = rows.join(held, [*SERIES])
    key = W.partitionBy(*SERIES, "begin").orderBy("price_date")
    # what stands before the holding's begin moves there; of those only the newest counts
    placed = joined.withColumns({"next": F.lead("price_date").over(key), "at": F.greatest("price_date", "begin")}).where("next IS NULL OR next > begin OR price_date > begin")
    changed = placed.withColumn("change", (F.col("v") - F.coalesce(F.lag("v").over(key), F.lit(0))) * F.col("quantity")).where(F.col("at") <= F.lit(until).cast("date"))
    by_day = changed.groupBy(F.col("at").alias("price_date")).agg(F.sum("change").alias("change"))
    spark = prices.sparkSession
    calendar = spark.sql(f"SELECT explode(sequence(DATE '{since}', DATE '{until}')) AS price_date")  # one row a day
    full = calendar.join(by_day, "price_date", "left").withColumn("value", F.sum(F.coalesce("change", F.lit(0))).over(W.orderBy("price_date")))
    full = full.select("price_date", F.col("value").cast("bigint").alias("value"))
    return full if dates is None else full.where(F.col("price_date").cast("string").isin(dates))


def snapshot_gate(prices: DataFrame, most: float = 0.95) -> DataFrame:
    """Per day of prices(product_id, printing, price_date, low, market): how many rows the last available day has too, how many of these are equal, and whether the day is stale.

    Equal in low and market, missing prices being equal; a day is stale, so not
    to be loaded, above a share of ``most``.  The first day, and days that share
    no row with the one before, are not.
    """
    days = prices.select("price_date").distinct()
    before = days.select(F.col("price_date").alias("day"), F.lag("price_date").over(W.orderBy("price_date")).alias("last"))  # a row a day
    now = prices.join(before, F.col("price_date") == F.col("day")).select("day", "last", "product_id", "printing", "low", "market")
    then = prices.select(F.col("price_date").alias("last"), "product_id", "printing", F.col("low").alias("low0"), F.col("market").alias("market0"), F.lit(True).alias("there"))
    same = F.col("low").eqNullSafe(F.col("low0")) & F.col("market").eqNullSafe(F.col("market0"))
    found = now.join(then, ["last", "product_id", "printing"], "left").groupBy("day").agg(F.count("there").alias("compared"), F.count_if(F.col("there") & same).alias("matched"))
    share = F.when(F.col("compared") > 0, F.col("matched") / F.col("compared")).otherwise(0.0)
    return found.select(F.col("day").alias("price_date"), "compared", "matched", (share > most).alias("stale"))


def group_averages(prices: DataFrame, cards: DataFrame, floor: int = 100) -> DataFrame:
    """Per set, rarity, printing and day of prices in whole cents: averages of low and market, and with prices under ``floor`` as zero, each rounded half up to the cent; cards without set or rarity are left out."""
    own = cards.where("set_id IS NOT NULL AND rarity IS NOT NULL").select("product_id", "set_id", "rarity")

    def mean(c: Column) -> Column:
        twice, n = 2 * F.sum(c) + F.count(c), 2 * F.count(c)
        return ((twice - F.pmod(twice, F.nullif(n, F.lit(0)))) / F.nullif(n, F.lit(0))).cast("bigint")

    none = lambda c: F.when(F.col(c) < floor, 0).otherwise(F.col(c))
    return prices.join(own, "product_id").groupBy("set_id", "rarity", "printing", "price_date").agg(
        mean(F.col("low")).alias("avg_low"), mean(F.col("market")).alias("avg_market"), mean(none("low")).alias("avg_low_floored"), mean(none("market")).alias("avg_market_floored"), F.count("*").alias("n_cards")
    )
