"""Market analytics over the daily price rows: averages, movers, as-of prices, medians, outliers and sale rollups.

Money is summed in whole cents, so no result depends on the order of rows.
Every query is one scan of the order lines, aggregated before it is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.plans.latest import DAILY
from tradewind.sources.tables import daily_prices, table

SERIES = ["product_id", "printing"]


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price rows with prices as whole cents."""
    return daily_prices(spark, sf_dir).select(
        *SERIES, "price_date", *(F.expr(f"CAST({c} * 100 AS BIGINT)").alias(c) for c in ("low", "market"))
    )


CENTS = f"""{DAILY},
cents AS (SELECT product_id, printing, price_date, CAST(low * 100 AS BIGINT) AS low, CAST(market * 100 AS BIGINT) AS market FROM daily)"""


def rarity_avg_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX3, AG1: average per brand, printing and day; prices under 100 dollars count as zero in the second one."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("product_id"), F.col("p_brand").alias("brand"))
    market = F.col("market")
    return (
        cents(spark, sf_dir)
        .join(parts, "product_id")
        .groupBy("brand", "printing", "price_date")
        .agg(
            F.count("*").alias("n_rows"),
            (F.sum("market") / F.count("market")).alias("avg_market"),
            (F.sum(F.when(market < 10000, 0).otherwise(market)) / F.count("market")).alias("avg_floored"),
        )
    )


def prices_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX8, JN5: newest market price strictly before a date, of every series."""
    before = cents(spark, sf_dir).where("market IS NOT NULL AND price_date < DATE '1996-01-01'")
    return before.groupBy(*SERIES).agg(F.max("price_date").alias("price_date"), F.expr("max_by(market, price_date)").alias("market"))


def low_last_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN6: the last day on which a series' low differs from the day before; its first day counts."""
    series = W.partitionBy(*SERIES).orderBy("price_date")
    changed = cents(spark, sf_dir).withColumn("changed", ~F.col("low").eqNullSafe(F.lag("low").over(series)))
    return changed.groupBy(*SERIES).agg(F.max(F.when(F.col("changed"), F.col("price_date"))).alias("changed_on"), F.sum(F.col("changed").cast("bigint")).alias("n_changes"))


def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN12: median of a brand's daily lows over the 30 days before each day, where these hold 15 or more."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("product_id"), F.col("p_brand").alias("brand"))
    daily = cents(spark, sf_dir).join(parts, "product_id").groupBy("brand", "price_date").agg(F.min("low").alias("low"))
    days = W.partitionBy("brand").orderBy(F.datediff("price_date", F.lit("1970-01-01").cast("date"))).rangeBetween(-30, -1)
    seen = daily.withColumn("s", F.array_sort(F.collect_list("low").over(days))).where(F.size("s") >= 15)
    return seen.select("brand", "price_date", "low", F.expr("(s[cast((size(s) - 1) div 2 as int)] + s[cast(size(s) div 2 as int)]) / 2.0D").alias("median_low"))


def sales_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX20, AG10: per series the number of sales, their range, and the mean of the last five."""
    newest = W.partitionBy(*SERIES).orderBy(F.desc("price_date"))
    ranked = cents(spark, sf_dir).where("market IS NOT NULL").withColumn("rn", F.row_number().over(newest))
    five = F.when(F.col("rn") <= 5, F.col("market"))
    return ranked.groupBy(*SERIES).agg(
        F.count("*").alias("n_sales"), F.min("market").alias("least"), F.max("market").alias("most"), (F.sum(five) / F.count(five)).alias("avg_last_5"), F.max("price_date").alias("last_date")
    )


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN15: trailing mean of five sales by row."""
    five = W.partitionBy(*SERIES).orderBy("price_date").rowsBetween(-4, 0)
    rows = cents(spark, sf_dir).where("market IS NOT NULL")
    return rows.select(*SERIES, "price_date", (F.sum("market").over(five) / F.count("market").over(five)).alias("avg_5"))


def duplicate_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX26: share of a series' prices that equal the one before, by month; missing prices are equal."""
    series = W.partitionBy(*SERIES).orderBy("price_date")
    rows = cents(spark, sf_dir).withColumns({"same": F.col("market").eqNullSafe(F.lag("market").over(series)), "first": F.row_number().over(series) == 1})
    month = F.expr("CAST(date_trunc('month', price_date) AS DATE)").alias("month")
    return rows.where("NOT first").groupBy(month).agg(F.count("*").alias("n_rows"), F.sum(F.col("same").cast("bigint")).alias("n_same"))


_BY = "product_id, printing"
QUERIES = {
    f.__name__: f
    for f in (rarity_avg_daily, prices_before, low_last_changed, rolling_median, sales_rollup, moving_average, duplicate_snapshots)
}
ORACLES = {
    "rarity_avg_daily": f"""WITH {CENTS} SELECT p_brand AS brand, printing, price_date, count(*) AS n_rows,
  CAST(sum(market) AS DOUBLE) / nullif(count(market), 0) AS avg_market,
  CAST(sum(CASE WHEN market < 10000 THEN 0 ELSE market END) AS DOUBLE) / nullif(count(market), 0) AS avg_floored
  FROM cents JOIN part ON p_partkey = product_id GROUP BY ALL""",
    "prices_before": f"""WITH {CENTS} SELECT {_BY}, max(price_date) AS price_date, max_by(market, price_date) AS market
  FROM cents WHERE market IS NOT NULL AND price_date < DATE '1996-01-01' GROUP BY ALL""",
    "low_last_changed": f"""WITH {CENTS}, c AS (SELECT *, low IS DISTINCT FROM lag(low) OVER (PARTITION BY {_BY} ORDER BY price_date) AS changed FROM cents)
  SELECT {_BY}, max(price_date) FILTER (WHERE changed) AS changed_on, CAST(count(*) FILTER (WHERE changed) AS BIGINT) AS n_changes FROM c GROUP BY ALL""",
    "rolling_median": f"""WITH {CENTS}, d AS (SELECT p_brand AS brand, price_date, min(low) AS low FROM cents JOIN part ON p_partkey = product_id GROUP BY ALL),
  w AS (SELECT *, median(low) OVER m AS median_low, count(low) OVER m AS n FROM d
        WINDOW m AS (PARTITION BY brand ORDER BY price_date - DATE '1970-01-01' RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
  SELECT brand, price_date, low, CAST(median_low AS DOUBLE) AS median_low FROM w WHERE n >= 15""",
    "sales_rollup": f"""WITH {CENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY price_date DESC) AS rn FROM cents WHERE market IS NOT NULL)
  SELECT {_BY}, count(*) AS n_sales, min(market) AS least, max(market) AS most,
  CAST(sum(market) FILTER (WHERE rn <= 5) AS DOUBLE) / count(*) FILTER (WHERE rn <= 5) AS avg_last_5, max(price_date) AS last_date FROM r GROUP BY ALL""",
    "moving_average": f"""WITH {CENTS} SELECT {_BY}, price_date, CAST(sum(market) OVER w AS DOUBLE) / count(market) OVER w AS avg_5 FROM cents WHERE market IS NOT NULL
  WINDOW w AS (PARTITION BY {_BY} ORDER BY price_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "duplicate_snapshots": f"""WITH {CENTS}, r AS (SELECT *, row_number() OVER w AS rn, market IS NOT DISTINCT FROM lag(market) OVER w AS same FROM cents
  WINDOW w AS (PARTITION BY {_BY} ORDER BY price_date))
  SELECT CAST(date_trunc('month', price_date) AS DATE) AS month, count(*) AS n_rows, CAST(count(*) FILTER (WHERE same) AS BIGINT) AS n_same FROM r WHERE rn > 1 GROUP BY ALL""",
}
