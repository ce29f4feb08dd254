"""Newest price of every card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.sources.tables import daily_prices, table


def card_prices_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX1: newest row with any price per product and printing, and whether it is old."""
    prices = daily_prices(spark, sf_dir).where("market IS NOT NULL OR low IS NOT NULL")
    newest = prices.groupBy("product_id", "printing").agg(
        F.max(F.struct("price_date", "low", "market")).alias("row")
    )
    cards = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("bigint").alias("product_id"), F.col("p_name").alias("name")
    )
    last = newest.agg(F.max("row.price_date").alias("last_date"))
    return (
        newest.join(cards, "product_id")
        .crossJoin(F.broadcast(last))  # one row
        .select(
            "product_id",
            "printing",
            "name",
            F.col("row.price_date").alias("price_date"),
            F.col("row.low").cast("double").alias("low"),
            F.col("row.market").cast("double").alias("market"),
            (F.col("row.price_date") < F.col("last_date")).alias("is_stale"),
        )
    )


#: The price rows that daily_prices() makes, as a common table expression.
DAILY = """units AS (
  SELECT CAST(l_partkey AS BIGINT) AS product_id, l_returnflag AS printing, CAST(l_shipdate AS DATE) AS price_date,
         (2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS unit
  FROM lineitem),
means AS (
  SELECT product_id, printing, price_date, min(unit) AS least, CAST((2 * sum(unit) + count(unit)) // (2 * count(unit)) AS BIGINT) AS mean
  FROM units GROUP BY ALL),
daily AS (
  SELECT product_id, printing, price_date, CAST(CAST(least AS DECIMAL(14,0)) * 0.01 AS DECIMAL(12,2)) AS low,
         CASE WHEN day(price_date) % 10 <> 3 THEN CAST(CAST(mean AS DECIMAL(14,0)) * 0.01 AS DECIMAL(12,2)) END AS market
  FROM means)"""

QUERIES = {"card_prices_latest": card_prices_latest}
ORACLES = {
    "card_prices_latest": f"""WITH {DAILY},
  newest AS (SELECT *, row_number() OVER (PARTITION BY product_id, printing ORDER BY price_date DESC) AS rn
             FROM daily WHERE market IS NOT NULL OR low IS NOT NULL)
SELECT n.product_id, n.printing, p.p_name AS name, n.price_date, CAST(n.low AS DOUBLE) AS low,
       CAST(n.market AS DOUBLE) AS market, n.price_date < max(n.price_date) OVER () AS is_stale
FROM newest n JOIN part p ON p.p_partkey = n.product_id WHERE rn = 1"""
}
