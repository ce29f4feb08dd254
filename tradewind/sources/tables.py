"""Readers of the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows per product, printing and day, out of the order lines.

    The unit price is the line's value over its quantity, rounded to the cent;
    market is the day's mean and low its smallest, both to the cent.  All of it
    is counted in whole cents, so no result depends on the order of rows.  A
    tenth of the returned days have no market price, so that rules on missing
    prices have rows to work on.
    """
    value, quantity = "CAST(round(l_extendedprice * 100) AS BIGINT)", "CAST(l_quantity AS BIGINT)"
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_partkey").cast("bigint").alias("product_id"),
            F.col("l_returnflag").alias("printing"),
            F.to_date("l_shipdate").alias("price_date"),
            F.expr(f"(2 * {value} + {quantity}) div (2 * {quantity})").alias("unit"),
        )
        .groupBy("product_id", "printing", "price_date")
        .agg(F.min("unit").alias("least"), F.expr("(2 * sum(unit) + count(unit)) div (2 * count(unit))").alias("mean"))
        .select(
            "product_id",
            "printing",
            "price_date",
            _dollars("least").alias("low"),
            F.when(F.dayofmonth("price_date") % 10 != 3, _dollars("mean")).alias("market"),
        )
    )


def _dollars(cents: str) -> Column:
    return F.expr(f"CAST(CAST({cents} AS DECIMAL(14,0)) * 0.01BD AS DECIMAL(12,2))")
