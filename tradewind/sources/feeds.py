"""Readers of published feeds: price archives, JSON lines and nested JSON, CSV and database tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A day's published prices.
PRICE = "productId bigint, subTypeName string, lowPrice double, midPrice double, marketPrice double, highPrice double, directLowPrice double"
SALE = "item_id string, title string, price double, sold string"
BUCKETS = "product bigint, skus array<struct<printing:string, condition:string, language:string, buckets:array<struct<week:string, price:double, quantity:bigint, transactions:bigint>>>>"


def price_rows(raw: DataFrame, day: str = "day") -> DataFrame:
    """Published prices as rows: zero and missing alike are null, a missing printing is Normal, rows without any price go."""
    prices = {"low": "lowPrice", "mid": "midPrice", "market": "marketPrice", "high": "highPrice", "direct_low": "directLowPrice"}
    found = raw.where("productId IS NOT NULL").select(
        F.col("productId").alias("product_id"), F.to_date(day).alias("price_date"), F.coalesce(F.nullif("subTypeName", F.lit("")), F.lit("Normal")).alias("printing"), *(F.when(F.col(c) > 0, F.col(c)).alias(a) for a, c in prices.items())
    )
    return found.where(F.coalesce(*prices).isNotNull())


def archive_prices(spark: SparkSession, path: str, loaded: DataFrame | None = None) -> DataFrame:
    """An archive of JSON files, less the days that loaded(price_date) already holds.

    The loaded days are collected, one value a day: where the archive has a
    folder for each (day=...), partition pruning leaves theirs unread.
    """
    rows = spark.read.schema(f"{PRICE}, day date").json(path)
    if loaded is not None:
        days = [r[0] for r in loaded.select("price_date").where("price_date IS NOT NULL").distinct().collect()]
        rows = rows.where(~F.col("day").isin(days)) if days else rows
    return price_rows(rows)


def sales_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of all files with one row per item: by item_id, else by title, price and date; the line seen first stays.

    Files come in order of their names, lines in the order of their file: by the
    split's offset, and by the running number that a split's lines are read in.
    """
    lines = spark.read.schema(SALE).option("recursiveFileLookup", True).json(path)
    rows = lines.withColumns({"file": F.col("_metadata.file_path"), "at": F.col("_metadata.file_block_start"), "line": F.monotonically_increasing_id()})
    key = F.coalesce(F.nullif("item_id", F.lit("")), F.concat_ws("|", "title", F.col("price").cast("decimal(14,2)").cast("string"), "sold"))
    kept = rows.groupBy(key.alias("key")).agg(F.min_by(F.struct("item_id", "title", "price", "sold"), F.struct("file", "at", "line")).alias("r"))
    return kept.select("key", "r.item_id", "r.title", "r.price", "r.sold")


def sku_buckets(raw: DataFrame) -> DataFrame:
    """Nested weekly sales as one row per product, printing, condition and week; of several languages English wins, then more transactions."""
    skus = raw.select("product", F.explode("skus").alias("s")).select("product", "s.printing", "s.condition", "s.language", F.explode("s.buckets").alias("b"))
    rows = skus.select("product", "printing", "condition", F.to_date("b.week").alias("week"), "language", "b.price", "b.quantity", "b.transactions")
    best = F.max(F.struct((F.col("language") == "English").alias("english"), "transactions", "quantity", "price", "language")).alias("r")
    return rows.groupBy("product", "printing", "condition", "week").agg(best).select("product", "printing", "condition", "week", "r.language", "r.price", "r.quantity", "r.transactions")


def database_table(spark: SparkSession, url: str, name: str, key: str, least: int, most: int, parts: int = 32) -> DataFrame:
    """A table of another database, read in ranges of a unique key at once instead of page by page."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=least, upperBound=most, numPartitions=parts).load()


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line; quotes are doubled, and rows that don't fit the schema fail."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
