"""Feeds written from the folder's tables and read again, and the merges of what they bring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.plans.registered import query
from tradewind.sinks.merge import export_csv, inserted, reread_plan
from tradewind.sinks.shared import shared_path
from tradewind.sinks.versions import VersionedTable, refreshed
from tradewind.sources import feeds
from tradewind.sources.views import rows_of, view

_PUBLISHED = """SELECT product_id AS productId, CASE WHEN printing <> 'Normal' THEN printing END AS subTypeName, CASE WHEN product_id % 5 = 0 THEN 0.0E0 ELSE CAST(low AS DOUBLE) END AS lowPrice,
  CASE WHEN product_id % 3 = 0 THEN 0.0E0 ELSE CAST(market AS DOUBLE) END AS marketPrice, CAST(price_date AS STRING) AS day FROM {prices}"""


@query("""SELECT product_id, price_date, printing, CASE WHEN product_id % 5 <> 0 THEN CAST(low AS DOUBLE) END AS low, CASE WHEN product_id % 3 <> 0 THEN CAST(market AS DOUBLE) END AS market
  FROM {prices} WHERE NOT (product_id % 5 = 0 AND (product_id % 3 = 0 OR market IS NULL)) AND price_date NOT IN (SELECT price_date FROM {prices} WHERE product_id = 1)""")
def src2_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC2, PRJ1: published prices by day, less the days that are loaded already."""
    path = shared_path(spark, "archive")
    # a folder a month; the days are columns of the rows then, and folders of days are what pruning skips
    rows_of(spark, sf_dir, _PUBLISHED).withColumn("month", F.substring("day", 1, 7)).repartition("month").write.partitionBy("month").json(path)
    return feeds.archive_prices(spark, path, view(spark, sf_dir, "prices").where("product_id = 1")).select("product_id", "price_date", "printing", "low", "market")


_LINES = """SELECT item_id, title, price, sold, folder FROM (SELECT CASE WHEN l_suppkey % 3 <> 0 THEN concat(l_orderkey, '-', l_partkey) ELSE '' END AS item_id, concat('T', l_partkey) AS title, CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 / 100.0E0 AS price,
  CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS STRING) AS sold, CASE WHEN l_linenumber < 3 THEN 'a' WHEN l_linenumber < 6 THEN 'b' ELSE 'c' END AS folder FROM {lineitem}) x GROUP BY item_id, title, price, sold, folder"""


@query(f"""WITH l AS (SELECT *, CASE WHEN item_id <> '' THEN item_id ELSE title || '|' || CAST(CAST(price AS DECIMAL(14,2)) AS VARCHAR) || '|' || sold END AS key FROM ({_LINES}))
  SELECT key, arg_min(item_id, (folder, price, sold)) AS item_id, arg_min(title, (folder, price, sold)) AS title, arg_min(price, (folder, price, sold)) AS price, arg_min(sold, (folder, price, sold)) AS sold FROM l GROUP BY key""")
def src3_sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: sales of JSON lines, one row per item across files, the line seen first (each folder's lines are sorted by price and day)."""
    path = shared_path(spark, "lines")
    for folder in ("a", "b", "c"):
        rows = rows_of(spark, sf_dir, _LINES).where(F.col("folder") == folder).drop("folder")
        rows.repartitionByRange(4, "price", "sold").sortWithinPartitions("price", "sold").write.json(f"{path}/{folder}")
    return feeds.sales_lines(spark, path)


_WEEKS = """SELECT CAST(l_partkey AS BIGINT) AS product, l_returnflag AS printing, l_linestatus AS condition, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CASE WHEN l_suppkey % 2 = 0 THEN 'English' ELSE 'German' END AS language,
  max(l_extendedprice) AS price, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS transactions FROM {lineitem} GROUP BY CAST(l_partkey AS BIGINT), l_returnflag, l_linestatus, CAST(date_trunc('week', l_shipdate) AS DATE), CASE WHEN l_suppkey % 2 = 0 THEN 'English' ELSE 'German' END"""


@query(f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY product, printing, condition, week ORDER BY language = 'English' DESC, transactions DESC) AS k FROM ({_WEEKS})) WHERE k = 1")
def src4_sku_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: nested weekly sales, English first."""
    path = shared_path(spark, "skus")
    bucket = F.struct(F.col("week").cast("string").alias("week"), "price", "quantity", "transactions")
    skus = rows_of(spark, sf_dir, _WEEKS).groupBy("product", "printing", "condition", "language").agg(F.collect_list(bucket).alias("buckets"))
    skus.groupBy("product").agg(F.collect_list(F.struct("printing", "condition", "language", "buckets")).alias("skus")).write.json(path)
    return feeds.sku_buckets(spark.read.schema(feeds.BUCKETS).json(path))


@query("SELECT c_custkey, c_name, c_mktsegment FROM {customer}")
def snk6_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6, SRC6: a table exported as CSV and read again."""
    path = shared_path(spark, "csv")
    export_csv(view(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return feeds.csv_rows(spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


_HAD = "SELECT o_custkey AS k, o_orderstatus AS s, o_orderkey AS n FROM {orders} WHERE o_orderdate < TIMESTAMP '1998-01-01'"
_NEW = "SELECT o_custkey AS k, o_orderstatus AS s, o_orderkey AS n FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01'"


@query(f"SELECT k, s, min(n) AS n FROM ({_NEW}) WHERE (k, s) NOT IN (SELECT k, s FROM ({_HAD})) GROUP BY k, s")
def snk2_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: what a batch appends to a table that already holds some of its keys."""
    return inserted(rows_of(spark, sf_dir, _HAD), rows_of(spark, sf_dir, _NEW), ["k", "s"], ["n"])


_STORED = "SELECT DISTINCT o_custkey % 200 AS event, o_custkey AS member FROM {orders} WHERE o_orderkey % 5 <> 0"
_FETCHED = "SELECT DISTINCT o_custkey % 200 AS event, o_custkey AS member FROM {orders} WHERE o_orderkey % 7 <> 0 AND o_custkey % 200 <> 13 AND NOT (o_custkey % 200 = 17 AND o_custkey > 400)"
#: The events that were read: number 19 wasn't, number 13 came back empty.
_READ = "SELECT DISTINCT o_custkey % 200 AS event FROM {orders} WHERE o_custkey % 200 <> 19"


@query(f"""WITH a AS (SELECT event, list(member) AS had FROM ({_STORED}) GROUP BY event), b AS (SELECT event, list(member) AS has FROM ({_FETCHED}) GROUP BY event),
  j AS (SELECT event, coalesce(had, []) AS had, coalesce(has, []) AS has FROM ({_READ}) r LEFT JOIN a USING (event) LEFT JOIN b USING (event)), g AS (SELECT *, list_sort(list_filter(had, lambda m: NOT list_contains(has, m))) AS gone FROM j),
  s AS (SELECT *, CASE WHEN len(has) = 0 AND len(had) > 0 THEN 'untrusted' WHEN len(gone) > greatest(3, floor(len(had) * 0.5)) THEN 'held back' ELSE 'apply' END AS state FROM g)
  SELECT event, state, array_to_string(list_sort(list_filter(has, lambda m: NOT list_contains(had, m))), ',') AS adds, CASE WHEN state = 'apply' THEN array_to_string(gone, ',') ELSE '' END AS deletes FROM s""")
def snk4_reread_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: whom a re-read of each event adds and deletes, and which plans are held back or untrusted."""
    plan = reread_plan(rows_of(spark, sf_dir, _STORED), rows_of(spark, sf_dir, _FETCHED), rows_of(spark, sf_dir, _READ), "event", "member")
    return plan.select("event", "state", *(F.array_join(F.transform(c, lambda m: m.cast("string")), ",").alias(c) for c in ("adds", "deletes")))


_ORDERS = "SELECT o_custkey, o_orderstatus, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM {orders}"


@query(f"SELECT o_custkey, o_orderstatus, o_orderkey, day FROM ({_ORDERS}) QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY day DESC, o_orderkey DESC) = 1")
def snk1_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: yearly batches upserted into a stored table, each of them twice, the last row of each key in a batch."""
    rows = rows_of(spark, sf_dir, _ORDERS)
    table = VersionedTable(spark, shared_path(spark, "orders"), rows.schema, ["o_custkey", "o_orderstatus"])
    first, last = rows.agg(F.min(F.year("day")), F.max(F.year("day"))).first()
    for year in range(first, last + 1):
        for _ in range(2):
            table.merge(rows.where(F.year("day") == year), ["day", "o_orderkey"], year)
    return table.rows()


@query("SELECT l_partkey, count(*) AS n, max(CAST(l_shipdate AS DATE)) AS last FROM {lineitem} GROUP BY l_partkey")
def snk5_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: a stored result swapped for a newer one; the first attempt fails half way, so the plain one after it counts."""
    totals = lambda rows: rows.groupBy("l_partkey").agg(F.count("*").alias("n"), F.to_date(F.max("l_shipdate")).alias("last"))
    rows = view(spark, sf_dir, "lineitem")
    table = VersionedTable(spark, shared_path(spark, "totals"), "l_partkey bigint, n bigint, last date", ["l_partkey"])
    refreshed(table, [lambda: totals(rows.where("l_linenumber = 1"))])
    failing = lambda: totals(rows).withColumn("n", F.when(F.col("l_partkey") >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("bigint"))
    refreshed(table, [failing, lambda: totals(rows)])
    return table.rows()
