"""Ratings, sessions, places and sets: the queries about players, events and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.sinks.merge import last_of_batch, upserted
from tradewind.sources.tables import table

_VALUE = "CAST(round(value * 100) AS BIGINT)"


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN3: customers of each segment ranked by what they ordered; ties share a rank."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.expr("sum(CAST(round(o_totalprice * 100) AS BIGINT))").alias("cents"), F.count("*").alias("n_orders")
    )
    joined = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(spent, "c_custkey")
    return joined.withColumn("place", F.rank().over(W.partitionBy("c_mktsegment").orderBy(F.desc("cents"))))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN13: a user's events with gaps of at most an hour, as islands."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    marked = table(spark, sf_dir, "events").withColumn("new", F.coalesce(F.expr("ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR"), F.lit(True)))
    numbered = marked.withColumn("session", F.sum(F.col("new").cast("bigint")).over(order))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n_events"), F.expr(f"sum({_VALUE})").alias("cents"))


def running_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN17, WN8: what a user had before each event."""
    before = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce(F.sum(F.expr(_VALUE)).over(before), F.lit(0)).alias("cents_before"))


def grouping_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11: order counts by nation, segment, both and overall, in one scan."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cube = joined.groupingSets([["c_nationkey", "c_mktsegment"], ["c_nationkey"], ["c_mktsegment"], []], "c_nationkey", "c_mktsegment")
    return cube.agg(F.grouping_id().cast("int").alias("grain"), F.count("*").alias("n_orders"), F.expr("sum(CAST(round(o_totalprice * 100) AS BIGINT))").alias("cents"))


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8, AG15: exact medians with and without a filter, and their ratio."""
    two = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT))").alias("all_median"),
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderstatus = 'F')").alias("done_median"),
    )
    return two.withColumn("lift", F.coalesce(F.col("done_median") / F.nullif(F.col("all_median"), F.lit(0.0)), F.lit(1.0)))


def density_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12: every hour of the day has a row for every event type, with 0 where nothing happened."""
    events = table(spark, sf_dir, "events")
    seen = events.groupBy("event_type", F.hour("ts").cast("int").alias("hour")).agg(F.count("*").alias("n"))
    every = events.select("event_type").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return every.join(seen, ["event_type", "hour"], "left").select("event_type", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14: customers within 50 miles of a point: a box first, then the great-circle distance.

    Places are made from the key: a grid of hundredths of a degree.
    """
    at = table(spark, sf_dir, "customer").select("c_custkey", F.expr("40.0D + (c_custkey % 173) / 100.0D").alias("lat"), F.expr("-75.0D + (c_custkey % 211) / 100.0D").alias("lon"))
    box = at.where("lat BETWEEN 40.5D - 50.0D / 69.0D AND 40.5D + 50.0D / 69.0D AND lon BETWEEN -75.0D AND -73.0D")
    half = "power(sin(radians(lat - 40.5D) / 2), 2) + cos(radians(40.5D)) * cos(radians(lat)) * power(sin(radians(lon + 74.0D) / 2), 2)"
    return box.withColumn("miles", F.round(F.expr(f"3958.8D * 2 * asin(sqrt({half}))"), 2)).where("miles <= 50").select("c_custkey", "miles")


def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, WN10: one row per nation out of three sources, the preferred one first."""
    one = lambda name, key, value, pref: table(spark, sf_dir, name).select(F.col(key).cast("int").alias("nation"), F.col(value).alias("name"), F.lit(pref).alias("pref"))
    rows = one("supplier", "s_nationkey", "s_name", 1).unionByName(one("customer", "c_nationkey", "c_name", 2)).unionByName(one("nation", "n_nationkey", "n_name", 3))
    return rows.groupBy("nation").agg(F.min(F.struct("pref", "name")).alias("best")).select("nation", "best.pref", "best.name")


def without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9, JN10, ST3: customers with a finished order and without an open one."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return people.join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(orders.where("o_orderstatus = 'O'"), "c_custkey", "left_anti")


def part_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12, PRJ13: kinds by ordered patterns on names, the first that fits."""
    kind = F.when(F.col("p_name").rlike("^(cold|hot) "), "weather").when(F.col("p_name").rlike("(gear|widget)$"), "machine").when(F.col("p_type").rlike("(?i)economy"), "cheap").otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: orders before a day as the stored table of customers' orders, those from it on as a batch with repeated keys; the batch wins."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    early, late = (orders.where(f"day {op} DATE '1998-05-01'") for op in ("<", ">="))
    held = last_of_batch(early, ["o_custkey"], ["day", "o_orderkey"])
    return upserted(held, late, ["o_custkey"], ["day", "o_orderkey"])


QUERIES = {
    f.__name__: f
    for f in (leaderboard, sessions, running_points, grouping_grains, medians, density_fill, nearby, source_precedence, without_orders, part_kinds, upsert)
}
ORACLES = {
    "leaderboard": """WITH s AS (SELECT o_custkey AS c_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n_orders FROM orders GROUP BY ALL)
  SELECT c_custkey, c_mktsegment, cents, n_orders, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY cents DESC) AS INTEGER) AS place FROM customer JOIN s USING (c_custkey)""",
    "sessions": f"""WITH m AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 1 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM m)
  SELECT user_id, session, min(ts) AS began, max(ts) AS ended, count(*) AS n_events, CAST(sum({_VALUE}) AS BIGINT) AS cents FROM n GROUP BY ALL""",
    "running_points": f"""SELECT event_id, user_id, CAST(coalesce(sum({_VALUE}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cents_before FROM events""",
    "grouping_grains": """SELECT c_nationkey, c_mktsegment, CAST(grouping_id(c_nationkey, c_mktsegment) AS INTEGER) AS grain, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey), (c_mktsegment), ())""",
    "medians": """WITH t AS (SELECT o_orderpriority, quantile_cont(CAST(round(o_totalprice * 100) AS BIGINT), 0.5) AS all_median,
  quantile_cont(CAST(round(o_totalprice * 100) AS BIGINT), 0.5) FILTER (WHERE o_orderstatus = 'F') AS done_median FROM orders GROUP BY ALL)
  SELECT *, coalesce(done_median / nullif(all_median, 0), 1.0) AS lift FROM t""",
    "density_fill": """WITH e AS (SELECT DISTINCT event_type FROM events), s AS (SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL)
  SELECT e.event_type, CAST(h.hour AS INTEGER) AS hour, coalesce(s.n, 0) AS n FROM e CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN s ON s.event_type = e.event_type AND s.hour = h.hour""",
    "nearby": """WITH a AS (SELECT c_custkey, 40.0::DOUBLE + CAST(c_custkey % 173 AS DOUBLE) / 100 AS lat, -75.0::DOUBLE + CAST(c_custkey % 211 AS DOUBLE) / 100 AS lon FROM customer),
  m AS (SELECT c_custkey, round(3958.8::DOUBLE * 2 * asin(sqrt(power(sin(radians(lat - 40.5) / 2), 2) + cos(radians(40.5)) * cos(radians(lat)) * power(sin(radians(lon + 74.0) / 2), 2))), 2) AS miles
        FROM a WHERE lat BETWEEN 40.5 - 50.0::DOUBLE / 69 AND 40.5 + 50.0::DOUBLE / 69 AND lon BETWEEN -75 AND -73)
  SELECT c_custkey, miles FROM m WHERE miles <= 50""",
    "source_precedence": """WITH r AS (SELECT s_nationkey AS nation, s_name AS name, 1 AS pref FROM supplier UNION ALL SELECT c_nationkey, c_name, 2 FROM customer UNION ALL SELECT n_nationkey, n_name, 3 FROM nation)
  SELECT nation, pref, name FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY pref, name) AS rn FROM r) WHERE rn = 1""",
    "without_orders": """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
    "part_kinds": """SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(cold|hot) ') THEN 'weather' WHEN regexp_matches(p_name, '(gear|widget)$') THEN 'machine'
  WHEN regexp_matches(p_type, '(?i)economy') THEN 'cheap' ELSE 'none' END AS kind FROM part""",
    "upsert": """SELECT o_custkey, o_orderkey, day FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) >= DATE '1998-05-01' DESC, CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
}
