"""Streams over the folder's tables, replayed in several batches with late rows, with the SQL of the same result over the whole table.

What the watermark hasn't passed when the stream ends isn't given out, so the
SQL leaves out what ends within the delay of the newest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.plans.registered import query
from tradewind.sinks.merge import fates, trusted, upserted
from tradewind.sinks.shared import shared_path
from tradewind.sinks.versions import VersionedTable
from tradewind.sources.views import rows_of
from tradewind.streaming import events as E
from tradewind.streaming.alerts import cooled_alerts
from tradewind.streaming.runs import arriving, each_batch, in_batches, run_once, run_until

_CENTS = "CAST(round(value * 100) AS BIGINT)"
#: The watermark at the end: milliseconds of the newest time, less the delay.
_LAST = "(SELECT date_trunc('milliseconds', max(ts)) FROM {events})"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arriving(spark, sf_dir, "events").withColumn("cents", F.expr(_CENTS))


def _timed(spark: SparkSession, sf_dir: str, name: str, late: str = "make_interval(0, 0, 0, 0, CAST(event_id * 7 % 5 AS INT), 0, 0)", batches: int = 4) -> DataFrame:
    """The events in batches, each row up to some hours late."""
    rows = rows_of(spark, sf_dir, f"SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, {_CENTS} AS cents FROM {{events}}")
    return in_batches(rows, F.expr(f"ts + {late}"), batches, name)


@query("""SELECT event_id, CASE WHEN hour(ts) * 60 + minute(ts) >= 1215 THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) - 1 END AS day FROM {events}""")
def sm1_event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM1: the day each event counts for."""
    return run_once(_events(spark, sf_dir).select("event_id", E.event_day("ts").alias("day")), "days")


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM {events}")
def sm3_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM3: one row per key and day, duplicates dropped within the watermark."""
    rows = _timed(spark, sf_dir, "sm3").withColumn("day", F.to_date("ts"))
    return run_once(E.distinct_keys(rows, ["user_id", "event_type", "day"]).select("user_id", "event_type", "day"), "keys")


@query("""SELECT user_id, event_type, day, event_id, cents FROM (SELECT *, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM {events}) WHERE k = 1""")
def sm3_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM3, SNK1: a stream's rows merged by key into a stored table, each batch twice: the newest row of each key stays."""
    columns = "user_id bigint, event_type string, day date, ts timestamp, event_id bigint, cents bigint"
    table = VersionedTable(spark, shared_path(spark, "merged"), columns, ["user_id", "event_type", "day"])

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("day", F.to_date("ts")).select(table.schema.fieldNames())
        # a later batch can bring an older row, so what is stored competes too
        newest = lambda stored: upserted(stored.limit(0), stored.unionByName(rows), table.keys, ["ts", "event_id"])
        for _ in range(2):
            table.change(newest, rows, number)

    each_batch(_timed(spark, sf_dir, "sm3m"), "merged", write)
    return table.rows().select("user_id", "event_type", "day", "event_id", "cents")


_SCRAPED = "SELECT l_returnflag, l_partkey, CAST(l_shipdate AS DATE) AS sold, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) + make_interval(0, 0, 0, CAST(l_orderkey % 23 AS INT), 0, 0, 0) AS scraped FROM {lineitem}"


@query("""WITH s AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 23 AS INT) AS d, l_orderkey % 23 <= 14 AS fresh FROM {lineitem}), l AS (SELECT max(d) AS last FROM s),
  w AS (SELECT d + 1 AS arrived_by, l_returnflag, count(*) FILTER (fresh) AS n_new, count(*) FILTER (NOT fresh) AS n_old FROM s, l WHERE d + 1 <= last - 3 GROUP BY ALL),
  r AS (SELECT DISTINCT arrived_by AS built_at FROM w WHERE day(arrived_by) % 6 IN (0, 5)), c AS (SELECT built_at, greatest(coalesce(lag(built_at) OVER (ORDER BY built_at), built_at - 1), built_at - 3) AS cutoff FROM r)
  SELECT CAST(built_at AS DATE) AS built_on, l_returnflag, CAST(sum(n_new) AS BIGINT) AS n_new, CAST(sum(n_old) AS BIGINT) AS n_old FROM c JOIN w ON arrived_by > cutoff AND arrived_by <= built_at GROUP BY ALL""")
def sm4_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM4: sales that are new to each report by day of arrival, and those too old to be new; a window grows by two days at most where reports are missed."""
    rows = in_batches(rows_of(spark, sf_dir, _SCRAPED), F.expr("scraped + make_interval(0, 0, 0, CAST(l_partkey % 3 AS INT), 0, 0, 0)"), 4, "sm4")
    slots = run_once(E.arrivals(rows, "l_returnflag", "sold", "scraped", slot="1 day", delay="3 days"), "arrivals")
    built = slots.select(F.col("arrived_by").alias("built_at")).where(F.dayofmonth("arrived_by") % 6 >= 5).union(slots.select("arrived_by").where(F.dayofmonth("arrived_by") % 6 == 0)).distinct()
    windows = E.report_windows(built)
    day = lambda d: F.date_diff(F.col(d), F.lit("1970-01-01"))
    # each report's slots are listed, so the join is by day
    listed = windows.select("built_at", F.explode(F.sequence(day("cutoff") + 1, day("built_at"))).alias("slot"))
    found = slots.withColumn("slot", day("arrived_by")).join(listed, "slot").groupBy("built_at", "l_returnflag").agg(F.sum("n_new").alias("n_new"), F.sum("n_old").alias("n_old"))
    return found.select(F.to_date("built_at").alias("built_on"), "l_returnflag", "n_new", "n_old")


@query(f"""SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, count(*) AS n, CAST(sum({_CENTS}) AS BIGINT) AS total FROM {{events}} WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= {_LAST} - INTERVAL 1 DAY GROUP BY ALL""")
def sm5_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM5: tumbling weeks from Monday on, each given out once it is over."""
    return run_once(E.weekly(_timed(spark, sf_dir, "sm5"), "event_type", "cents"), "weekly")


_SLIDES = "SELECT *, ts - INTERVAL (k * 10) MINUTE AS shifted FROM {events} CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k)"


@query(f"""WITH s AS ({_SLIDES}), c AS (SELECT time_bucket(INTERVAL 10 MINUTE, shifted, TIMESTAMP '2000-01-01') AS began, event_type, user_id, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY began, event_type) AS BIGINT) AS pool_n FROM c)
  SELECT began, event_type, user_id, n, pool_n FROM t WHERE (n >= 2 OR pool_n >= 9 OR (pool_n >= 6 AND n >= 1)) AND began + INTERVAL 1 HOUR <= {_LAST} - INTERVAL 6 HOUR""")
def sm6_rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM6: sliding hours in which a user or a whole type of event is refused (limits fitted to the table's density)."""
    slots, until = run_until(E.slot_counts(_timed(spark, sf_dir, "sm6"), "user_id", "event_type", delay="6 hours"), "slots")
    found = E.refused(slots, until, "user_id", "event_type", most=2, pool_most=9, pool_busy=6, light=1)
    return found.withColumn("began", F.col("began").cast("timestamp_ntz"))


@query(f"""WITH RECURSIVE h AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(ts, (ts, value)) AS ts, arg_min(value, (ts, value)) AS value FROM {{events}} WHERE value >= 80 AND ts <= {_LAST} - INTERVAL 6 HOUR GROUP BY 1, 2),
  f AS (SELECT user_id, min(day) AS day FROM h GROUP BY user_id UNION ALL SELECT f.user_id, (SELECT min(h.day) FROM h WHERE h.user_id = f.user_id AND h.day >= f.day + 2) FROM f WHERE EXISTS (SELECT 1 FROM h WHERE h.user_id = f.user_id AND h.day >= f.day + 2))
  SELECT h.user_id, h.ts AS fired_at, h.value AS observed FROM f JOIN h ON h.user_id = f.user_id AND h.day = f.day""")
def sm7_cooled_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM7: alerts on large values, one a user and day, with a cooldown of two days."""
    found = run_once(cooled_alerts(_timed(spark, sf_dir, "sm7"), "user_id", "value", "ts", 80.0, 2, "6 hours"), "alerts")
    return found.withColumn("fired_at", F.col("fired_at").cast("timestamp_ntz"))


@query(f"""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM {{events}} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m), g AS (SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, k)
  SELECT * FROM g WHERE ended + INTERVAL 6 HOUR <= {_LAST} - INTERVAL 1 DAY""")
def sm8_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM8: sessions of each user with gaps of at most six hours, given out once over."""
    found = run_once(E.sessions(_timed(spark, sf_dir, "sm8"), "user_id", "6 hours"), "sessions")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "ended")})


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM {events} GROUP BY 1, 2), l AS (SELECT max(ts) AS last FROM {events}) SELECT day, event_type, n FROM d, l WHERE day + 1 <= last - INTERVAL 7 DAY""")
def sm9_settled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM9: daily counts of days that lie a week behind the newest event."""
    return run_once(E.settled_days(_timed(spark, sf_dir, "sm9"), "event_type"), "settled")


#: Four pulls a day apart.  The third brings a fifth of what is on file, and what a pull leaves out for good is what the next ones don't list either.
_PULLS = """SELECT k AS pull, o_orderkey AS event_id, CAST(TIMESTAMP '1998-02-01 06:00:00' + make_interval(0, 0, 0, CAST(k AS INT), 0, 0, 0) AS TIMESTAMP) AS pulled_at, CAST(o_orderdate AS TIMESTAMP) AS starts
  FROM {orders} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) p
  WHERE (o_orderkey % 7 >= k OR o_orderkey % 7 = 6) AND (k <> 2 OR o_orderkey % 5 = 0) AND (o_orderkey % 11 <> 0 OR k = 0)"""
_FLOOR = 200


def _pull_sql(k: int) -> str:
    """The table after a pull, from the one before."""
    at = f"TIMESTAMP '1998-02-01 06:00:00' + INTERVAL {k} DAY"
    return f"""n{k} AS (SELECT count(*) AS n FROM pulls WHERE pull = {k}), b{k} AS (SELECT count(*) AS n FROM t{k} WHERE starts >= {at} AND fate = 'kept'),
  m{k} AS (SELECT event_id, starts, CASE WHEN p.event_id IS NOT NULL THEN {at} ELSE t.last_seen_at END AS last_seen_at, 'kept' AS fate FROM (SELECT * FROM t{k} WHERE fate = 'kept') t FULL JOIN (SELECT event_id, starts FROM pulls WHERE pull = {k}) p USING (event_id, starts)),
  t{k + 1} AS (SELECT event_id, starts, last_seen_at, CASE WHEN n{k}.n >= {_FLOOR} AND n{k}.n >= 0.7 * b{k}.n THEN CASE WHEN starts >= {at} AND last_seen_at < {at} - INTERVAL 36 HOUR THEN 'delisted' WHEN starts < {at} - INTERVAL 30 DAY THEN 'archived' ELSE 'kept' END ELSE 'kept' END AS fate
    FROM m{k}, n{k}, b{k} UNION ALL SELECT * FROM t{k} WHERE fate <> 'kept')"""


@query(f"""WITH pulls AS ({_PULLS.replace("make_interval(0, 0, 0, CAST(k AS INT), 0, 0, 0)", "to_days(k)")}), t0 AS (SELECT CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS starts, CAST(NULL AS TIMESTAMP) AS last_seen_at, 'kept' AS fate WHERE FALSE),
  {", ".join(map(_pull_sql, range(4)))} SELECT event_id, starts, max(last_seen_at) AS last_seen_at, fate FROM t4 WHERE fate <> 'delisted' GROUP BY ALL""")
def sm10_seen_lately(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM10, SNK3: listings that pulls bring, pruned once unseen for 36 hours, past ones archived before they are swept; a partial pull prunes nothing."""
    columns = "event_id bigint, starts timestamp, last_seen_at timestamp"
    table = VersionedTable(spark, shared_path(spark, "listed"), columns, ["event_id", "starts"])
    archive = VersionedTable(spark, shared_path(spark, "archive"), columns, ["event_id", "starts"])

    def write(batch: DataFrame, number: int) -> None:
        fetched, now = batch.agg(F.count("*"), F.max("pulled_at")).first()
        if not fetched:
            return
        on_file = table.rows(before=2 * number).where(F.col("starts") >= F.lit(now)).count()
        table.merge(batch.select("event_id", "starts", F.col("pulled_at").alias("last_seen_at")), ["last_seen_at"], 2 * number)
        seen = fates(table.rows(before=2 * number + 1), "last_seen_at", "starts", str(now), trusted(fetched, on_file, least=_FLOOR))
        archive.merge(seen.where("fate = 'archived'").drop("fate"), ["last_seen_at"], number)
        table.replace(seen.where("fate = 'kept'").drop("fate"), 2 * number + 1)

    each_batch(in_batches(rows_of(spark, sf_dir, _PULLS), F.col("pulled_at"), 4, "pulls"), "listed", write)
    found = table.rows().withColumn("fate", F.lit("kept")).unionByName(archive.rows().withColumn("fate", F.lit("archived")))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("starts", "last_seen_at")})
