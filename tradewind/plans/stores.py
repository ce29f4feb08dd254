"""Stores' tiers and windows over the folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators import stores as S
from tradewind.plans.registered import query
from tradewind.sources.views import rows_of

_SETS = """SELECT DISTINCT concat('Set ', year(o_orderdate)) AS name, CAST(year(o_orderdate) - 1990 AS STRING) AS code, make_date(CAST(year(o_orderdate) AS INT), 2, 1) AS released_at FROM {orders}
  UNION ALL SELECT DISTINCT concat('Promos ', year(o_orderdate)), concat('P', year(o_orderdate) - 1990), make_date(CAST(year(o_orderdate) AS INT), 6, 1) FROM {orders}"""
_HELD = "SELECT o_orderkey AS event_id, CASE WHEN o_custkey % 40 <> 0 THEN o_custkey % 75 END AS store_id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 6 = 0 AS cancelled FROM {orders}"
_CAME = """SELECT l_orderkey AS event_id, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 400 END AS user_id, concat(CASE WHEN l_suppkey % 2 = 0 THEN ' Guest ' ELSE 'guest ' END, l_suppkey % 60, ' ') AS identifier, CASE WHEN l_orderkey % 4 = 0 AND l_linenumber = 1 THEN 1 END AS place,
  CASE WHEN l_orderkey % 4 = 1 THEN l_linenumber % 2 END AS won, CAST(NULL AS INT) AS lost, CAST(NULL AS INT) AS drawn, CASE l_suppkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN '' END AS status FROM {lineitem}"""
_SCANS = "SELECT o_orderkey AS event_id FROM {orders} WHERE o_orderkey % 5 <> 0"
_TRACKED = "SELECT DISTINCT o_custkey % 75 AS store_id FROM {orders} WHERE o_custkey % 75 <> 7"
_TODAY = "2001-03-01"
_TICKETS = f"""a AS (SELECT *, place IS NOT NULL OR coalesce(won, 0) > 0 AS sat, CASE WHEN user_id IS NOT NULL THEN 'u:' || user_id ELSE 'n:' || lower(trim(identifier)) END AS person FROM ({_CAME})), w AS (SELECT DISTINCT event_id FROM a WHERE sat),
  h AS (SELECT e.*, w.event_id IS NOT NULL AS has FROM ({_HELD}) e LEFT JOIN w USING (event_id) WHERE store_id IN (SELECT store_id FROM ({_TRACKED})) AND (NOT cancelled OR w.event_id IS NOT NULL)),
  t AS (SELECT h.event_id, store_id, day, person, has FROM h JOIN a USING (event_id) WHERE CASE WHEN has THEN sat ELSE event_id IN (SELECT event_id FROM ({_SCANS})) AND upper(coalesce(status, '')) IN ('', 'COMPLETE') END),
  s AS (SELECT name, released_at, row_number() OVER (ORDER BY released_at DESC) AS k FROM ({_SETS}) WHERE regexp_matches(code, '^[0-9]+$') AND released_at <= DATE '{_TODAY}')"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple:
    rows = lambda sql: rows_of(spark, sf_dir, sql)
    came, scans = rows(_CAME), rows(_SCANS)
    held = S.held_events(rows(_HELD), came, rows(_TRACKED))
    return held, S.tickets(held, came, scans), scans, S.main_sets(rows(_SETS), _TODAY)


@query(f"""WITH {_TICKETS}, b AS (SELECT (SELECT released_at FROM s WHERE k = 5) AS since, (SELECT released_at FROM s WHERE k = 1) AS until),
  r AS (SELECT store_id, count(*) AS events, count(*) FILTER (event_id NOT IN (SELECT event_id FROM ({_SCANS}))) AS gap FROM h, b WHERE day >= since AND day < until GROUP BY store_id),
  c AS (SELECT store_id, count(*) AS tickets, count(*) FILTER (NOT has) AS unrecorded, count(DISTINCT person) AS people FROM t, b WHERE day >= since AND day < until GROUP BY store_id)
  SELECT store_id, events, gap, coalesce(tickets, 0) AS tickets, coalesce(unrecorded, 0) AS unrecorded, coalesce(people, 0) AS people,
    CASE WHEN events >= 50 AND people >= 50 AND tickets >= 500 THEN 'Legendary' WHEN events >= 25 AND people >= 25 AND tickets >= 250 THEN 'Standard' ELSE 'Welcome' END AS tier FROM r LEFT JOIN c USING (store_id)""")
def ag16_store_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16, EL18: tracked stores over the last four finished seasons by events, people and tickets."""
    held, sold, scans, sets = _tables(spark, sf_dir)
    since, until, _ = S.season_window(sets)
    return S.store_tiers(held, sold, scans, since, until)


@query(f"""WITH {_TICKETS}, q AS (SELECT t.*, (SELECT min(k) FROM s WHERE released_at <= t.day) AS k FROM t), win AS (SELECT a.k AS lo, b.k AS hi FROM s a JOIN s b ON a.k <= b.k)
  SELECT concat(lo, '-', hi) AS window_id, store_id, count(DISTINCT person) AS people, count(*) AS tickets FROM q JOIN win ON q.k BETWEEN lo AND hi GROUP BY ALL""")
def mt5_store_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT5: distinct people and tickets of each store for every window of neighbouring seasons, out of bitmaps by season."""
    _, sold, _, sets = _tables(spark, sf_dir)
    bitmaps = S.season_bitmaps(sold, S.numbered(sold), S.season_of("day", sets))
    names = [n for n, _ in sets]
    windows = [(f"{a + 1}-{b + 1}", names[k]) for a in range(len(names)) for b in range(a, len(names)) for k in range(a, b + 1)]
    return S.window_people(bitmaps, F.broadcast(spark.createDataFrame(windows, "window_id string, season string")))
