"""Softest and tracked events over the folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewind.operators.softest import softest_events, tracked_upcoming
from tradewind.plans.registered import query
from tradewind.sources.views import rows_of

_EVENTS = "SELECT event_id, store_id, kind, start_datetime, latitude, longitude, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 90 AS INT) END AS registered FROM {places}"
_CAME = "SELECT l_orderkey AS event_id, concat('Player ', l_partkey % 997) AS person, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber END AS place, l_suppkey % 3 AS matches_won, CASE WHEN l_suppkey % 5 = 0 THEN 1 END AS matches_lost, CAST(NULL AS INT) AS matches_drawn FROM {lineitem}"
_PEOPLE = "SELECT concat('PLAYER ', c_custkey % 1100) AS name, 1200 + c_custkey % 700 AS rating, c_custkey % 9 AS n_matches FROM {customer}"
_ORIGINS = "SELECT n_nationkey AS origin_id, CAST(38 + n_nationkey / 6.0E0 AS DOUBLE) AS origin_lat, CAST(-77 + n_nationkey / 5.0E0 AS DOUBLE) AS origin_lon, CAST(30 + n_nationkey % 5 * 15 AS DOUBLE) AS radius_miles FROM {nation}"
_SCANS = "SELECT o_orderkey AS event_id FROM {orders} WHERE o_orderkey % 4 <> 0"
_TRACKED = "SELECT c_custkey AS store_id FROM {customer} WHERE c_custkey % 12 = 0"
_NOW = "1998-06-01 00:00:00"
_MILES = "3958.7613::DOUBLE * 2 * asin(sqrt(least(1.0, power(sin(radians(latitude - origin_lat) / 2), 2) + cos(radians(origin_lat)) * cos(radians(latitude)) * power(sin(radians(longitude - origin_lon) / 2), 2))))"


@query(f"""WITH e AS ({_EVENTS}), h AS (SELECT * FROM e WHERE start_datetime <= TIMESTAMP '{_NOW}'), t AS (SELECT * FROM ({_CAME}) WHERE place IS NOT NULL OR matches_won > 0 OR coalesce(matches_lost, 0) > 0),
  p AS (SELECT event_id, CAST(count(*) AS DOUBLE) AS players FROM t GROUP BY event_id), f AS (SELECT h.*, players, kind = 'championship' AS own, start_datetime > TIMESTAMP '{_NOW}' - INTERVAL 24 MONTH AS recent FROM h JOIN p USING (event_id)),
  s AS (SELECT store_id, count(*) FILTER (own) AS past_own, quantile_cont(players, 0.5) FILTER (own) AS med_own, count(*) FILTER (NOT own AND recent) AS past_other, quantile_cont(players, 0.5) FILTER (NOT own AND recent) AS med_other FROM f GROUP BY store_id),
  l AS (SELECT coalesce(quantile_cont(players, 0.5) FILTER (own) / nullif(quantile_cont(players, 0.5) FILTER (NOT own), 0), 1.0) AS lift FROM f),
  r AS (SELECT lower(name) AS name, max(rating) AS rating FROM ({_PEOPLE}) WHERE n_matches >= 5 GROUP BY 1),
  a AS (SELECT store_id, count(DISTINCT person) AS rated_seen, count(DISTINCT person) FILTER (rating >= 1600) AS sharks_seen, max(rating) AS top_rating FROM h JOIN t USING (event_id) JOIN r ON r.name = lower(person) WHERE start_datetime > TIMESTAMP '{_NOW}' - INTERVAL 24 MONTH GROUP BY store_id),
  c AS (SELECT store_id, count(*) AS scanned_events FROM h JOIN ({_SCANS}) USING (event_id) GROUP BY store_id),
  u AS (SELECT o.origin_id, e.*, {_MILES} AS miles, radius_miles FROM e, ({_ORIGINS}) o WHERE kind = 'championship' AND start_datetime > TIMESTAMP '{_NOW}'),
  x AS (SELECT u.*, s.past_own, s.med_own, s.past_other, s.med_other, a.rated_seen, a.sharks_seen, a.top_rating, c.scanned_events, k.store_id IS NOT NULL AS is_tracked, greatest(coalesce(med_own, med_other * lift, 12), coalesce(registered, 0)) AS est
    FROM u CROSS JOIN l LEFT JOIN s ON s.store_id = u.store_id LEFT JOIN a ON a.store_id = u.store_id LEFT JOIN c ON c.store_id = u.store_id LEFT JOIN ({_TRACKED}) k ON k.store_id = u.store_id WHERE miles <= radius_miles)
  SELECT origin_id, event_id, store_id, CAST(round_even(miles, 0) AS INT) AS miles, CAST(start_datetime AS DATE) AS event_date, miles <= 75 OR is_tracked AS in_bubble, coalesce(past_own, 0) AS past_own, CAST(round_even(med_own, 0) AS INT) AS med_own,
    coalesce(past_other, 0) AS past_other, CAST(round_even(med_other, 0) AS INT) AS med_other, CAST(round_even(est, 0) AS INT) AS est_field, coalesce(rated_seen, 0) AS rated_seen, coalesce(sharks_seen, 0) AS sharks_seen, CAST(top_rating AS INT) AS top_rating,
    coalesce(scanned_events, 0) AS scanned_events, CAST(round_even(est + coalesce(rated_seen, 0) + 2 * coalesce(sharks_seen, 0), 0) AS INT) AS score FROM x""")
def el16_softest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL16, JN14, JN20, AG8, AG15: upcoming championships around every nation's town, with what is known of their stores and a score."""
    rows = lambda sql: rows_of(spark, sf_dir, sql)
    events = rows(_EVENTS)
    return softest_events(events, events.where(f"start_datetime <= TIMESTAMP '{_NOW}'"), rows(_CAME), rows(_SCANS), rows(_PEOPLE), rows(_ORIGINS), _NOW, rows(_TRACKED))


@query(f"SELECT event_id, store_id, start_datetime, registered FROM ({_EVENTS}) WHERE kind = 'championship' AND start_datetime > TIMESTAMP '{_NOW}' AND store_id IN (SELECT store_id FROM ({_TRACKED}))")
def el19_tracked_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL19: upcoming championships at tracked stores."""
    return tracked_upcoming(rows_of(spark, sf_dir, _EVENTS), rows_of(spark, sf_dir, _TRACKED), _NOW).select("event_id", "store_id", "start_datetime", "registered")
