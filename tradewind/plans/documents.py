"""Snapshots and documents over the folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators import documents as D
from tradewind.plans.registered import query
from tradewind.sources.views import rows_of

#: Three versions of every order's deck; cards come, go and change their numbers.
_VERSIONS = """SELECT deck_id, version, card_id, printing, quantity FROM (SELECT l_orderkey AS deck_id, v.version, concat('crd_', l_partkey) AS card_id, CASE WHEN l_suppkey % 3 <> 0 THEN 'Foil' END AS printing, CAST(l_quantity % 4 + 1 + CASE WHEN v.version = 3 AND l_linenumber = 2 THEN 1 ELSE 0 END AS INT) AS quantity, l_linenumber, l_suppkey
  FROM {lineitem} CROSS JOIN (SELECT 1 AS version UNION ALL SELECT 2 UNION ALL SELECT 3) v) x WHERE NOT (version = 1 AND l_linenumber > 3) AND NOT (version = 3 AND l_suppkey % 5 = 0)"""
_BROKEN = "deck_id % 20 = 0 AND version = 2"


@query(f"""WITH c AS (SELECT deck_id, version, card_id, coalesce(printing, 'Normal') AS printing, CAST(sum(quantity) AS BIGINT) AS n FROM ({_VERSIONS}) WHERE NOT ({_BROKEN}) GROUP BY ALL), v AS (SELECT deck_id, version, lead(version) OVER (PARTITION BY deck_id ORDER BY version) AS next FROM (SELECT DISTINCT deck_id, version FROM c)),
  b AS (SELECT deck_id, version, card_id, printing, n AS now, 0 AS before FROM c UNION ALL SELECT c.deck_id, next, card_id, printing, 0, n FROM c JOIN v USING (deck_id, version) WHERE next IS NOT NULL)
  SELECT deck_id, version, card_id, printing, CAST(sum(before) AS BIGINT) AS before, CAST(sum(now) AS BIGINT) AS now FROM b GROUP BY ALL HAVING sum(before) <> sum(now)""")
def fn_json_deck_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN JSON: what each version of a deck changes, out of snapshots as JSON text, some of which can't be read."""
    # a deck's cards are brought together once, for its snapshots and their changes
    written = D.snapshot(rows_of(spark, sf_dir, _VERSIONS).repartition("deck_id"), ["deck_id", "version"])
    return D.snapshot_changes(written.withColumn("cards", F.when(F.expr(_BROKEN), '[{"card_id": ').otherwise(F.col("cards"))))


_SEASON = """SELECT concat('S', year(o_orderdate)) AS season, o_custkey AS player_id, count(*) AS n_matches, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS won, CASE WHEN o_custkey % 3 <> 0 THEN concat('Pl"ayer ', o_custkey) END AS name
  FROM {orders} GROUP BY concat('S', year(o_orderdate)), o_custkey"""


@query(f"""WITH r AS (SELECT *, CAST((row_number() OVER (PARTITION BY season ORDER BY won DESC, n_matches, player_id) - 1) // 100 AS INTEGER) AS page, row_number() OVER (PARTITION BY season ORDER BY won DESC, n_matches, player_id) AS k FROM ({_SEASON}))
  SELECT season, page, CAST(to_json(struct_pack(season := season, page := page, rows := list(struct_pack(player_id := player_id, name := name, n_matches := n_matches, won := won) ORDER BY k))) AS VARCHAR) AS document FROM r GROUP BY season, page""")
def fn_json_season_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN JSON, AG6: a season's players as ordered JSON documents of a hundred."""
    return D.pages(rows_of(spark, sf_dir, _SEASON), "season", [F.desc("won"), F.asc("n_matches"), F.asc("player_id")], ["player_id", "name", "n_matches", "won"])
