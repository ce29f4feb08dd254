"""Names resolved by words, keys of people, and suggestions of equal accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions import keys
from tradewind.operators import people as P
from tradewind.operators import search as S
from tradewind.plans.registered import query
from tradewind.sources.views import rows_of, view

_NAMES = "SELECT CAST(p_partkey AS BIGINT) AS cid, concat(p_name, ' ', lower(p_type), ' no', p_size) AS name FROM {part}"
_ASKED = "SELECT CAST(p_partkey AS BIGINT) AS qid, concat(replace(p_name, 'dg', 'gd'), ' ', substring(lower(p_type), 1, 4), ' no', p_size) AS text FROM {part} WHERE p_partkey % 50 = 0"
_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower({c}), '[^a-z0-9]+')), lambda x: length(x) >= 1)"


@query(f"""WITH held AS (SELECT cid, unnest({_WORDS.replace("{c}", "name")}) AS word FROM ({_NAMES})), voc AS (SELECT word, ln(1 + (SELECT count(*) FROM ({_NAMES})) / count(*)) AS idf FROM held GROUP BY word),
  asked AS (SELECT qid, unnest({_WORDS.replace("{c}", "text")}) AS q FROM ({_ASKED})), dq AS (SELECT DISTINCT q FROM asked),
  pairs AS (SELECT q, word, idf, CASE WHEN q = word THEN 1.0 WHEN length(q) >= 3 AND length(word) > length(q) AND starts_with(word, q) THEN 0.9 WHEN length(q) >= 4 AND length(word) >= 4 AND damerau_levenshtein(q, word) = 1 THEN 0.75 END AS s FROM dq, voc),
  ok AS (SELECT q, word, idf, CAST(s AS DOUBLE) AS s FROM pairs WHERE s IS NOT NULL), w AS (SELECT q, arg_max(idf, (s, idf)) AS w FROM ok GROUP BY q), total AS (SELECT qid, sum(w) AS total FROM asked JOIN w USING (q) GROUP BY qid),
  b AS (SELECT qid, cid, q, max(s) AS s FROM asked JOIN ok USING (q) JOIN held USING (word) GROUP BY ALL), sc AS (SELECT qid, cid, round(sum(w * s) / max(total), 6) AS score FROM b JOIN w USING (q) JOIN total USING (qid) GROUP BY ALL)
  SELECT qid, cid, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS place FROM sc) WHERE place <= 5""")
def tx4_resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX4, FN Fuzzy text: names by words, prefixes and single edits, every fiftieth part as a query."""
    return S.resolve_names(rows_of(spark, sf_dir, _ASKED), rows_of(spark, sf_dir, _NAMES))


_SIGNED = "SELECT c_custkey AS entry, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 400 END AS user_id, concat('  Person ', c_custkey % 90, ' ') AS ident FROM {customer}"


@query(f"SELECT entry, lower(trim(regexp_replace(ident, '\\s+', ' ', 'g'))) AS player_key, count(*) OVER (PARTITION BY coalesce('u:' || user_id, 'n:' || lower(trim(ident)))) AS same_person FROM ({_SIGNED})")
def uf_person_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UF rph_person_key, UF scout_player_key, PRJ18: keys of people; the keyed hash itself is tested by itself, here by what it groups."""
    keyed = rows_of(spark, sf_dir, _SIGNED).withColumn("person", keys.person_key("user_id", "ident", "a secret"))
    return keyed.select("entry", keys.player_key("ident").alias("player_key"), F.expr("count(*) OVER (PARTITION BY person)").alias("same_person"))


_ENTRIES = "SELECT o_orderkey AS entry, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 9 - 1 AS INT) END AS place, CAST(o_custkey % 3 - 1 AS INT) AS matches_won, CASE WHEN o_custkey % 2 = 0 THEN 0 END AS matches_lost, CAST(NULL AS INT) AS matches_drawn FROM {orders}"


@query(f"SELECT entry, coalesce(place >= 0, false) OR coalesce(matches_won > 0, false) OR coalesce(matches_lost > 0, false) AS played FROM ({_ENTRIES})")
def prj6_played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6: entries that were played."""
    return rows_of(spark, sf_dir, _ENTRIES).select("entry", keys.played().alias("played"))


#: Accounts two by two of like names: the same words turned round, one letter more, or another end.
_ACCOUNTS = """SELECT CAST(o_custkey AS BIGINT) AS player_id, CASE o_custkey % 6 WHEN 0 THEN concat(w1, ' ', w2) WHEN 1 THEN concat(upper(w2), '_', w1) WHEN 2 THEN concat(w1, w2) WHEN 3 THEN concat(w1, 'e ', w2) WHEN 4 THEN concat(w1, '.', w2) ELSE concat(w1, ' ', w2, 'xyz') END AS name,
  CASE WHEN o_custkey % 2 = 0 THEN 'melee' ELSE 'rph' END AS platform
  FROM (SELECT o_custkey, lower(hex((o_custkey - o_custkey % 2) * 7919 % 1048576)) AS w1, lower(hex((o_custkey - o_custkey % 2 + 11) * 104729 % 16777216)) AS w2 FROM (SELECT DISTINCT o_custkey FROM {orders}) d) x"""
_NAMED = """SELECT CAST(o_custkey AS BIGINT) AS player_id, concat(CASE WHEN o_custkey % 2 = 0 THEN 'Anna ' ELSE 'anna-' END, CASE WHEN o_custkey % 3 = 0 THEN 'BERG' ELSE 'Berg' END, ' ', o_custkey % 197) AS name, CASE WHEN o_custkey % 5 = 0 THEN 'melee' ELSE 'rph' END AS platform FROM (SELECT DISTINCT o_custkey FROM {orders}) x
  UNION ALL SELECT CAST(-1 - s_suppkey AS BIGINT), CASE WHEN s_suppkey % 2 = 0 THEN '--' ELSE concat('Solo ', s_suppkey) END, 'rph' FROM {supplier}"""
_PLAYED = "SELECT CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 40 END AS store, o_custkey AS player1_id, CASE WHEN o_orderkey % 9 <> 0 THEN (o_custkey + 197 * (o_orderkey % 5)) % 1500 END AS player2_id FROM {orders}"
_KEY = "regexp_replace(lower(name), '[^a-z0-9]', '', 'g')"


#: Beside them a second account of each customer, its words turned for some, on whatever platform; what each entered.
_LINKED = f"""{_NAMED} UNION ALL
  SELECT CAST(-1000000000 - o_custkey AS BIGINT), concat(CASE WHEN o_custkey % 3 = 0 THEN 'Mr. ' ELSE '' END, CASE WHEN o_custkey % 2 = 0 THEN 'anna  berg' ELSE 'Berg Anna' END, ' ', o_custkey % 97), CASE WHEN o_custkey % 5 = 0 THEN 'melee' ELSE 'rph' END FROM (SELECT DISTINCT o_custkey FROM {{orders}}) x"""
_MET = "SELECT o_orderkey % 300 AS event_id, CAST(o_custkey AS BIGINT) AS player_id FROM {orders} UNION ALL SELECT o_orderkey % 300, CAST(-1000000000 - o_custkey AS BIGINT) FROM {orders}"
_TOKENS = "array_to_string(list_sort(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '')), ' ')"


@query(f"""WITH a AS (SELECT *, {_KEY} AS k, {_TOKENS} AS w FROM ({_LINKED}) WHERE {_KEY} <> ''), m AS (SELECT DISTINCT event_id, player_id FROM ({_MET})),
  p AS (SELECT x.player_id AS a, y.player_id AS b, x.name = y.name AS exact, x.k = y.k AND x.platform <> y.platform AS other FROM a x JOIN a y ON x.k = y.k AND x.player_id <> y.player_id
    UNION ALL SELECT x.player_id, y.player_id, FALSE, FALSE FROM a x JOIN a y ON x.w = y.w AND x.k <> y.k),
  v AS (SELECT DISTINCT p.a, p.b FROM p JOIN m s ON s.player_id = p.a JOIN m t ON t.player_id = p.b AND t.event_id = s.event_id),
  n AS (SELECT p.a, count(*) AS n_links, count(*) FILTER (exact) AS n_exact, count(*) FILTER (other) AS n_other, count(*) FILTER (v.a IS NULL) AS n_possible, coalesce(bool_or(exact AND other), FALSE) AS shown FROM p LEFT JOIN v ON v.a = p.a AND v.b = p.b GROUP BY p.a)
  SELECT a.player_id, min(a.player_id) OVER (PARTITION BY a.k) AS class_id, min(a.player_id) OVER (PARTITION BY a.w) AS words_id, a.platform, CASE WHEN shown THEN 'exact' WHEN n_other > 0 THEN 'normalized' END AS evidence,
    CASE WHEN shown THEN 1.0::DOUBLE WHEN n_other > 0 THEN 0.95 END AS confidence, n_other, n_links, n_exact, n_possible FROM a JOIN n ON n.a = a.player_id""")
def el12_alias_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL12: accounts whose name others have too, of any platform and in any order of words, with their classes and how many of them they can be."""
    return P.linked_accounts(rows_of(spark, sf_dir, _LINKED), rows_of(spark, sf_dir, _MET))


@query(f"""WITH a AS (SELECT *, platform || '|' || {_KEY} AS k FROM ({_NAMED}) WHERE {_KEY} <> ''), m AS ({_PLAYED}), s AS (SELECT store, player1_id AS p, player2_id AS o FROM m UNION ALL SELECT store, player2_id, player1_id FROM m WHERE player2_id IS NOT NULL),
  n AS (SELECT p, count(*) AS n FROM s GROUP BY p), b AS (SELECT a.*, first_value(player_id) OVER (PARTITION BY k ORDER BY coalesce(n, 0) DESC, player_id) AS t FROM a LEFT JOIN n ON n.p = a.player_id),
  c AS (SELECT player_id, t FROM b WHERE player_id <> t AND NOT EXISTS (SELECT 1 FROM s WHERE s.p = b.player_id AND s.o = b.t)),
  d AS (SELECT player_id, t, (SELECT count(DISTINCT x.store) FROM s x WHERE x.p = c.player_id AND x.store IN (SELECT store FROM s y WHERE y.p = c.t AND y.store IS NOT NULL)) AS shared_stores,
    (SELECT count(DISTINCT x.o) FROM s x WHERE x.p = c.player_id AND x.o IN (SELECT o FROM s y WHERE y.p = c.t AND y.o IS NOT NULL)) AS shared_opponents FROM c)
  SELECT player_id, t AS primary_id, CASE WHEN shared_stores > 0 OR shared_opponents >= 2 THEN 0.9::DOUBLE ELSE 0.5 END AS confidence, shared_stores, shared_opponents FROM d""")
def el12_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL12: accounts of one platform and name beside the busiest of them, but those that played it."""
    return P.collisions(rows_of(spark, sf_dir, _NAMED), rows_of(spark, sf_dir, _PLAYED))


@query()
def el12_similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL12, FN Fuzzy text: the three most similar names of the other platform, of a matching-block ratio of 0.85 or more; a test holds it against all pairs."""
    return P.similar_names(rows_of(spark, sf_dir, _ACCOUNTS), "melee", "rph")
