"""Search, imports, maps, calendars and catalogues over the folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions import text, titles
from tradewind.operators import catalog as C
from tradewind.operators import search as S
from tradewind.plans.registered import query
from tradewind.sinks.decks import COLUMNS, KEYS, import_decks
from tradewind.sinks.shared import shared_path, staged
from tradewind.sinks.versions import VersionedTable
from tradewind.sources.views import rows_of, view

_ACC, _FOLD = text.ACCENTED, text.FOLDED


def _key(name: str) -> str:
    return f"regexp_replace(replace(translate(lower(coalesce({name}, '')), '{_ACC}', '{_FOLD}'), '&', 'and'), '[^a-z0-9]', '', 'g')"


_LINE = r"^(\d{1,3})\s*[x×]?\s*(?:-\s*)?(.+?)\s*$"
_DECKS = rf"""lines AS (SELECT deck_id, ord, trim(raw) AS line FROM (SELECT deck_id, unnest(string_split(coalesce(decklist, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(decklist, ''), chr(10)), 1) AS ord FROM {{decklists}})),
  parsed AS (SELECT *, CASE WHEN regexp_matches(line, '{_LINE}', 'i') THEN CAST(regexp_extract(line, '{_LINE}', 1, 'i') AS INTEGER) END AS qty FROM lines WHERE line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '//%'),
  keyed AS (SELECT *, CASE WHEN qty > 0 THEN {_key(f"regexp_extract(line, '{_LINE}', 2, 'i')")} END AS k FROM parsed),
  main AS (SELECT set_id FROM {{cards}} GROUP BY set_id HAVING count(*) >= 80),
  cand AS (SELECT card_id, ink, {_key("name")} AS k, CASE WHEN set_id IN (FROM main) THEN 100 ELSE 0 END - CASE WHEN rarity IN ('Enchanted', 'Iconic', 'Epic') OR (set_id IN (FROM main) AND collector_number > 204) THEN 80 ELSE 0 END AS score FROM {{cards}}),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, card_id) AS r FROM cand WHERE k <> '') WHERE r = 1),
  hit AS (SELECT q.*, b.card_id, b.ink FROM keyed q LEFT JOIN best b ON b.k = q.k),
  per AS (SELECT deck_id, card_id, CAST(sum(qty) AS BIGINT) AS qty, min(ord) AS ord, arg_min(line, ord) AS line FROM hit WHERE card_id IS NOT NULL GROUP BY ALL),
  a AS (SELECT deck_id, count(*) AS lines, string_agg(line, chr(10) ORDER BY ord) FILTER (card_id IS NULL) AS unmatched, string_agg(DISTINCT ink, ',' ORDER BY ink) AS inks FROM hit GROUP BY deck_id),
  e AS (SELECT deck_id, CAST(sum(qty) AS BIGINT) AS total, string_agg(qty || ' ' || card_id, chr(10) ORDER BY ord) AS entries, string_agg(line || ' (' || qty || ' in all)', chr(10) ORDER BY ord) FILTER (qty > 4) AS over_cap FROM per GROUP BY deck_id),
  resolved AS (SELECT d.deck_id, coalesce(lines, 0) AS lines, coalesce(total, 0) AS total, coalesce(entries, '') AS entries, coalesce(unmatched, '') AS unmatched, coalesce(over_cap, '') AS over_cap, coalesce(inks, '') AS inks
    FROM {{decklists}} d LEFT JOIN a ON a.deck_id = d.deck_id LEFT JOIN e ON e.deck_id = d.deck_id)"""


@query(f"WITH {_DECKS} SELECT * FROM resolved")
def tx1_decklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX1, JN15, JN16, WN10, AG5, UF import_card_key: decklists of all decks resolved in one pass."""
    return C.resolve_decklists(view(spark, sf_dir, "decklists"), view(spark, sf_dir, "cards"), mainline=80)


@query(f"""WITH {_DECKS}, p AS (SELECT deck_id, trim(place) AS place, regexp_replace(lower(coalesce(place, '')), '[^a-z0-9]', '', 'g') AS k FROM {{decklists}}),
  r AS (SELECT *, CASE WHEN regexp_matches(k, '^(?:top|t)?([0-9]+)(?:th|st|nd|rd)?$') THEN CAST(regexp_extract(k, '^(?:top|t)?([0-9]+)(?:th|st|nd|rd)?$', 1) AS INTEGER) END AS place_rank FROM p)
  SELECT deck_id, place_rank, concat_ws('; ', CASE WHEN place_rank IS NULL THEN 'unreadable place ' || coalesce(nullif(place, ''), 'none') END, CASE WHEN unmatched <> '' THEN 'unmatched lines' END, CASE WHEN total = 0 THEN 'empty decklist' END) AS problems
  FROM r JOIN resolved USING (deck_id)""")
def tx2_import_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX2, PRJ17: what a dry run of an import finds wrong with each deck."""
    decks = view(spark, sf_dir, "decklists")
    return C.import_problems(decks, C.resolve_decklists(decks, view(spark, sf_dir, "cards"), mainline=80))


@query(f"""WITH {_DECKS}, p AS (SELECT deck_id, regexp_replace(lower(coalesce(place, '')), '[^a-z0-9]', '', 'g') AS k FROM {{decklists}}),
  good AS (SELECT deck_id FROM p JOIN resolved USING (deck_id) WHERE regexp_matches(k, '^(?:top|t)?([0-9]+)(?:th|st|nd|rd)?$') AND unmatched = '' AND total > 0)
  SELECT CAST(deck_id AS BIGINT) AS deck_id, card_id, qty AS quantity FROM per WHERE deck_id IN (FROM good)""")
def tx2_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX2, SNK1: the decks without problems committed to a stored table, in two imports that each run twice."""
    decks, cards = staged(view(spark, sf_dir, "decklists"), "decklists"), view(spark, sf_dir, "cards")
    table = VersionedTable(spark, shared_path(spark, "imported"), COLUMNS, KEYS)
    resolved = staged(C.resolve_decklists(decks, cards, mainline=80), "resolved")
    problems = C.import_problems(decks, resolved)
    for number, half in enumerate((F.col("deck_id") % 2 == 0, F.col("deck_id") % 3 != 1, F.col("deck_id") % 2 == 1)):
        for _ in range(2):
            import_decks(table, resolved.where(half), problems.where(half), number)
    return table.rows()


_QUERIES = "SELECT doc_id AS qid, concat(coalesce(text, ''), ' ', CAST(doc_id % 40 AS STRING), '/204') AS text FROM {documents} WHERE doc_id % 50 = 0"
_TARGETS = "SELECT item_id AS cid, text, CAST(item_id AS INT) AS number FROM {benchmark}"


@query(rf"""WITH q AS ({_QUERIES}), c AS ({_TARGETS}), held AS (SELECT DISTINCT cid, w FROM (SELECT cid, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM c) WHERE length(w) >= 3),
  idf AS (SELECT w, ln(1 + (SELECT count(*) FROM c) / count(*)) AS idf FROM held GROUP BY w), asked AS (SELECT DISTINCT qid, w FROM (SELECT qid, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM q) WHERE length(w) >= 3),
  s AS (SELECT qid, cid, round(sum(idf), 6) AS s FROM asked JOIN held USING (w) JOIN idf USING (w) GROUP BY ALL),
  b AS (SELECT DISTINCT qid, cid FROM (SELECT qid, unnest(regexp_extract_all(text, '\b(\d+)\s*/\s*\d+\b', 1)) AS n FROM q) x JOIN c ON CAST(c.number AS VARCHAR) = x.n),
  r AS (SELECT s.qid, s.cid, round(s + CASE WHEN b.qid IS NOT NULL THEN 6 ELSE 0 END, 6) AS score FROM s LEFT JOIN b ON b.qid = s.qid AND b.cid = s.cid)
  SELECT qid, cid, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS place FROM r) WHERE place <= 8""")
def tx5_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX5: the benchmark passages that share the rarest words with a document, every fiftieth as a query."""
    return S.token_match(rows_of(spark, sf_dir, _QUERIES), rows_of(spark, sf_dir, _TARGETS))


_VERSIONS = "SELECT CAST(conv_id AS STRING) AS name, CAST(turn AS STRING) AS version, text FROM {conversations}"
_READ = "SELECT conv_id * 100 + turn AS qid, CAST(conv_id AS STRING) AS name, replace(replace(text, 'ou', 'u'), 'th', 'h') AS text FROM {conversations}"


@query(f"""WITH q AS (SELECT qid, name, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS q FROM (SELECT qid, name, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM ({_READ}))),
  v AS (SELECT name, version, CASE WHEN length(t) >= 3 THEN list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) ELSE [] END AS v FROM (SELECT name, version, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM ({_VERSIONS}))),
  s AS (SELECT qid, version, max(CAST(len(list_intersect(q, v)) AS DOUBLE) / len(q)) AS score FROM q JOIN v USING (name) WHERE len(q) >= 12 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, version DESC) AS k, lead(score) OVER (PARTITION BY qid ORDER BY score DESC, version DESC) AS second FROM s)
  SELECT qid, version, round(score, 6) AS score, round(score - second, 6) AS margin FROM r WHERE k = 1 AND score >= 0.22 AND score - second >= 0.12""")
def tx6_trigram_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX6, FN Fuzzy text: the turn of a conversation that a misread text comes from, or none."""
    return S.trigram_version(rows_of(spark, sf_dir, _READ), rows_of(spark, sf_dir, _VERSIONS))


_LISTS = """SELECT l_orderkey AS qid, 1 AS list_no, 1.0E0 AS weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS place, l_partkey AS id FROM {lineitem}
  UNION ALL SELECT l_orderkey, 2, 0.5E0, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_suppkey), l_partkey FROM {lineitem}"""


@query(f"SELECT qid, id, round(sum(weight / (60 + place)), 9) AS score FROM ({_LISTS}) GROUP BY ALL")
def tx7_fused_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX7: two rankings of each order's parts fused by reciprocal ranks."""
    return S.fused(rows_of(spark, sf_dir, _LISTS))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_transform(embedding, lambda x: x > 0) AS b FROM {embeddings}), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
  s AS (SELECT q.vec_id AS qid, v.vec_id, round(list_dot_product(q.e, v.e), 6) AS score, CAST(len(list_filter(list_zip(q.b, v.b), lambda z: z[1] <> z[2])) AS INTEGER) AS ham FROM q, v),
  w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 25),
  b AS (SELECT qid, vec_id, score, ham, round(score / max(score) OVER (PARTITION BY qid) - 0.12 * ham / 64, 6) AS blended FROM w)
  SELECT qid, vec_id, score, ham, blended, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY blended DESC, vec_id) AS place FROM b) WHERE place <= 5""")
def vx1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VX1: the five nearest vectors of every fiftieth one, by dot product and signs."""
    sign = "aggregate(sequence(0, 63), 0L, (a, i) -> a | CASE WHEN embedding[i] > 0 THEN shiftleft(1L, i) ELSE 0L END)"
    vectors = view(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", f"{sign} AS bits")
    return S.nearest_vectors(vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid"), vectors)


_MILES = "3958.8::DOUBLE * 2 * asin(least(1, sqrt(power(sin(radians(latitude - 40.5) / 2), 2) + cos(radians(40.5)) * cos(radians(latitude)) * power(sin(radians(longitude + 74.5) / 2), 2))))"


@query(f"""WITH n AS (SELECT *, {_MILES} AS dist, (start_datetime AT TIME ZONE 'UTC') AT TIME ZONE CASE WHEN timezone IN ('America/New_York', 'Europe/Paris', 'UTC') THEN timezone ELSE 'UTC' END AS local_ts FROM {{places}}
    WHERE start_datetime >= TIMESTAMP '1998-01-01' AND latitude BETWEEN 40.5 - 60 / 69.0 AND 40.5 + 60 / 69.0),
  k AS (SELECT *, coalesce(CAST(store_id AS VARCHAR), 'addr:' || full_address || '|' || city) || '|' || kind || '|' || coalesce(gameplay_format, '-') || '|' || dayofweek(local_ts) || '|' || strftime(local_ts, '%H:%M') AS series_key FROM n WHERE dist <= 60),
  g AS (SELECT series_key, arg_min(kind, (start_datetime, event_id)) AS kind, arg_min(name, (start_datetime, event_id)) AS name, arg_min(city, (start_datetime, event_id)) AS city, CAST(min(dayofweek(local_ts)) AS INTEGER) AS dow, min(strftime(local_ts, '%H:%M')) AS local_time,
    round(min(dist), 3) AS distance_mi, CAST(count(*) AS INTEGER) AS n_occurrences, min(start_datetime) AS next_start, array_to_string(list(event_id ORDER BY start_datetime, event_id)[1:2], ',') AS occurrences FROM k GROUP BY series_key)
  SELECT * FROM g ORDER BY next_start, distance_mi, series_key LIMIT 400""")
def gx1_nearby_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GX1, JN14, PRJ18, AG3, AG6, SR1, SR6, UF safe_local_ts: events within 60 miles as series (the nearest 400 dates are the report)."""
    return C.nearby_series(view(spark, sf_dir, "places"), 40.5, -74.5, "1998-01-01 00:00:00", 60.0, most=2)


_TOWNS = "SELECT event_id AS place_id, city, CASE WHEN store_id % 2 = 0 THEN 'NY' END AS state, CASE WHEN event_id % 3 = 0 THEN 'US' ELSE 'CA' END AS country, latitude, longitude FROM {places}"
_APART = "3958.8E0 * 2 * asin(least(1.0E0, sqrt(power(sin(radians(o.latitude - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(o.latitude)) * power(sin(radians(o.longitude - x.lon) / 2), 2))))"


@query(f"""WITH RECURSIVE r AS (SELECT lower(trim(city)) AS norm, coalesce(state, '') AS state, coalesce(country, '') AS country, arg_min(trim(city), place_id) AS city, arg_min(latitude, place_id) AS latitude, arg_min(longitude, place_id) AS longitude FROM ({_TOWNS}) GROUP BY 1, 2, 3),
  o AS (SELECT *, row_number() OVER (ORDER BY norm <> 'town 7', country <> 'US', length(norm), norm, state, country) AS k FROM r),
  g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(k BIGINT, lat DOUBLE, lon DOUBLE)[]) AS kept UNION ALL
    SELECT o.k, CASE WHEN len(kept) < 8 AND len(list_filter(kept, lambda x: {_APART} < 15)) = 0 THEN list_append(kept, struct_pack(k := o.k, lat := o.latitude, lon := o.longitude)) ELSE kept END FROM g JOIN o ON o.k = g.k + 1)
  SELECT CAST(row_number() OVER (ORDER BY o.k) AS INTEGER) AS place, city, state, country, latitude, longitude FROM (SELECT unnest(kept).k AS k FROM (SELECT arg_max(kept, k) AS kept FROM g)) s JOIN o ON o.k = s.k""")
def gx3_ranked_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GX3, SR8: towns for a search, the best first and none within 15 miles of a better one (eight are the report)."""
    return C.ranked_places(rows_of(spark, sf_dir, _TOWNS), "Town 7", "us")


_CURATED = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'set' ELSE 'product' END AS kind, concat('T', o_custkey % 300) AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'stores' ELSE 'retail' END AS subtitle, CAST(o_orderdate AS DATE) AS starts_on, o_orderkey % 5 <> 0 AS confirmed FROM {orders} WHERE o_orderstatus = 'F'"
_DERIVED = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'set' ELSE 'product' END AS kind, concat('T', o_custkey % 300) AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'stores' ELSE 'retail' END AS subtitle, CAST(o_orderdate AS DATE) AS starts_on FROM {orders} WHERE o_orderstatus = 'P'"


@query(f"""WITH c AS (SELECT * EXCLUDE (confirmed) FROM ({_CURATED}) WHERE confirmed AND starts_on BETWEEN DATE '1998-03-01' AND DATE '1998-03-31')
  SELECT *, 'curated' AS source FROM c UNION ALL SELECT *, 'derived' FROM ({_DERIVED}) d WHERE starts_on BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.kind = d.kind AND c.title = d.title AND (d.kind <> 'set' OR c.subtitle IS NOT DISTINCT FROM d.subtitle))""")
def cx1_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CX1, JN10, ST1: a calendar of curated rows and the derived ones they don't cover."""
    return C.merged_calendar(rows_of(spark, sf_dir, _CURATED), rows_of(spark, sf_dir, _DERIVED), "1998-03-01", 30)


_ADDED = "SELECT p_brand AS set_id, concat(p_name, ' - ', CAST(p_size % 20 AS STRING)) AS label, CASE WHEN p_partkey % 50 <> 0 THEN CAST(DATE '2001-01-01' + CAST(p_partkey % 300 AS INT) AS DATE) END AS added FROM {part}"


@query(f"""SELECT arg_max(set_id, (added, set_id)) FILTER (added > DATE '2001-06-01' AND added <= DATE '2001-10-20') AS set_id, label, max(added) FILTER (added > DATE '2001-06-01' AND added <= DATE '2001-10-20') AS last_added
  FROM ({_ADDED}) GROUP BY label HAVING NOT bool_or(added IS NULL OR added <= DATE '2001-06-01') AND count(*) FILTER (added > DATE '2001-06-01' AND added <= DATE '2001-10-20') > 0""")
def cx2_new_reveals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CX2: names first added inside a window."""
    return C.new_reveals(rows_of(spark, sf_dir, _ADDED), "2001-06-01", "2001-10-20")


_WANTED = "SELECT c_custkey AS wid, CAST(DATE '1998-01-01' + CAST(c_custkey % 300 AS INT) AS DATE) AS day, concat('Store', c_custkey % 90, ' malmogameweek Championship d', c_custkey % 30) AS name FROM {customer}"
_HELD = "SELECT o_orderkey AS eid, CAST(o_orderdate AS DATE) AS day, concat('Championship ', CASE WHEN o_orderkey % 5 = 0 THEN 'Malmö' WHEN o_orderkey % 5 = 1 THEN 'Week' ELSE 'Other' END, ' d', o_orderkey % 30, ' store', o_orderkey % 90) AS name FROM {orders}"
_TOK = f"list_filter(list_distinct(regexp_split_to_array(strip_accents(lower(name)), '[^a-z0-9]+')), lambda w: w NOT IN {C.CALENDAR_STOP} AND (length(w) >= 4 OR (length(w) >= 3 AND regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '^[0-9]+$'))))"


@query(f"""WITH w AS (SELECT wid, day, {_TOK} AS w FROM ({_WANTED})), h AS (SELECT eid, day, {_TOK} AS h FROM ({_HELD})), j AS (SELECT wid, eid, unnest(w) AS x, h FROM w JOIN h ON abs(w.day - h.day) <= 1),
  e AS (SELECT wid, eid, x FROM j WHERE list_contains(h, x) OR (length(x) >= 5 AND len(list_filter(h, lambda y: contains(y, x) OR (length(y) >= 5 AND contains(x, y)))) > 0))
  SELECT wid, eid, string_agg(x, ',' ORDER BY x) AS evidence FROM e GROUP BY ALL""")
def cx3_linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CX3, JN17: calendar rows linked to events by a day more or less and distinctive words."""
    return C.linked_events(rows_of(spark, sf_dir, _WANTED), rows_of(spark, sf_dir, _HELD))


_FEED = "SELECT o_orderkey AS list_id, o_custkey % 200 AS owner, o_orderkey % 6 <> 0 AS is_public, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 50 END AS likes, o_orderdate AS updated_at FROM {orders}"


@query(f"""SELECT list_id, owner, is_public, likes, updated_at FROM ({_FEED}) WHERE is_public AND owner IN (SELECT s_suppkey FROM {{supplier}}) AND updated_at < TIMESTAMP '1999-01-01' ORDER BY likes DESC NULLS LAST, updated_at DESC, list_id LIMIT 60""")
def cx4_list_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CX4, SR1, SR2, SR3, JN9: a page of the most liked public lists of followed owners."""
    followed = view(spark, sf_dir, "supplier").selectExpr("s_suppkey AS owner")
    return C.list_feed(rows_of(spark, sf_dir, _FEED), "liked", "1999-01-01 00:00:00", followed, 60)


_OPTIONS = "SELECT n_nationkey AS poll, o.option FROM {nation} CROSS JOIN (SELECT 0 AS option UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 9) o"
_VOTES = "SELECT c_nationkey AS poll, CAST(c_custkey % 3 AS INT) AS option FROM {customer}"


@query(f"""WITH n AS (SELECT o.poll, o.option, count(v.poll) AS n FROM ({_OPTIONS}) o LEFT JOIN ({_VOTES}) v ON v.poll = o.poll AND v.option = o.option GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY poll) AS BIGINT) AS total FROM n)
  SELECT poll, option, n, CASE WHEN total > 0 THEN CAST((2000 * n + total) // (2 * total) AS DOUBLE) / 10 END AS percent FROM t""")
def cx5_poll_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CX5, AG12: shares of every option, also without votes."""
    return C.poll_shares(rows_of(spark, sf_dir, _OPTIONS), rows_of(spark, sf_dir, _VOTES))


_CAT_A = "SELECT p_partkey AS key, p_name AS name FROM {part} WHERE p_size <> 3"
_CAT_B = "SELECT p_partkey AS key, CASE WHEN p_size = 7 THEN upper(p_name) ELSE p_name END AS name FROM {part} WHERE p_size <> 5"
_CAT_OLD = "SELECT CASE WHEN p_size = 3 THEN 'missing' ELSE 'extra' END AS kind, p_partkey AS key FROM {part} WHERE p_size IN (3, 5) AND p_brand <= 'Brand#2'"


@query(f"""WITH b AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'missing' WHEN b.key IS NULL THEN 'extra' WHEN a.name IS DISTINCT FROM b.name THEN 'renamed' END AS kind FROM ({_CAT_A}) a FULL JOIN ({_CAT_B}) b ON a.key = b.key)
  SELECT kind, key, (kind, key) NOT IN (SELECT kind, key FROM ({_CAT_OLD})) AS is_new FROM b WHERE kind IS NOT NULL""")
def cx6_catalogue_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CX6, JN18, JN19, ST3: differences of two catalogues, and which of them the last report didn't have."""
    return C.catalogue_findings(*(rows_of(spark, sf_dir, q) for q in (_CAT_A, _CAT_B, _CAT_OLD)))


_SRC = "SELECT printing AS name, price_date AS day FROM {prices}"
_DER = "SELECT printing AS name, price_date AS day FROM {prices} WHERE market IS NOT NULL AND printing <> 'Holofoil'"


@query(f"""SELECT s.name, s.d AS source_day, t.d AS derived_day, CAST(s.d - t.d AS INTEGER) AS lag_days, CAST(DATE '2001-12-01' - s.d AS INTEGER) AS age_days FROM (SELECT name, max(day) AS d FROM ({_SRC}) GROUP BY name) s LEFT JOIN (SELECT name, max(day) AS d FROM ({_DER}) GROUP BY name) t USING (name)""")
def cx7_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CX7: how far derived tables lag behind their sources, and the sources' age."""
    return C.freshness(rows_of(spark, sf_dir, _DER), rows_of(spark, sf_dir, _SRC), "2001-12-01")


def _rx(pattern: str) -> str:
    """A pattern for DuckDB's engine, which has no look-ahead."""
    if "pins(?=" in pattern:
        pattern = pattern.replace(r"|pins(?=\s*:)", "") + r"|(?i)\bpins\s*:"
    return pattern.replace("'", "''")


_T = {n: _rx(getattr(titles, n)) for n in ("OTHER_GAME", "LOT", "MULTIPLIER", "SWORD", "CONNECTOR", "GRADED_TOKEN", "SEALED", "ACCESSORY", "RAW", "GRADER_FIRST", "GRADE_FIRST", "FOREIGN_WORD", "FOREIGN_CODE", "GERMAN_LETTER", "GERMAN_TAG", "DE_VIL", "TROLL", "AUTOGRAPH", "NON_FOIL", "PRIZE_WALL", "INFINITY_WEEKEND", "TOP_PRIZE", "CHALLENGE")}


def _m(name: str, column: str = "title") -> str:
    return f"regexp_matches({column}, '{_T[name]}')"


def _titles_sql() -> str:
    body = f"""SELECT item_id, CASE WHEN {_m("OTHER_GAME")} THEN 'EXCLUDE_OTHER_TCG' WHEN {_m("LOT")} OR ({_m("MULTIPLIER")} AND NOT {_m("SWORD")}) OR ({_m("CONNECTOR")} AND len(regexp_extract_all(title, '{_T["GRADED_TOKEN"]}')) >= 2) THEN 'EXCLUDE_LOT'
      WHEN {_m("SEALED")} THEN 'EXCLUDE_SEALED' WHEN {_m("ACCESSORY")} THEN 'EXCLUDE_ACCESSORY' WHEN {_m("RAW")} THEN 'EXCLUDE_RAW' WHEN {_m("GRADER_FIRST")} OR {_m("GRADE_FIRST")} THEN 'GRADED' ELSE 'NEEDS_GRADE' END AS kind,
      replace(upper(CASE WHEN {_m("GRADER_FIRST")} THEN regexp_extract(title, '{_T["GRADER_FIRST"]}', 1) WHEN {_m("GRADE_FIRST")} THEN regexp_extract(title, '{_T["GRADE_FIRST"]}', 2) END), 'BECKETT', 'BGS') AS grader,
      CASE WHEN {_m("GRADER_FIRST")} THEN regexp_extract(title, '{_T["GRADER_FIRST"]}', 2) WHEN {_m("GRADE_FIRST")} THEN regexp_extract(title, '{_T["GRADE_FIRST"]}', 1) END AS grade,
      CASE WHEN {_m("GERMAN_LETTER")} OR {_m("FOREIGN_WORD")} OR {_m("FOREIGN_CODE")} OR ({_m("GERMAN_TAG")} AND NOT {_m("DE_VIL")}) THEN 'foreign' WHEN {_m("TROLL")} THEN 'troll' WHEN {_m("AUTOGRAPH")} THEN 'auto' END AS exclude_reason,
      CASE WHEN {_m("NON_FOIL", "lower(title)")} THEN 'Non-Foil' WHEN contains(lower(title), 'cold foil') THEN 'Cold Foil' WHEN contains(lower(title), 'foil') OR contains(lower(title), 'holo') THEN 'Foil'
        WHEN {_m("PRIZE_WALL", "lower(title)")} OR {_m("INFINITY_WEEKEND", "lower(title)")} THEN 'Non-Foil' WHEN {_m("TOP_PRIZE", "lower(title)")} AND {_m("CHALLENGE", "lower(title)")} THEN 'Foil' END AS printing,
      CASE {" ".join("WHEN " + " OR ".join(f"contains(lower(title), '" + p.replace("'", "''") + "')" for p in parts) + " THEN '" + kind.replace("'", "''") + "'" for kind, parts in titles.SEALED_KINDS)} ELSE 'Promo Single' END AS sealed_kind FROM titles"""
    from tradewind.sources.views import with_views

    # patterns hold braces, so the views are put in front by hand
    return with_views("SELECT * FROM {titles}").replace("SELECT * FROM titles", body)


def prj13_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12, PRJ13, PRJ14, PRJ15: what listing titles say."""
    columns = {"kind": titles.title_kind(), "grader": titles.grader(), "grade": titles.grade(), "exclude_reason": titles.exclude_reason(), "printing": titles.finish(), "sealed_kind": titles.sealed_kind("title")}
    return titles.read_once(view(spark, sf_dir, "titles").select("item_id", "title"), columns).drop("title")


_GRADERS = " ".join(f"WHEN regexp_matches(upper(title), '\\b{g}\\b') THEN '{'BGS' if g == 'BECKETT' else g}'" for g in titles.GRADER.split("|"))
_VARIANTS = "SELECT concat('crd_', p_partkey) AS card_id, CASE WHEN p_partkey % 2 = 0 THEN 'Two Swords' ELSE 'Prize' END AS variant, CASE WHEN p_partkey % 2 = 0 THEN '2x\\\\s*sword' ELSE 'psa 10' END AS pattern FROM {part} WHERE p_partkey % 7 = 0"


def _graders_sql() -> str:
    titles_sql = _titles_sql()
    head, body = titles_sql.rsplit("SELECT item_id,", 1)
    return f"""{head}SELECT t.item_id, CASE k.kind WHEN 'GRADED' THEN coalesce(k.grader, t.file_grader) WHEN 'NEEDS_GRADE' THEN coalesce(CASE {_GRADERS} END, t.file_grader) END AS grader,
      CASE WHEN v.card_id IS NULL THEN k.printing WHEN regexp_matches(title, v.pattern, 'i') THEN v.variant ELSE 'Normal' END AS printing
      FROM (SELECT *, CASE WHEN card_id % 3 <> 0 THEN 'TAG' END AS file_grader FROM titles) t JOIN (SELECT item_id AS id, min(kind) AS kind, min(grader) AS grader, min(printing) AS printing FROM (SELECT item_id,{body}) x GROUP BY item_id) k ON k.id = t.item_id
      LEFT JOIN ({_VARIANTS.replace("{part}", "part").replace(chr(92) * 2, chr(92))}) v ON v.card_id = 'crd_' || t.card_id"""


def prj14_listing_printings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ13, PRJ14: the grader of each listing, also without a grade, and its printing, a named variant of its card first."""
    rows = view(spark, sf_dir, "titles").withColumns({"file_grader": F.when(F.col("card_id") % 3 != 0, "TAG"), "card_id": F.concat(F.lit("crd_"), F.col("card_id").cast("string"))})
    rows = titles.read_once(rows.select("item_id", "card_id", "title", "file_grader"), {"finish": titles.finish(), "kind": titles.title_kind(), "beside": titles.grader(), "named": titles.named_grader()})
    found = titles.printings(rows, rows_of(spark, sf_dir, _VARIANTS), said=F.col("finish"))
    grader = F.when(F.col("kind") == "GRADED", F.coalesce("beside", "file_grader")).when(F.col("kind") == "NEEDS_GRADE", F.coalesce("named", "file_grader"))
    return found.select("item_id", grader.alias("grader"), "printing")


def _register_titles() -> None:
    from tradewind.plans import registered

    registered.QUERIES["prj13_titles"], registered.ORACLES["prj13_titles"] = prj13_titles, _titles_sql()
    registered.QUERIES["prj14_listing_printings"], registered.ORACLES["prj14_listing_printings"] = prj14_listing_printings, _graders_sql()


_register_titles()

_UNMATCHED = """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_partkey) AS item_id, CASE WHEN l_partkey % 9 = 0 THEN l_partkey END AS card_id, CASE WHEN l_suppkey % 8 = 0 THEN 'lot' END AS exclude_reason, CASE WHEN l_suppkey % 7 = 0 THEN 'foreign' END AS reason,
  CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END AS match_id, l_partkey % 8 = 0 AS cn_conflict, CASE WHEN l_linenumber > 1 THEN 10 END AS grade, CASE WHEN l_quantity > 5 THEN l_quantity END AS sale_price FROM {lineitem}"""


@query(f"""SELECT item_id, CASE WHEN card_id IS NOT NULL THEN 'skip:already-attributed' WHEN exclude_reason IS NOT NULL THEN 'skip:has-reason' WHEN reason IS NOT NULL THEN 'reason:' || reason WHEN match_id IS NULL AND cn_conflict THEN 'reason:cn-conflict'
  WHEN match_id IS NULL THEN 'skip:still-unmatched' WHEN grade IS NULL THEN 'attributed:needs-grade' WHEN sale_price IS NULL THEN 'attributed:no-price' ELSE 'attributed' END AS kind FROM ({_UNMATCHED})""")
def mt16_reattributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT16, PRJ16: rails and outcome of each unmatched row."""
    return C.reattributed(rows_of(spark, sf_dir, _UNMATCHED))


_PAIRS = "SELECT deck_id, array(c1.p, c2.p) AS a, array(lower(c1.p), CASE WHEN deck_id % 3 = 0 THEN c2.p ELSE lower(c2.p) END) AS b FROM (SELECT o_orderkey AS deck_id, o_orderpriority AS p FROM {orders}) c1 JOIN (SELECT o_orderkey AS k, o_orderstatus AS p FROM {orders}) c2 ON c2.k = deck_id"


@query(f"""WITH p AS (SELECT unnest(a) AS term, unnest(b) AS translation FROM ({_PAIRS.replace("array(", "list_value(")})), v AS (SELECT term, translation, count(*) AS votes FROM p WHERE term <> '' AND translation <> '' GROUP BY ALL)
  SELECT term, translation, votes FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY votes DESC, translation) AS k FROM v) WHERE k = 1 AND votes >= 2 AND term <> translation""")
def mt9_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT9: translations of terms by their places."""
    return C.glossary(rows_of(spark, sf_dir, _PAIRS), "a", "b")


@query("""WITH w AS (SELECT doc_id AS wid, list_filter(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')), lambda x: length(x) >= 1) AS words FROM {documents} WHERE doc_id % 50 = 0),
  h AS (SELECT item_id AS hid, unnest(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), lambda x: length(x) >= 1)) AS word FROM {benchmark}), u AS (SELECT wid, unnest(words) AS word FROM w),
  s AS (SELECT wid, hid, count(*) AS n FROM u JOIN h USING (word) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY n DESC, hid) AS k FROM s)
  SELECT w.wid, t.hid, coalesce(CAST(n AS DOUBLE) / len(words), 0) AS coverage FROM w LEFT JOIN t ON t.wid = w.wid AND k = 1""")
def mt10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT10: the passage that covers most of a document's words, every fiftieth as a query."""
    wanted = view(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("wid"), text.words("text").alias("words"))
    return C.coverage_match(wanted, view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("hid"), text.words("text").alias("words")))


_NOW = "SELECT p_brand AS bucket, p_partkey AS item FROM {part} WHERE p_size % 5 <> 0 OR p_brand < 'Brand#2'"
_THEN = "SELECT p_brand AS bucket, p_partkey AS item FROM {part} WHERE p_size % 3 <> 0"


@query(f"""WITH n AS ({_NOW}), b AS ({_THEN}), c AS (SELECT bucket, count(*) AS n_now FROM n GROUP BY ALL), d AS (SELECT bucket, count(*) AS n_before FROM b GROUP BY ALL), e AS (SELECT bucket, count(*) AS n_new FROM n WHERE (bucket, item) NOT IN (FROM b) GROUP BY ALL)
  SELECT coalesce(c.bucket, d.bucket) AS bucket, coalesce(n_now, 0) AS n_now, coalesce(n_before, 0) AS n_before, coalesce(n_new, 0) AS n_new, coalesce(n_now, 0) < 0.7 * coalesce(n_before, 0) AS shrank FROM c FULL JOIN d ON c.bucket = d.bucket LEFT JOIN e ON e.bucket = coalesce(c.bucket, d.bucket)""")
def mt11_baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT11: what a source gained and lost by bucket."""
    return C.baseline_diff(rows_of(spark, sf_dir, _NOW), rows_of(spark, sf_dir, _THEN))


_PRINTED = "SELECT c.name, s.set_no, c.card_id, concat(c.rarity, c.ink) AS text FROM {cards} c JOIN {sets} s ON s.set_id = c.set_id WHERE c.ink IS NOT NULL"


@query(f"SELECT name, count(*) AS n_printings, string_agg(card_id, ',' ORDER BY set_no, card_id) AS printings, arg_max(text, (set_no, card_id)) AS text FROM ({_PRINTED}) GROUP BY name")
def mt13_folded_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT13: printings folded by name, the newest one's text."""
    return C.folded_cards(rows_of(spark, sf_dir, _PRINTED))


_RULES = {"tracked": "c_nationkey < 5", "rich": "c_acctbal > 8000", "machine": "c_mktsegment = 'MACHINERY'"}


@query(f"""SELECT c_custkey, concat_ws('+', {", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in _RULES.items())}) AS reason FROM {{customer}} WHERE ({" OR ".join(_RULES.values())}) AND c_custkey NOT IN (SELECT s_suppkey FROM {{supplier}})""")
def mt14_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT14: customers that any of three rules admits, and which, less an exclusion list."""
    out = C.membership(view(spark, sf_dir, "customer"), _RULES, view(spark, sf_dir, "supplier").selectExpr("s_suppkey AS c_custkey"), "c_custkey")
    return out.select("c_custkey", "reason")


_NOTES = "SELECT user_id AS thread, ts AS noted_at FROM {events}"
_SEEN = "SELECT DISTINCT user_id AS thread, TIMESTAMP '2024-01-20 00:00:00' AS seen_at FROM {events} WHERE user_id % 3 <> 0"


@query(f"SELECT thread, count(*) FILTER (noted_at > coalesce(seen_at, TIMESTAMP '1900-01-01')) AS n_unread, max(noted_at) AS last_at FROM ({_NOTES}) LEFT JOIN ({_SEEN}) USING (thread) GROUP BY thread")
def mt15_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT15: unread notes of each thread."""
    return C.unread(rows_of(spark, sf_dir, _NOTES), rows_of(spark, sf_dir, _SEEN))


@query("""SELECT d.deck_id, d.place_rank FROM {decks} d WHERE NOT EXISTS (SELECT 1 FROM {official} o WHERE o.event_id % 9 = d.event_id AND o.place > 28 AND o.place = d.place_rank + 28)""")
def prj10_decks_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10: decks but those that a tournament's lower places hold."""
    low = view(spark, sf_dir, "official").where("place > 28").select((F.col("event_id") % 9).alias("event_id"), (F.col("place") - 28).alias("place_rank")).distinct()
    return view(spark, sf_dir, "decks").join(low, ["event_id", "place_rank"], "left_anti").select("deck_id", "place_rank")


@query("SELECT card_id, rarity IN ('Common', 'Rare', 'Super Rare') AND NOT split_printing AND set_id IN ('Brand#1', 'Brand#2', 'Brand#3') AND product_id NOT IN (3, 5, 8, 13) AS foil_split FROM {cards}")
def prj11_foil_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ11: the flag of cards with two markets, by rarity, set and exclusion list."""
    flag = F.col("rarity").isin("Common", "Rare", "Super Rare") & ~F.col("split_printing") & F.col("set_id").isin("Brand#1", "Brand#2", "Brand#3") & ~F.col("product_id").isin(3, 5, 8, 13)
    return view(spark, sf_dir, "cards").select("card_id", flag.alias("foil_split"))


@query("SELECT card_id, name FROM {cards} WHERE ink = 'Ruby' AND rarity = 'Rare' AND collector_number >= 20 AND contains(lower(name), 'gear')")
def prj19_screened_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ19, PRJ20, SRC8: cards by a search string with known phrases and a comparison."""
    phrases = {"ruby": ("ink", "Ruby"), "rare": ("rarity", "Rare"), "super rare": ("rarity", "Super Rare")}
    filters, name = S.parse_search("Ruby rare collector_number>=20 gear", phrases)
    return S.filtered_cards(view(spark, sf_dir, "cards"), filters, name).select("card_id", "name")


@query("SELECT card_id, n FROM (SELECT product_id, count(DISTINCT deck_id) AS n FROM {deck_cards} WHERE product_id IN (SELECT product_id FROM {watchlists} WHERE watchlist_id = 7) GROUP BY product_id) JOIN {cards} USING (product_id)")
def ag20_deck_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG20: decks that hold each card of a list."""
    ids = view(spark, sf_dir, "watchlists").where("watchlist_id = 7").select("product_id")
    counted = view(spark, sf_dir, "deck_cards").join(ids, "product_id", "left_semi").select("product_id", "deck_id").distinct().groupBy("product_id").agg(F.count("*").alias("n"))
    return counted.join(view(spark, sf_dir, "cards"), "product_id").select("card_id", "n")


@query("""SELECT c.c_custkey, c.c_name, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice >= 400000""")
def jn20_condition_in_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN20, JN1: a left join with a condition on the right side, which keeps every left row."""
    large = view(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice >= 400000").selectExpr("o_custkey AS c_custkey", "o_orderkey")
    return view(spark, sf_dir, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left")


@query("""SELECT product_id, CASE WHEN printing = '' OR printing IS NULL THEN 'Normal' ELSE printing END AS printing, CASE WHEN low > 0 THEN low END AS low, CASE WHEN market > 0 THEN market END AS market
  FROM (SELECT product_id, CASE WHEN product_id % 7 = 0 THEN '' ELSE printing END AS printing, CASE WHEN product_id % 5 = 0 THEN 0 ELSE low END AS low, CASE WHEN product_id % 3 = 0 THEN 0 ELSE market END AS market FROM {prices}) WHERE low > 0 OR market > 0""")
def prj1_price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1: raw price rows with zeroes as missing and a default printing; rows without any price go."""
    raw = "SELECT product_id, CASE WHEN product_id % 7 = 0 THEN '' ELSE printing END AS printing, CASE WHEN product_id % 5 = 0 THEN 0 ELSE low END AS low, CASE WHEN product_id % 3 = 0 THEN 0 ELSE market END AS market FROM {prices}"
    rows = rows_of(spark, sf_dir, raw).withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in ("low", "market")})
    return rows.withColumn("printing", F.coalesce(F.nullif("printing", F.lit("")), F.lit("Normal"))).where("coalesce(low, market) IS NOT NULL")
