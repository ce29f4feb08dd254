"""Rating views, seasons, rosters and stores over the folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators import draws
from tradewind.operators import ratings as R
from tradewind.plans.registered import query
from tradewind.sources.views import rows_of, view


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST((2000 * {part} + {whole}) // (2 * {whole}) AS DOUBLE) / 10 END"


_RECORD = "count(*) FILTER (score = 1.0) AS wins, count(*) FILTER (score = 0.0) AS losses, count(*) FILTER (score = 0.5) AS draws"
_MW = _share("(2 * wins + draws)", "(2 * (wins + losses + draws))")
_BOARD = f"""chrono AS (SELECT rt.*, row_number() OVER (PARTITION BY rt.player_id ORDER BY e.event_date DESC NULLS LAST, m.event_id DESC, m.round_number DESC, m.table_number DESC NULLS LAST, m.match_id DESC) AS rn,
    m.event_id, m.round_number, games_won_p1 AS g1, games_won_p2 AS g2, coalesce(p1b.merged_into_id, p1.merged_into_id, m.player1_id) AS c1, coalesce(p2b.merged_into_id, p2.merged_into_id, m.player2_id) AS c2
    FROM {{ratings}} rt JOIN {{matches}} m ON m.match_id = rt.match_id JOIN {{events_held}} e ON e.event_id = m.event_id
    LEFT JOIN {{players}} p1 ON p1.player_id = m.player1_id LEFT JOIN {{players}} p1b ON p1b.player_id = p1.merged_into_id LEFT JOIN {{players}} p2 ON p2.player_id = m.player2_id LEFT JOIN {{players}} p2b ON p2b.player_id = p2.merged_into_id),
  per AS (SELECT player_id, max(rating_after) FILTER (rn = 1) AS current_rating, count(*) AS n_matches, max(rating_after) AS peak_rating, {_RECORD},
    sum(CASE WHEN c1 = player_id THEN g1 WHEN c2 = player_id THEN g2 ELSE 0 END) FILTER (g1 IS NOT NULL AND g2 IS NOT NULL) AS won,
    sum(CASE WHEN c1 = player_id OR c2 = player_id THEN g1 + g2 ELSE 0 END) FILTER (g1 IS NOT NULL AND g2 IS NOT NULL) AS played FROM chrono GROUP BY player_id),
  peak AS (SELECT player_id, event_id AS peak_event_id, round_number AS peak_round_number FROM (SELECT c.*, row_number() OVER (PARTITION BY c.player_id ORDER BY rating_id) AS k FROM chrono c JOIN per USING (player_id) WHERE rating_after = peak_rating) WHERE k = 1),
  board AS (SELECT p.player_id, display_name, platform, current_rating, n_matches, peak_rating, wins, losses, draws, {_share("won", "played")} AS gw_pct, {_MW} AS mw_pct, peak_event_id, peak_round_number,
    rank() OVER (ORDER BY current_rating DESC) AS rank FROM {{players}} p JOIN per USING (player_id) LEFT JOIN peak USING (player_id) WHERE merged_into_id IS NULL)"""
_SEATS = """LEFT JOIN {players} p1 ON p1.player_id = m.player1_id LEFT JOIN {players} p2 ON p2.player_id = m.player2_id"""
_BY_EVENT = f"""seated AS (SELECT rt.*, m.event_id, m.round_number, m.table_number, coalesce(games_won_p1, 0) AS g1, coalesce(games_won_p2, 0) AS g2, coalesce(p1.merged_into_id, m.player1_id) AS c1, coalesce(p2.merged_into_id, m.player2_id) AS c2
    FROM {{ratings}} rt JOIN {{matches}} m ON m.match_id = rt.match_id {_SEATS}),
  by_event AS (SELECT s.*, store_id, event_date, season, {_MW} AS mw_pct FROM (SELECT player_id, event_id, {_RECORD}, (list(rating_before ORDER BY round_number, table_number NULLS LAST, rating_id))[1] AS start_rating,
    (list(rating_after ORDER BY round_number DESC, table_number DESC NULLS LAST, rating_id DESC))[1] AS end_rating, max(rating_after) AS peak_rating,
    CAST(sum(CASE WHEN c1 = player_id THEN g1 WHEN c2 = player_id THEN g2 ELSE 0 END) AS BIGINT) AS games_won, CAST(sum(CASE WHEN c1 = player_id OR c2 = player_id THEN g1 + g2 ELSE 0 END) AS BIGINT) AS total_games,
    arg_max(rating_after, rating_id) AS newest_rating FROM seated GROUP BY player_id, event_id) s JOIN {{events_held}} e ON e.event_id = s.event_id)"""
_PLACED = f"""ranked AS (SELECT b.*, rank() OVER (PARTITION BY event_id ORDER BY wins * 3 + draws DESC, wins DESC) AS own_rank FROM by_event b),
  offi AS (SELECT r.*, p.display_name, place, coalesce(matches_won, wins) AS w, coalesce(matches_lost, losses) AS l, match_points FROM ranked r JOIN {{players}} p ON p.player_id = r.player_id
    LEFT JOIN {{official}} o ON o.event_id = r.event_id AND o.player_id = r.player_id),
  placed AS (SELECT event_id, player_id, display_name, CAST(w AS BIGINT) AS wins, CAST(l AS BIGINT) AS losses, draws, CAST(coalesce(match_points, wins * 3 + draws) AS BIGINT) AS points, {_share("games_won", "total_games")} AS gw_pct,
    {_share("(2 * w + draws)", "(2 * (w + l + draws))")} AS mw_pct, newest_rating AS end_rating, CAST(coalesce(place, own_rank) AS INTEGER) AS event_rank FROM offi)"""


def _four(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in ("ratings", "matches", "events_held", "players")]


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.leaderboard(*_four(spark, sf_dir))


def _by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.player_events(*_four(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.standings(_by_event(spark, sf_dir), view(spark, sf_dir, "official"), view(spark, sf_dir, "players"))


@query("""WITH RECURSIVE up AS (SELECT player_id, player_id AS here, 0 AS n FROM {players} UNION ALL SELECT u.player_id, p.merged_into_id, n + 1 FROM up u JOIN {players} p ON p.player_id = u.here WHERE p.merged_into_id IS NOT NULL AND n < 60)
  SELECT player_id, arg_max(here, n) AS root_id FROM up GROUP BY player_id""")
def el2_alias_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL2: where each chain of merged accounts ends."""
    return R.roots(view(spark, sf_dir, "players"))


@query(f"WITH {_BOARD} SELECT * FROM board")
def el3_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL3, WN2, WN3, WN4, JN2, JN11, AG3: the leaderboard of unmerged players."""
    return _board(spark, sf_dir)


@query(f"""SELECT rt.rating_id, rt.player_id, m.event_id, e.name AS event_name, e.event_date, m.round_number, m.table_number, rt.opponent_id, o.display_name AS opponent_name, rt.opponent_rating,
    CASE WHEN coalesce(p1.merged_into_id, m.player1_id) = rt.player_id THEN games_won_p1 WHEN coalesce(p2.merged_into_id, m.player2_id) = rt.player_id THEN games_won_p2 END AS my_games,
    CASE WHEN coalesce(p1.merged_into_id, m.player1_id) = rt.player_id THEN games_won_p2 WHEN coalesce(p2.merged_into_id, m.player2_id) = rt.player_id THEN games_won_p1 END AS opp_games,
    rt.score, rt.rating_before, rt.rating_after, rt.rating_after - rt.rating_before AS elo_delta, false AS is_bye, m.is_intentional_draw AS is_draw_agreed
  FROM {{ratings}} rt JOIN {{matches}} m ON m.match_id = rt.match_id JOIN {{events_held}} e ON e.event_id = m.event_id LEFT JOIN {{players}} o ON o.player_id = rt.opponent_id {_SEATS}
  UNION ALL SELECT NULL, coalesce(p1.merged_into_id, m.player1_id), m.event_id, e.name, e.event_date, m.round_number, m.table_number, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(0 AS DOUBLE), true, false
  FROM {{matches}} m JOIN {{events_held}} e ON e.event_id = m.event_id LEFT JOIN {{players}} p1 ON p1.player_id = m.player1_id WHERE m.is_bye""")
def el4_player_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL4, ST1, PRJ6: rated rounds, and byes as rows of their own."""
    return R.player_rounds(*_four(spark, sf_dir))


@query(f"WITH {_BY_EVENT} SELECT * FROM by_event")
def el5_player_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL5, AG3: record and ratings of each player in each event."""
    return _by_event(spark, sf_dir)


@query(f"WITH {_BY_EVENT}, {_PLACED} SELECT * FROM placed")
def el6_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL6: standings, official values first."""
    return _placed(spark, sf_dir)


@query(f"""WITH {_BY_EVENT}, {_PLACED}, a AS (SELECT event_id, count(*) AS rated_players, CAST(floor(sum(start_rating) / count(*) + 0.5) AS INTEGER) AS avg_start, CAST(max(start_rating) AS INTEGER) AS top_seed FROM by_event GROUP BY event_id),
  c AS (SELECT event_id, display_name, player_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY display_name, player_id) AS k FROM placed WHERE event_rank = 1) WHERE k = 1)
  SELECT e.event_id, e.name, e.store_id, e.event_date, e.season, e.num_players, coalesce(rated_players, 0) AS rated_players, avg_start, top_seed, c.display_name AS champion_name, c.player_id AS champion_id
  FROM {{events_held}} e LEFT JOIN a USING (event_id) LEFT JOIN c ON c.event_id = e.event_id""")
def el7_event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL7, WN10: events with their field's strength and champion."""
    return R.event_summary(view(spark, sf_dir, "events_held"), _by_event(spark, sf_dir), _placed(spark, sf_dir))


@query(f"""WITH {_BOARD}, {_BY_EVENT}, whole AS (SELECT player_id, display_name FROM {{players}} WHERE merged_into_id IS NULL), own AS (SELECT b.* FROM by_event b SEMI JOIN whole USING (player_id) WHERE season = 'S1998'),
  held AS (SELECT DISTINCT event_id FROM by_event WHERE season = 'S1998'), given AS (SELECT o.* FROM {{official}} o SEMI JOIN held USING (event_id) SEMI JOIN whole USING (player_id)),
  total AS (SELECT player_id, CAST(sum(wins) AS BIGINT) AS w, CAST(sum(losses) AS BIGINT) AS l, CAST(sum(draws) AS BIGINT) AS d, CAST(sum(games_won) AS BIGINT) AS gw, CAST(sum(total_games) AS BIGINT) AS tg, sum(end_rating - start_rating) AS change, max(peak_rating) AS peak FROM own GROUP BY player_id),
  entered AS (SELECT player_id, count(*) AS events FROM (SELECT player_id, event_id FROM own UNION SELECT player_id, event_id FROM given) GROUP BY player_id),
  pl AS (SELECT player_id, min(place) AS best_place, count(*) FILTER (place = 1) AS titles, count(*) FILTER (place = 2) AS finals, count(*) FILTER (place BETWEEN 3 AND 4) AS top4, count(*) FILTER (place BETWEEN 5 AND 8) AS top8 FROM given GROUP BY player_id)
  SELECT t.player_id, whole.display_name, coalesce(events, 0) AS events, w, l, d, {_share("(2 * w + d)", "(2 * (w + l + d))")} AS mw_pct, {_share("gw", "tg")} AS gw_pct, CAST(round(change) AS INTEGER) AS elo_change, CAST(round(peak) AS INTEGER) AS season_peak,
    CAST(round(current_rating) AS INTEGER) AS current_rating, rank AS current_rank, coalesce(titles, 0) AS titles, coalesce(finals, 0) AS finals, coalesce(top4, 0) AS top4, coalesce(top8, 0) AS top8, best_place
  FROM total t JOIN whole USING (player_id) LEFT JOIN entered USING (player_id) LEFT JOIN board b ON b.player_id = t.player_id LEFT JOIN pl ON pl.player_id = t.player_id""")
def el8_season_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL8, AG4, AG9, ST2, JN9: a season's players."""
    return R.season_players(_by_event(spark, sf_dir), view(spark, sf_dir, "official"), _board(spark, sf_dir), view(spark, sf_dir, "players"), "S1998")


@query(f"""WITH {_BY_EVENT}, ev AS (SELECT * FROM {{events_held}} WHERE season = 'S1998'), pe AS (SELECT * FROM by_event WHERE season = 'S1998')
  SELECT (SELECT count(*) FROM ev) AS events, (SELECT CAST(sum(num_players) AS DOUBLE) / count(num_players) FROM ev) AS avg_field, (SELECT count(DISTINCT store_id) FROM ev) AS stores, (SELECT min(event_date) FROM ev) AS date_from, (SELECT max(event_date) FROM ev) AS date_to,
    (SELECT name FROM ev ORDER BY num_players DESC, event_date LIMIT 1) AS largest, (SELECT count(DISTINCT player_id) FROM pe) AS players, (SELECT CAST(sum(total_games) AS BIGINT) FROM pe) AS total_games,
    (SELECT count(*) FROM {{matches}} m WHERE NOT is_bye AND event_id IN (SELECT event_id FROM ev)) AS matches""")
def ag14_season_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14, EL8: a season's totals in one row."""
    return R.season_summary(_by_event(spark, sf_dir), view(spark, sf_dir, "matches"), view(spark, sf_dir, "events_held"), "S1998")


_NAMES = """SELECT DISTINCT event_id, CASE WHEN k % 2 = 0 THEN concat('Player ', k) ELSE concat('PLAYER ', k) END AS name FROM (SELECT event_id, (player1_id + event_id) % 110 AS k FROM {matches}) x"""


@query(f"""WITH {_BOARD}, names AS ({_NAMES}), met AS (SELECT n.event_id, n.name, p.player_id, b.current_rating, row_number() OVER (PARTITION BY n.event_id, n.name
    ORDER BY b.current_rating IS NOT NULL DESC, p.display_name = n.name DESC, p.merged_into_id IS NULL DESC, p.player_id) AS k FROM names n LEFT JOIN {{players}} p ON lower(p.display_name) = lower(n.name) LEFT JOIN board b ON b.player_id = p.player_id),
  r AS (SELECT event_id, name, player_id, current_rating FROM met WHERE k = 1)
  SELECT event_id, count(*) AS entrants, count(current_rating) AS rated, sum(current_rating) / nullif(count(current_rating), 0) AS mean_rating, median(current_rating) AS median_rating, max(current_rating) AS top_rating FROM r GROUP BY event_id""")
def el9_roster_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL9, EL10, JN12, AG8: entrants' names resolved to accounts, and each event's strength."""
    names = spark.sql(_NAMES, matches=view(spark, sf_dir, "matches"))
    return R.roster_strength(R.roster(names, view(spark, sf_dir, "players"), _board(spark, sf_dir)))


@query(f"""WITH {_BOARD} SELECT p.player_id, p.display_name, current_rating FROM {{players}} p LEFT JOIN board b ON b.player_id = p.player_id WHERE merged_into_id IS NULL AND contains(lower(p.display_name), 'er 1')
  ORDER BY current_rating DESC NULLS LAST, p.player_id LIMIT 30""")
def el10_player_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL10, SR1: players by a part of their name."""
    return R.search_players(view(spark, sf_dir, "players"), _board(spark, sf_dir), "er 1")


@query("""WITH s AS (SELECT event_id, player1_id AS player_id, coalesce(games_won_p1, 0) AS a, coalesce(games_won_p2, 0) AS b, is_bye FROM {matches} UNION ALL SELECT event_id, player2_id, coalesce(games_won_p2, 0), coalesce(games_won_p1, 0), is_bye FROM {matches} WHERE player2_id IS NOT NULL)
  SELECT event_id, player_id, count(*) FILTER (NOT is_bye AND a > b) AS w, count(*) FILTER (NOT is_bye AND a < b) AS l, count(*) FILTER (NOT is_bye AND a = b) AS d, count(*) FILTER (is_bye) AS byes FROM s GROUP BY ALL""")
def mt12_swiss_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT12: records out of two-sided matches."""
    return R.swiss_record(view(spark, sf_dir, "matches"))


_POINTS = """s AS (SELECT event_id, round_number, match_id, player1_id AS player_id, CASE WHEN is_bye OR coalesce(games_won_p1, 0) > coalesce(games_won_p2, 0) THEN 3 WHEN coalesce(games_won_p1, 0) = coalesce(games_won_p2, 0) THEN 1 ELSE 0 END AS points FROM {matches}
  UNION ALL SELECT event_id, round_number, match_id, player2_id, CASE WHEN coalesce(games_won_p2, 0) > coalesce(games_won_p1, 0) THEN 3 WHEN coalesce(games_won_p1, 0) = coalesce(games_won_p2, 0) THEN 1 ELSE 0 END FROM {matches} WHERE player2_id IS NOT NULL)"""


@query(f"""WITH {_POINTS} SELECT *, CAST(coalesce(sum(points) OVER (PARTITION BY event_id, player_id ORDER BY round_number, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s""")
def wn17_points_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN17: points of both seats before each round."""
    return R.points_before(view(spark, sf_dir, "matches"))


@query(f"""WITH {_POINTS}, t AS (SELECT event_id, player_id, CAST(sum(points) AS BIGINT) AS points FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY points DESC, player_id) AS k FROM t)
  SELECT event_id, count(*) AS n_players, max(points) FILTER (k = 8) AS line FROM r GROUP BY event_id""")
def wn18_cut_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN18: the eighth-highest total of each event."""
    return R.cut_line(R.points_before(view(spark, sf_dir, "matches")))


# Cups whose first seven matches are a final, its semifinals and quarterfinals, some of them drawn, behind six rounds of Swiss.
_CUPS = """SELECT event_id, CAST(CASE WHEN k = 1 THEN 9 WHEN k <= 3 THEN 8 WHEN k <= 7 THEN 7 ELSE k % 6 + 1 END AS INT) AS round_number, CASE WHEN k % 50 <> 0 THEN k END AS table_number, player1_id, player2_id, is_bye,
  CASE WHEN g = 0 THEN 0 WHEN g < 5 THEN 1 ELSE 2 END AS games_won_p1, CASE g WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS games_won_p2,
  CASE WHEN is_bye OR g < 2 THEN NULL WHEN g < 5 THEN player2_id ELSE player1_id END AS winner_id
  FROM (SELECT o_custkey % 50 AS event_id, o_orderkey % 60 AS player1_id, CASE WHEN o_orderkey % 41 <> 0 THEN o_orderkey % 59 + 60 END AS player2_id, o_orderkey % 41 = 0 AS is_bye,
    CAST(floor(o_totalprice) AS BIGINT) % 12 AS g, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS k FROM {orders})"""
_RULED = "SELECT event_id, round_number, table_number, event_id % 2 = 0 AS intentional FROM (" + _CUPS + ") WHERE event_id % 5 = 0 AND round_number >= 6 AND (table_number IS NULL OR table_number % 3 = 0)"


@query(f"""WITH m AS ({_CUPS}), z AS (SELECT event_id, round_number, count(*) FILTER (NOT is_bye) AS n, count(*) FILTER (NOT is_bye AND winner_id IS NULL) AS d FROM m GROUP BY ALL HAVING n > 0),
  h AS (SELECT *, n = power(2, row_number() OVER w - 1) AND d = 0 AND lead(n) OVER w IS DISTINCT FROM n AS ok FROM z WINDOW w AS (PARTITION BY event_id ORDER BY round_number DESC)),
  c AS (SELECT *, bool_and(ok) OVER (PARTITION BY event_id ORDER BY round_number DESC) AS in_cut FROM h),
  r AS (SELECT event_id, round_number, in_cut, coalesce(2 * max(n) FILTER (in_cut) OVER (PARTITION BY event_id), 0) AS cut_size, NOT in_cut AND count(*) FILTER (NOT in_cut) OVER (PARTITION BY event_id ORDER BY round_number DESC) <= 2 AS closing FROM c),
  s AS (SELECT m.*, p.player_id, p.points FROM m JOIN r USING (event_id, round_number), LATERAL (SELECT player1_id AS player_id, CASE WHEN is_bye THEN 3 WHEN winner_id = player1_id THEN 3 WHEN winner_id IS NULL AND player2_id IS NOT NULL THEN 1 ELSE 0 END AS points
    UNION ALL SELECT player2_id, CASE WHEN winner_id = player2_id THEN 3 WHEN winner_id IS NULL THEN 1 ELSE 0 END) p WHERE NOT in_cut AND p.player_id IS NOT NULL),
  e AS (SELECT event_id, round_number, player_id, coalesce(sum(sum(points)) OVER (PARTITION BY event_id, player_id ORDER BY round_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pts FROM s GROUP BY event_id, round_number, player_id),
  l AS (SELECT event_id, round_number, (list(pts ORDER BY pts DESC))[any_value(cut_size)] AS line FROM e JOIN r USING (event_id, round_number) WHERE cut_size > 0 GROUP BY event_id, round_number),
  t AS (SELECT m.event_id, m.round_number, table_number, player1_id, player2_id, CASE WHEN in_cut THEN 'in-cut'
    WHEN coalesce(games_won_p1, 0) = 0 AND coalesce(games_won_p2, 0) = 0 THEN CASE WHEN closing AND a.pts >= line AND b.pts >= line AND count(*) OVER (PARTITION BY m.event_id, m.round_number) > 1 THEN 'ID-strong' ELSE 'ID-likely' END
    WHEN NOT closing THEN 'real' WHEN a.pts >= line AND b.pts >= line THEN CASE WHEN count(*) OVER (PARTITION BY m.event_id, m.round_number) > 1 THEN 'ID-strong' ELSE 'ID-likely' END ELSE 'unclear' END AS tier
    FROM m JOIN r USING (event_id, round_number) LEFT JOIN l ON l.event_id = m.event_id AND l.round_number = m.round_number LEFT JOIN e a ON a.event_id = m.event_id AND a.round_number = m.round_number AND a.player_id = player1_id
    LEFT JOIN e b ON b.event_id = m.event_id AND b.round_number = m.round_number AND b.player_id = player2_id WHERE NOT is_bye AND winner_id IS NULL),
  u AS (SELECT event_id, round_number, table_number, bool_or(intentional) AS intentional FROM ({_RULED}) GROUP BY ALL)
  SELECT t.* REPLACE (coalesce(CASE WHEN u.intentional THEN 'ID-manual' WHEN NOT u.intentional THEN 'real-manual' END, tier) AS tier), starts_with(coalesce(CASE WHEN u.intentional THEN 'ID-manual' WHEN NOT u.intentional THEN 'real' END, tier), 'ID') AS intentional
  FROM t LEFT JOIN u ON u.event_id = t.event_id AND u.round_number = t.round_number AND u.table_number IS NOT DISTINCT FROM t.table_number""")
def el11_draw_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL11, WN17, WN18: whether each draw was agreed, by score or by position, with what people have ruled on top."""
    return draws.draw_tiers(rows_of(spark, sf_dir, _CUPS), ruled=rows_of(spark, sf_dir, _RULED))


_OURS = "SELECT event_id, round_number, table_number, concat('P', player1_id) AS name1, CASE WHEN player2_id IS NOT NULL THEN concat('P', player2_id) END AS name2 FROM {matches} WHERE match_id % 97 < 60"
_THEIRS = "SELECT event_id, round_number, table_number, concat('P', CASE WHEN player1_id % 20 = 3 THEN player1_id + 200 ELSE player1_id END) AS name1, CASE WHEN player2_id IS NOT NULL THEN concat('P', player2_id) END AS name2 FROM {matches} WHERE match_id % 97 < 60 AND match_id % 7 = 0"


@query(f"""WITH o AS ({_OURS}), t AS ({_THEIRS}), j AS (SELECT o.name1 AS o1, o.name2 AS o2, t.name1 AS t1, t.name2 AS t2 FROM o JOIN t ON o.event_id = t.event_id AND o.round_number = t.round_number AND coalesce(o.table_number, -999) = coalesce(t.table_number, -999)),
  p AS (SELECT o1 AS ours, t1 AS theirs FROM j UNION ALL SELECT o2, t2 FROM j) SELECT ours, theirs, count(*) AS n FROM p WHERE ours <> theirs GROUP BY ALL""")
def el15_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL15: names that differ in the same slot of two sources."""
    matches = view(spark, sf_dir, "matches")
    return R.renames(spark.sql(_OURS, matches=matches), spark.sql(_THEIRS, matches=matches))


_INKS = "SELECT d.deck_id, d.event_id * 100 + month(d.day) AS event_id, d.day AS event_date, CASE WHEN d.deck_id % 4 = 0 THEN 'infinity' WHEN d.deck_id % 4 <> 3 THEN 'core' END AS format, d.place_rank, c.ink FROM {decks} d JOIN {deck_cards} dc ON dc.deck_id = d.deck_id JOIN {cards} c ON c.product_id = dc.product_id WHERE c.ink IS NOT NULL"


def _combinations(since: str, fallback: str) -> str:
    return f"""WITH i AS ({_INKS}), n AS (SELECT count(DISTINCT event_id) AS n FROM i WHERE format = 'core' AND event_date >= DATE '{since}'),
  g AS (SELECT deck_id, event_id, place_rank, string_agg(DISTINCT ink, '/' ORDER BY ink) AS combination FROM i, n WHERE format = 'core' AND event_date >= CASE WHEN n >= 3 THEN DATE '{since}' ELSE DATE '{fallback}' END GROUP BY ALL)
  SELECT combination, count(*) AS n_decks, count(*) FILTER (place_rank <= 4) AS top4, count(*) FILTER (place_rank = 1) AS won FROM g GROUP BY combination"""


def _deck_inks(spark: SparkSession, sf_dir: str, today: str, since: str) -> DataFrame:
    rows = spark.sql(_INKS, **{n: view(spark, sf_dir, n) for n in ("decks", "deck_cards", "cards")})
    decks = rows.groupBy("deck_id", "event_id", "event_date", "format", "place_rank").agg(F.collect_set("ink").alias("inks"))
    return R.deck_inks(decks, ("Amber", "Amethyst", "Emerald", "Ruby", "Sapphire", "Steel"), today, since)


@query(_combinations("1999-06-01", "2001-05-23"))
def ag17_deck_inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17, EL20, AG5: core decks since a set's release by their inks in a fixed order."""
    return _deck_inks(spark, sf_dir, "2001-08-21", "1999-06-01")


@query(_combinations("2001-08-20", "2001-05-23"))
def el20_deck_inks_of_a_new_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL20: the same just after a release, where too few events were held: those of the last 90 days."""
    return _deck_inks(spark, sf_dir, "2001-08-21", "2001-08-20")


@query("""WITH s AS (SELECT event_id, round_number, coalesce(games_won_p1, 0) = coalesce(games_won_p2, 0) AS d, CASE WHEN table_number IS NULL THEN 'none' WHEN table_number <= 4 THEN 'top' ELSE 'rest' END AS position FROM {matches} WHERE NOT is_bye)
  SELECT round_number, count(*) FILTER (d AND position = 'top') AS top, count(*) FILTER (d AND position = 'rest') AS rest, count(*) FILTER (d AND position = 'none') AS none FROM s GROUP BY round_number""")
def ag19_draw_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG19: draws by round and position as a cross table."""
    drawn = view(spark, sf_dir, "matches").where("NOT is_bye").withColumn("d", F.expr("coalesce(games_won_p1, 0) = coalesce(games_won_p2, 0)"))
    at = drawn.withColumn("position", F.expr("CASE WHEN table_number IS NULL THEN 'none' WHEN table_number <= 4 THEN 'top' ELSE 'rest' END"))
    return at.groupBy("round_number").pivot("position", ["top", "rest", "none"]).agg(F.count_if("d")).na.fill(0)


@query("""SELECT store_id, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.9) AS p90
  FROM (SELECT CAST(o_custkey % 25 AS BIGINT) AS store_id, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM {orders} GROUP BY ALL) GROUP BY store_id""")
def el17_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EL17, AG8: percentiles of a store's daily attendance."""
    daily = view(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("store_id"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    at = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return daily.groupBy("store_id").agg(*(F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY n)").alias(n) for n, p in at.items()))
