"""Listings matched to cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewind.functions import listings as L
from tradewind.operators.listings import match_titles
from tradewind.plans.registered import query
from tradewind.sources.views import view


def _text(s: str | None) -> str:
    return "'" + (s or "").replace("'", "''") + "'"


_STOP = ", ".join(map(_text, L.STOP))
# DuckDB's patterns don't look around: what precedes a match is matched, and separators are doubled so that neighbours don't share one
_TOTAL = r"(?:^|[^0-9./])([0-9]{1,3}[A-Za-z]?)\s*/\s*([0-9]{1,3}|[A-Za-z]{1,3}[0-9]+)"
_BARE = r"(?:^|[^0-9/#.])([0-9]{1,3})(?:[^0-9/.]|$)"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_STOP})))"


def _number(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE upper({x}) END"


def _hints() -> str:
    cases = []
    for h in L.HINTS:
        fits = " AND ".join([f"regexp_matches(t, {_text(h.pattern)})"] + [f"regexp_matches(t, {_text(h.also)})"] * bool(h.also) + [f"NOT regexp_matches(t, {_text(h.unless)})"] * bool(h.unless))
        if isinstance(h.names, dict):
            cases += [f"WHEN {fits} AND ltrim(regexp_extract(t, {_text(h.pattern)}, 1), '0') = {_text(k)} THEN {_text(v)}" for k, v in h.names.items()]
        else:
            cases.append(f"WHEN {fits} THEN {_text(h.names)}")
    cases += [f"WHEN contains(t, {_text(part)}) THEN {_text(name)}" for part, name in L.SET_NAMES.items()]
    return f"CASE {' '.join(cases)} END"


_SQL = rf"""WITH c AS (SELECT card_id, {_words("name || ' ' || coalesce(version, '')")} AS cw, coalesce(set_name, '') AS cset, {_number("collector_number")} AS n, coalesce(rarity, '') AS crar, released_at,
    nullif(regexp_extract({_number("collector_number")}, '^([0-9]+)([A-Z][A-Z])$', 1), '') AS base, nullif(lower(regexp_extract({_number("collector_number")}, '^([0-9]+)([A-Z][A-Z])$', 2)), '') AS clang,
    CASE WHEN rarity = 'Promo' THEN 0 WHEN released_at IS NULL THEN -1000000000 ELSE -(year(released_at) * 372 + month(released_at) * 31 + day(released_at)) END AS age FROM {{catalog_cards}}),
  d AS (SELECT DISTINCT title, sold_date FROM {{listings}} WHERE NOT (regexp_matches(title, {_text(L.NOT_SINGLE)}) OR regexp_matches(title, {_text(L.LOOSE_SET)}) OR regexp_matches(title, {_text(L.SEVERAL)}))),
  x AS (SELECT *, lower(title) AS t, list_zip(regexp_extract_all(title, '{_TOTAL}', 1), regexp_extract_all(title, '{_TOTAL}', 2)) AS totals, regexp_extract_all(title, {_text(L.HASHED)}, 1) AS hashed,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, {_text(L.GRADED_NUMBER)}, ' ', 'g'), '\b(?:19|20)[0-9][0-9]\b', ' ', 'g'), {_text(L.ORDINAL)}, ' ', 'g'), '(?i){L.POPULATION}', ' ', 'g'), '([^0-9])', '\1\1', 'g') AS rest FROM d),
  y AS (SELECT *, list_concat(list_transform(list_filter(totals, lambda z: regexp_matches(z[2], '^[A-Za-z]') OR coalesce(TRY_CAST(z[2] AS INT), 0) >= 100), lambda z: z[1]), hashed) AS raw FROM x),
  q AS (SELECT row_number() OVER () AS tid, title, sold_date, t, {_words("title")} AS tw, {_hints()} AS hint,
    list_distinct(list_transform(list_concat(raw, list_transform(raw, lambda z: regexp_replace(z, '[A-Za-z]$', ''))), lambda z: {_number("z")})) AS scn,
    list_distinct(list_transform(list_filter(raw, lambda z: regexp_matches(z, '[A-Za-z]$')), lambda z: {_number("z")})) AS xcn,
    list_transform(list_filter(regexp_extract_all(rest, '{_BARE}', 1), lambda z: CAST(z AS INT) >= 100), lambda z: {_number("z")}) AS bare,
    CASE WHEN regexp_matches(t, '\benchanted\b') THEN 'Enchanted' WHEN regexp_matches(t, '\biconic\b') THEN 'Iconic' WHEN regexp_matches(t, '\bepic\b') THEN 'Epic' END AS trar,
    CASE {" ".join(f"WHEN regexp_matches(t, {_text(p)}) THEN '{n}'" for n, p in L.LANGUAGES.items())} END AS tlang,
    regexp_matches(t, {_text(L.FAIR)}) AND NOT (regexp_matches(t, {_text(L.FAIR_LATER)}) OR (regexp_matches(t, {_text(L.FAIR_LABEL)}) AND NOT regexp_matches(t, {_text(L.FAIR_EARLIER)}))) AS fair FROM y),
  qq AS (SELECT * EXCLUDE (bare), list_distinct(list_concat(scn, bare)) AS cns, {_words("hint")} AS hw FROM q),
  pair AS (SELECT tid, card_id FROM (SELECT tid, unnest(tw) AS w FROM qq) a JOIN (SELECT card_id, unnest(cw) AS w FROM c) b USING (w) UNION SELECT tid, card_id FROM (SELECT tid, unnest(cns) AS n FROM qq) a JOIN c USING (n)),
  p AS (SELECT *, coalesce(released_at > sold_date + 14, FALSE) AS early FROM pair JOIN qq USING (tid) JOIN c USING (card_id) WHERE len(cw) > 0),
  g AS (SELECT * FROM (SELECT *, bool_and(early) OVER (PARTITION BY tid) AS none_out FROM p) WHERE NOT early OR none_out),
  m AS (SELECT *, len(list_intersect(tw, cw)) AS k, len(list_intersect(tw, cw)) / CAST(len(cw) AS DOUBLE) AS ov, list_contains(cns, n) AS hit, coalesce(cset = hint, FALSE) AS shit, list_contains(xcn, n) AS ex,
    (list_contains(scn, n) OR coalesce(list_contains(scn, base), FALSE)) AND (hint IS NULL OR cset = hint) AS owns, len(hw) > 0 AND len(list_filter(cw, lambda z: NOT list_contains(hw, z))) = 0 AS named,
    fair AND cset = '{L.FAIR_SET}' AND n IN {L.FAIR_NUMBERS} AS fhit, crar IN {L.CHASE} AS chase FROM g),
  s AS (SELECT *, bool_or(ex) OVER (PARTITION BY tid) AS any_ex, bool_or(owns) OVER (PARTITION BY tid) AS any_own, CASE WHEN trar IS NOT NULL THEN crar = trar ELSE hit OR NOT chase END AS rok,
    CASE WHEN trar IS NULL THEN CASE WHEN hit OR NOT chase THEN 0.0::DOUBLE ELSE -0.5 END WHEN crar = trar THEN 0.7 WHEN hit THEN 0.0 WHEN chase THEN -0.6 ELSE -0.45 END AS rp,
    CASE WHEN clang IS NULL OR tlang IS NULL THEN 0.0::DOUBLE WHEN clang = tlang THEN 0.5 ELSE -0.6 END AS lp FROM m),
  -- no candidate: a card that shares only words of less than half its name
  z AS (SELECT * FROM s WHERE (hit OR ov >= 0.5 OR (k > 0 AND (shit OR coalesce(crar = trar, FALSE) OR lp > 0 OR coalesce(list_contains(scn, base), FALSE))))
    AND NOT (len(hw) > 0 AND NOT named AND len(list_filter(list_intersect(tw, cw), lambda w: NOT list_contains(hw, w))) = 0)),
  f AS (SELECT *, ov + CASE WHEN hit THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN shit THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN fhit THEN 0.6::DOUBLE ELSE 0 END + rp + lp + CASE WHEN any_ex THEN CASE WHEN ex THEN 0.8::DOUBLE ELSE -0.5 END ELSE 0 END
      + CASE WHEN any_own AND owns AND k >= 1 THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN hint IS NOT NULL AND NOT shit AND ov < 0.9 THEN 0.3::DOUBLE ELSE 0 END AS sc,
    ov >= 0.85 AND k >= 2 AND (NOT any_own OR owns OR NOT named) AS strong FROM z),
  b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY tid ORDER BY strong DESC, CASE WHEN strong THEN (ex::INT * 16 + rok::INT * 8 + fhit::INT * 4 + hit::INT * 2 + shit::INT) END DESC, CASE WHEN strong THEN ov ELSE sc END DESC, age DESC, sc DESC, card_id) = 1),
  o AS (SELECT title, sold_date, card_id, round(sc, 3) AS confidence, (hit AND shit) OR (ov >= 0.5 AND (hit OR shit)) OR (hit AND ov >= 0.25) OR ov >= 0.85 AS sure, len(scn) > 0 AND NOT list_contains(scn, n) AND NOT shit AS conflict FROM b)
  SELECT l.item_id, CASE WHEN sure AND NOT conflict THEN o.card_id END AS card_id, CASE WHEN sure AND NOT conflict THEN confidence END AS confidence, coalesce(sure AND conflict, FALSE) AS cn_conflict
  FROM {{listings}} l LEFT JOIN o ON o.title = l.title AND o.sold_date IS NOT DISTINCT FROM l.sold_date"""


@query(_SQL)
def tx3_matched_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX3, PRJ15, PRJ16: the card of each listing's title, how sure that is, and conflicts of the printed number."""
    return match_titles(view(spark, sf_dir, "listings"), view(spark, sf_dir, "catalog_cards"))
