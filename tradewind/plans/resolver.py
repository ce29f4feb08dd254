"""Names as people type them, resolved to cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewind.operators.resolver import resolve_cards
from tradewind.plans.registered import query
from tradewind.sources.views import rows_of

#: Parts as cards: a name with a word of its own, a version, and prices as the prior.
_CARDS = """SELECT CAST(p_partkey AS BIGINT) AS cid, concat(p_name, ' ', lower(hex(p_partkey * 104729 % 268435456))) AS name, concat(lower(p_type), ' of ', lower(hex(p_partkey % 97 * 7919))) AS version,
  lower(replace(p_brand, '#', '')) AS extra, CAST(p_size AS DOUBLE) / 64 AS played, CAST(p_partkey % 16 AS DOUBLE) / 16 AS collected FROM {part}"""
#: Every fiftieth as a query: letters swapped, the name's last letter left out, versions in part.
_ASKED = """SELECT CAST(p_partkey AS BIGINT) AS qid, concat(CASE WHEN p_partkey % 100 = 0 THEN replace(p_name, 'dg', 'gd') ELSE p_name END, ' ', substring(w, 1, length(w) - p_partkey % 3), ' ', substring(lower(p_type), 1, 4)) AS text
  FROM (SELECT *, lower(hex(p_partkey * 104729 % 268435456)) AS w FROM {part} WHERE p_partkey % 50 = 0) x"""
_SPLIT = "list_filter(list_distinct(regexp_split_to_array(lower({c}), '[^a-z0-9]+')), lambda x: length(x) >= 1)"
_split = lambda c: _SPLIT.replace("{c}", c)


@query(f"""WITH cards AS ({_CARDS}), held AS (SELECT cid, 'name' AS field, unnest({_split("name")}) AS word, 1.0::DOUBLE AS f FROM cards UNION ALL SELECT cid, 'version', unnest({_split("version")}), 0.92 FROM cards UNION ALL SELECT cid, 'extra', unnest({_split("extra")}), 0.36 FROM cards),
  voc AS (SELECT word, least(3.0, ln(1 + (SELECT count(*) FROM cards) / greatest(count(DISTINCT cid) FILTER (field <> 'extra'), 1))) AS idf FROM held GROUP BY word),
  asked AS (SELECT qid, unnest({_split("text")}) AS q FROM ({_ASKED})), dq AS (SELECT DISTINCT q, length(q) AS n FROM asked),
  d AS (SELECT q, n, word, idf, CASE WHEN n >= 4 AND abs(length(word) - n) <= 2 AND length(word) >= 3 THEN damerau_levenshtein(q, word) END AS edits FROM dq, voc),
  met AS (SELECT q, word, idf, CASE WHEN q = word THEN 1.0::DOUBLE ELSE greatest(CASE WHEN n >= 4 AND starts_with(word, q) THEN 0.72 + 0.2 * n / length(word) END, CASE WHEN edits = 1 THEN 0.8 WHEN edits = 2 AND n >= 8 THEN 0.6 WHEN edits = 2 AND n >= 6 THEN 0.55 END) END AS quality FROM d),
  ok AS (SELECT * FROM met WHERE quality IS NOT NULL), meant AS (SELECT q, arg_max(idf, (quality, idf)) AS m FROM ok GROUP BY q),
  wq AS (SELECT qid, q, CASE WHEN q = 'of' THEN 0.12 ELSE coalesce(m, 1.2) END AS w FROM asked LEFT JOIN meant USING (q)), total AS (SELECT qid, sum(w) AS total FROM wq GROUP BY qid),
  hit AS (SELECT qid, cid, q, w, max({{'s': quality * f, 'field': field, 'word': word}}) AS h FROM wq JOIN ok USING (q) JOIN held USING (word) GROUP BY ALL),
  c AS (SELECT qid, cid, sum(w * h.s) / max(total) AS coverage, count(DISTINCT h.word) FILTER (h.field = 'name' AND h.word <> 'of') AS nn, count(DISTINCT h.word) FILTER (h.field = 'version' AND h.word <> 'of') AS nv FROM hit JOIN total USING (qid) GROUP BY ALL),
  s AS (SELECT qid, cid, round(coverage, 6) AS coverage, round(coverage * (0.72 + 0.28 * nn / len(list_filter({_split("name")}, lambda x: x <> 'of'))) + 0.1 * nv / len(list_filter({_split("version")}, lambda x: x <> 'of'))
    + CASE WHEN {_split("concat(name, ' ', version)")} = {_split("text")} THEN 0.08 ELSE 0 END + 0.12 * played + 0.03 * collected, 6) AS rank FROM c JOIN cards USING (cid) JOIN ({_ASKED}) USING (qid) WHERE round(coverage, 6) >= 0.5)
  SELECT qid, cid, coverage, rank, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank DESC, cid) AS place FROM s) WHERE place <= 5""")
def tx4_resolved_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX4: every fiftieth card as typed by hand, by fields, prefixes, up to two edits and the prior."""
    return resolve_cards(rows_of(spark, sf_dir, _ASKED), rows_of(spark, sf_dir, _CARDS), stop=("of",))
