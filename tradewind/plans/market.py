"""Moves, standings and indexes over the folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators import index, movers
from tradewind.operators.series import group_averages, snapshot_gate
from tradewind.plans.registered import percent_sql, query
from tradewind.sources.views import rows_of, view

_S = "product_id, printing"


def _movers_sql() -> str:
    agg, out = [], []
    for b, prefix in (("low", "pct"), ("market", "mkt_pct")):
        agg += [f"max(price_date) FILTER ({b} IS NOT NULL) AS {b}_date", f"arg_max({b}, price_date) FILTER ({b} IS NOT NULL) AS {b}_today"]
        agg.append(f"arg_max({b}, price_date) FILTER ({b} IS NOT NULL AND price_date < l_{b}) AS {b}_prev")
        agg += [f"arg_max({b}, price_date) FILTER ({b} IS NOT NULL AND price_date <= newest - {n}) AS {b}_{n}d" for n in movers.WINDOWS]
        out.append(percent_sql(f"{b}_today", f"{b}_prev", f"{b}_date > newest - 1") + f" AS {prefix}_1d")
        out += [percent_sql(f"{b}_today", f"{b}_{n}d", f"{b}_date > newest - {n}") + f" AS {prefix}_{n}d" for n in movers.WINDOWS]
    return f"""latest AS (SELECT max(price_date) AS newest FROM {{prices}}),
      kept AS (SELECT p.*, newest, max(price_date) FILTER (low IS NOT NULL) OVER (PARTITION BY {_S}) AS l_low, max(price_date) FILTER (market IS NOT NULL) OVER (PARTITION BY {_S}) AS l_market
               FROM {{prices}} p JOIN {{floors}} USING (product_id) CROSS JOIN latest WHERE price_date >= floor_date),
      changes AS (SELECT {_S}, max(price_date) FILTER (c) AS low_last_changed FROM
        (SELECT {_S}, price_date, low IS DISTINCT FROM lag(low) OVER (PARTITION BY {_S} ORDER BY price_date) AS c FROM kept WHERE low IS NOT NULL) GROUP BY ALL),
      agg AS (SELECT {_S}, newest, {", ".join(agg)} FROM kept GROUP BY {_S}, newest),
      moved AS (SELECT agg.*, low_last_changed, {", ".join(out)} FROM agg LEFT JOIN changes USING ({_S}) WHERE low_today IS NOT NULL OR market_today IS NOT NULL)"""


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movers.movers(view(spark, sf_dir, "prices"), view(spark, sf_dir, "floors"))


@query(f"WITH {_movers_sql()} SELECT * FROM moved")
def price_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX4, JN3, JN4, JN6, WN6, AG2, AG3: moves of low and market over five windows and since the price before."""
    return _moved(spark, sf_dir)


_SECTION = """CASE WHEN rarity = 'Quest' THEN NULL WHEN rarity IN ('Enchanted', 'Epic', 'Iconic') THEN 'chase' WHEN rarity = 'Promo' THEN 'promo'
  WHEN coalesce(printing, 'Normal') IN ('Normal', 'Non-Foil') THEN 'base' ELSE 'foil' END"""


@query(f"""WITH {_movers_sql()}, s AS (SELECT m.*, {_SECTION} AS section, pct_365d AS pct, CASE WHEN 1 + pct_365d / 100 > 0 THEN low_today - low_today / (1 + pct_365d / 100) END AS usd
    FROM moved m JOIN {{cards}} USING (product_id) WHERE pct_365d <> 0),
  f AS (SELECT *, CASE section WHEN 'chase' THEN 1000 WHEN 'promo' THEN 1000 ELSE 500 END AS floor, CASE section WHEN 'chase' THEN 200 WHEN 'promo' THEN 200 ELSE 100 END AS least FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY abs(pct) DESC, product_id, printing) AS place FROM f
        WHERE section IS NOT NULL AND low_today >= floor AND low_today - usd >= floor AND abs(usd) >= least)
  SELECT section, CAST(place AS INTEGER) AS place, product_id, printing, pct, CAST(round(usd) AS BIGINT) AS usd, low_today FROM r WHERE place <= 10""")
def px14_report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX14, PRJ7, PRJ8, PRJ9, SR7, SR5: the ten largest yearly moves of each section, above its floors at both ends."""
    return movers.report_sections(_moved(spark, sf_dir), view(spark, sf_dir, "cards"), 365)


@query(f"""WITH {_movers_sql()}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY printing ORDER BY abs(pct_365d) DESC, product_id) AS INTEGER) AS place
  FROM moved WHERE pct_365d IS NOT NULL) SELECT printing, place, product_id, pct_365d FROM r WHERE place <= 10""")
def top_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR5, SR7: the ten largest yearly moves of each printing."""
    best = _moved(spark, sf_dir).where("pct_365d IS NOT NULL").withColumn("place", F.expr("row_number() OVER (PARTITION BY printing ORDER BY abs(pct_365d) DESC, product_id)"))
    return best.where("place <= 10").select("printing", "place", "product_id", "pct_365d")


@query(f"""WITH {_movers_sql()}, d AS (SELECT {_S}, low AS stored FROM {{prices}} WHERE price_date = DATE '2001-10-20')
  SELECT {_S}, low_today, low_date, pct_365d FROM moved JOIN d USING ({_S}) WHERE low_date = DATE '2001-10-20' AND abs(stored - low_today) < 0.5""")
def px15_live_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX15, SR4: movers whose low is that day's stored price."""
    return movers.drop_stale(_moved(spark, sf_dir), view(spark, sf_dir, "prices"), "2001-10-20").select("product_id", "printing", "low_today", "low_date", "pct_365d")


def _deltas_sql(source: str, as_of: str) -> str:
    windows = (1, 7, 30, 90, 180, 365)
    bases = ", ".join(f"arg_max(market, price_date) FILTER (price_date <= anchor - {n}) AS base_{n}d" for n in windows)
    return f"""WITH d AS (SELECT *, max(price_date) OVER (PARTITION BY {_S}) AS last FROM {source} WHERE market IS NOT NULL),
      a AS (SELECT *, greatest(last, DATE '{as_of}') AS anchor FROM d),
      g AS (SELECT {_S}, anchor, last, arg_max(market, price_date) AS now, {bases} FROM a GROUP BY {_S}, anchor, last)
      SELECT {_S}, now, {", ".join(percent_sql("now", f"base_{n}d", f"last > anchor - {n}") + f" AS pct_{n}d" for n in windows)} FROM g"""


@query(_deltas_sql("{set_prices}", "2001-10-25"))
def px11_series_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX11, MT6: six windows of each series, anchored at a date or its own last day."""
    return movers.series_deltas(view(spark, sf_dir, "set_prices"), "market", "2001-10-25")


@query(f"""WITH k AS (SELECT DISTINCT product_id, printing FROM {{prices}} WHERE printing = 'Normal')
  SELECT {_S}, max(price_date) AS price_date, arg_max(market, price_date) AS market FROM {{prices}} JOIN k USING ({_S}) WHERE market IS NOT NULL AND price_date < DATE '1999-06-01' GROUP BY ALL""")
def px8_prices_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX8, JN5: the newest market price strictly before a date, for a batch of series."""
    prices = view(spark, sf_dir, "prices")
    return movers.before(prices, prices.where("printing = 'Normal'").select("product_id", "printing").distinct(), "1999-06-01")


@query(f"""WITH s AS (SELECT p.* FROM {{prices}} p JOIN {{cards}} c USING (product_id) WHERE kind = 'sealed' AND (low IS NOT NULL OR market IS NOT NULL)),
  r AS (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY price_date DESC) AS rn, max(price_date) OVER () AS newest FROM s)
  SELECT {_S}, price_date, CASE WHEN low * 5 < market THEN market ELSE low END AS low, market, price_date < newest AS is_stale FROM r WHERE rn = 1""")
def px2_sealed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX2, PRJ5: newest prices of sealed products; a low under a fifth of market is no price and gives way to it."""
    sealed = view(spark, sf_dir, "cards").where("kind = 'sealed'").select("product_id")
    found = movers.latest(view(spark, sf_dir, "prices").join(sealed, "product_id", "left_semi"))
    return found.withColumn("low", F.expr("CASE WHEN low * 5 < market THEN market ELSE low END"))


def _standing_sql(basis: str, name: str) -> str:
    ok = {n: f"n_{n} >= 30 AND last_date - first_{n} >= {n} * 0.8 AND 100 * hi_{n} >= 115 * lo_{n}" for n, *_ in movers.STANDING}
    parts = ", ".join(
        f"count(*) FILTER ({w}) AS n_{n}, min(price_date) FILTER ({w}) AS first_{n}, min(v) FILTER ({w}) AS lo_{n}, max(v) FILTER ({w}) AS hi_{n}, count(*) FILTER ({w} AND v <= now) AS under_{n}"
        for n, *_ in movers.STANDING
        for w in [f"price_date >= last_date - {n}"]
    )
    pick = lambda f: "CASE " + " ".join(f"WHEN {ok[n]} THEN {f(n)}" for n, *_ in movers.STANDING) + " END"
    label = " ".join(
        f"WHEN days = {n} THEN CASE WHEN share <= 0.10 THEN 'cheapest in {noun}' WHEN share <= 0.25 THEN 'near its {adj} low' WHEN share >= 0.90 THEN 'near its {adj} high' END"
        for n, adj, noun in movers.STANDING
    )
    return f"""{name}_p AS (SELECT {_S}, price_date, {basis} AS v, count(*) OVER w AS points, max(price_date) OVER w AS last_date, arg_max({basis}, price_date) OVER w AS now
        FROM {{set_prices}} WHERE {basis} > 0 WINDOW w AS (PARTITION BY {_S})),
      {name}_g AS (SELECT {_S}, last_date, now, {parts} FROM {name}_p WHERE points >= 30 GROUP BY {_S}, last_date, now),
      {name}_s AS (SELECT {_S}, now, CAST({pick(lambda n: n)} AS INTEGER) AS days, {pick(lambda n: f"CAST(under_{n} AS DOUBLE) / n_{n}")} AS share FROM {name}_g),
      {name} AS (SELECT *, CASE WHEN share <= 0.10 THEN 'low' WHEN share <= 0.25 THEN 'near-low' WHEN share >= 0.90 THEN 'high' END AS tone, CASE {label} END AS label FROM {name}_s)"""


@query(f"WITH {_standing_sql('market', 'm')} SELECT * FROM m")
def price_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX12, WN16: tone of the newest price within the longest eligible window."""
    return movers.standing(view(spark, sf_dir, "set_prices"), "market")


@query(f"""WITH {_standing_sql('market', 'm')}, {_standing_sql('low', 'l')} SELECT {_S}, m.tone AS market_tone, l.tone AS low_tone,
  CASE WHEN m.tone = 'high' AND l.tone = 'high' THEN 'high' WHEN m.tone IN ('low', 'near-low') AND l.tone IN ('low', 'near-low') THEN CASE WHEN l.tone = 'near-low' THEN 'near-low' ELSE m.tone END END AS tone
  FROM m JOIN l USING ({_S})""")
def px13_agreed_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX13: the tone that market and low agree on."""
    prices = view(spark, sf_dir, "set_prices")
    market, low = (movers.standing(prices, b).select("product_id", "printing", F.col("tone").alias(f"{b}_tone")) for b in ("market", "low"))
    return market.join(low, ["product_id", "printing"]).withColumn("tone", movers.agreed_standing("market_tone", "low_tone"))


def _index_sql(dims: str = "{traded}") -> str:
    deal = " UNION ALL ".join(
        f"SELECT '{name}' AS scope, {' || chr(124) || '.join(key) if key else chr(39) * 2} AS scope_key, price_date, ret FROM rets WHERE {where}" for name, key, where in index.SCOPES
    )
    return f"""px AS (SELECT t.*, d.* EXCLUDE (product_id), coalesce(market, low) AS v FROM {{ticks}} t JOIN {dims} d USING (product_id)
        WHERE coalesce(market, low) > 0 AND price_date >= floor_date AND NOT (kind = 'sealed' AND product_type IS NOT DISTINCT FROM 'Promo Single')),
      stepped AS (SELECT *, lag(v) OVER w AS prev, price_date - lag(price_date) OVER w AS gap FROM px WINDOW w AS (PARTITION BY {_S} ORDER BY price_date)),
      rets AS (SELECT *, CAST(round(least(greatest(CAST(v AS DOUBLE) / prev, 0.5), 2.0) * 1000000000) AS BIGINT) AS ret FROM stepped WHERE prev > 0 AND gap <= 7),
      dealt AS ({deal}),
      daily AS (SELECT scope, scope_key, price_date, CAST(sum(ret) AS BIGINT) AS total, count(*) AS n FROM dealt GROUP BY ALL),
      scored AS (SELECT *, max(n) OVER (PARTITION BY scope, scope_key ORDER BY price_date ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS universe FROM daily),
      logs AS (SELECT *, sum(ln(CAST(total AS DOUBLE) / n / 1000000000)) OVER (PARTITION BY scope, scope_key ORDER BY price_date) AS cum FROM scored WHERE n >= 5 AND n >= 0.6 * universe),
      idx AS (SELECT scope, scope_key, price_date, round(exp(cum - first_value(cum) OVER (PARTITION BY scope, scope_key ORDER BY price_date)) * 100, 4) AS value, n, universe FROM logs)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.market_index(view(spark, sf_dir, "ticks"), view(spark, sf_dir, "traded"))


@query(f"WITH {_index_sql()} SELECT * FROM idx")
def market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX5, WN5, WN7, WN8, WN9, AG11, AG13: chain-linked indexes of eight scopes."""
    return _index(spark, sf_dir)


@query(f"""WITH {_index_sql()}, l AS (SELECT *, max(price_date) OVER (PARTITION BY scope, scope_key) AS last FROM idx),
  g AS (SELECT scope, scope_key, max(price_date) AS price_date, arg_max(value, price_date) AS value, arg_max(n, price_date) AS n, arg_max(universe, price_date) AS universe,
        {", ".join(f"arg_max(value, price_date) FILTER (price_date <= last - {n}) AS v_{n}d" for n in (1, 7, 30, 90, 180, 365))} FROM l GROUP BY scope, scope_key)
  SELECT scope, scope_key, price_date, value, n, universe, {", ".join(f"CASE WHEN v_{n}d > 0 THEN round((value - v_{n}d) / v_{n}d * 100, 2) END AS pct_{n}d" for n in (1, 7, 30, 90, 180, 365))} FROM g""")
def px6_index_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX6: newest value of each index and its moves."""
    return index.index_latest(_index(spark, sf_dir))


@query(f"""WITH basket AS (SELECT * FROM {{traded}} WHERE product_id % 3 = 0), {_index_sql("basket")} SELECT price_date, value, n, universe FROM idx WHERE scope = 'all'""")
def px7_basket_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX7: the index of a basket of products (every third one here, as a user's list)."""
    basket = view(spark, sf_dir, "traded").where("product_id % 3 = 0")
    return index.market_index(view(spark, sf_dir, "ticks"), basket, index.SCOPES[:1]).select("price_date", "value", "n", "universe")


@query(f"""WITH {_index_sql()}, g AS (SELECT scope, scope_key, max(value) FILTER (price_date = DATE '2024-01-28') AS now, max(n) FILTER (price_date = DATE '2024-01-28') AS n,
    arg_max(value, price_date) FILTER (price_date <= DATE '2024-01-21') AS v_7, arg_max(value, price_date) FILTER (price_date <= DATE '2023-12-29') AS v_30 FROM idx GROUP BY ALL)
  SELECT scope, scope_key, CASE WHEN v_7 <> 0 THEN round((now / v_7 - 1) * 100, 4) END AS week, CASE WHEN v_30 <> 0 THEN round((now / v_30 - 1) * 100, 4) END AS month FROM g
  WHERE now IS NOT NULL AND scope IN ('all', 'chase', 'sealed', 'set', 'rarity') AND (scope <> 'set' OR n >= 40) AND EXISTS (FROM idx WHERE scope = 'all' AND price_date = DATE '2024-01-28')""")
def px17_market_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX17: moves of the indexes that are current on a date; sets of 40 components or more."""
    return index.pulse(_index(spark, sf_dir), "2024-01-28", min_components=40)


@query(f"""WITH {_index_sql()}, c AS (SELECT max(f) AS common FROM (SELECT min(price_date) AS f FROM idx GROUP BY scope, scope_key))
  SELECT scope, scope_key, price_date, round((value / first_value(value) OVER (PARTITION BY scope, scope_key ORDER BY price_date) - 1) * 100, 4) AS change FROM idx, c WHERE price_date >= common""")
def px18_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX18: all indexes as changes since their common first day."""
    return index.rebase(_index(spark, sf_dir))


#: Days of ticks; every fifth repeats the day before, but for some products.
_SNAPSHOTS = """SELECT product_id, printing, price_date, low, market FROM {ticks} WHERE day(price_date) % 5 <> 0
  UNION ALL SELECT product_id, printing, CAST(price_date + 1 AS DATE), CASE WHEN product_id % 10 = day(price_date) % 10 AND day(price_date) > 9 THEN low + 1 ELSE low END, market FROM {ticks} WHERE day(price_date) % 5 = 4"""


@query(f"""WITH p AS ({_SNAPSHOTS}), d AS (SELECT price_date, lag(price_date) OVER (ORDER BY price_date) AS last FROM (SELECT DISTINCT price_date FROM p)),
  c AS (SELECT p.price_date, count(q.product_id) AS compared, count(*) FILTER (q.product_id IS NOT NULL AND p.low IS NOT DISTINCT FROM q.low AND p.market IS NOT DISTINCT FROM q.market) AS matched
    FROM p JOIN d USING (price_date) LEFT JOIN p q ON q.price_date = d.last AND q.product_id = p.product_id AND q.printing = p.printing GROUP BY p.price_date)
  SELECT price_date, compared, matched, compared > 0 AND CAST(matched AS DOUBLE) / compared > 0.95 AS stale FROM c""")
def px26_snapshot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX26: days whose prices are those of the last available day, which a loader skips."""
    return snapshot_gate(rows_of(spark, sf_dir, _SNAPSHOTS))


@query("""WITH j AS (SELECT c.set_id, c.rarity, p.* FROM {prices} p JOIN {cards} c USING (product_id) WHERE c.set_id IS NOT NULL AND c.rarity IS NOT NULL)
  SELECT set_id, rarity, printing, price_date, CAST((2 * sum(low) + count(low)) // (2 * count(low)) AS BIGINT) AS avg_low, CAST((2 * sum(market) + count(market)) // nullif(2 * count(market), 0) AS BIGINT) AS avg_market,
    CAST((2 * sum(CASE WHEN low < 95000 THEN 0 ELSE low END) + count(low)) // (2 * count(low)) AS BIGINT) AS avg_low_floored,
    CAST((2 * sum(CASE WHEN market < 95000 THEN 0 ELSE market END) + count(market)) // nullif(2 * count(market), 0) AS BIGINT) AS avg_market_floored, count(*) AS n_cards FROM j GROUP BY set_id, rarity, printing, price_date""")
def px3_group_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX3, AG1: averages by set, rarity, printing and day, low and market, and with cheap cards as nothing (a floor within the table's prices)."""
    return group_averages(view(spark, sf_dir, "prices"), view(spark, sf_dir, "cards"), floor=95000)
