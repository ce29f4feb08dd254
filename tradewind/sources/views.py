"""The library's tables (cards, prices, sales, matches, places, ...) out of the Parquet tables of a data folder.

Each view is one SELECT in SQL that Spark and DuckDB read alike, so a query and
the SQL that checks it start from the same rows.  Money is in whole cents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tradewind.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "conversations")

#: Views by name; {x} is a table of the folder or a view above.
VIEWS = {
    "sets": """SELECT p_brand AS set_id, CAST(substring(p_brand, 7) AS INT) AS set_no, count(*) AS n_cards,
        CASE WHEN p_brand <> 'Brand#25' THEN CAST(DATE '1994-11-30' + 14 * CAST(substring(p_brand, 7) AS INT) AS DATE) END AS released_at
        FROM {part} GROUP BY p_brand""",
    "cards": """SELECT CAST(p_partkey AS BIGINT) AS product_id, concat('crd_', p_partkey) AS card_id, p_brand AS set_id, p_name AS name,
        CASE p_type WHEN 'ECONOMY' THEN 'Common' WHEN 'STANDARD' THEN 'Rare' WHEN 'MEDIUM' THEN 'Super Rare' WHEN 'LARGE' THEN 'Enchanted'
          WHEN 'SMALL' THEN 'Epic' ELSE 'Promo' END AS rarity,
        CASE p_partkey % 7 WHEN 0 THEN 'Amber' WHEN 1 THEN 'Amethyst' WHEN 2 THEN 'Emerald' WHEN 3 THEN 'Ruby' WHEN 4 THEN 'Sapphire' WHEN 5 THEN 'Steel' END AS ink,
        CASE WHEN p_size > 45 THEN 'sealed' ELSE 'card' END AS kind,
        CASE WHEN p_size > 45 THEN CASE p_size WHEN 46 THEN 'Booster Box' WHEN 47 THEN 'Starter Deck' WHEN 48 THEN 'Promo Single' ELSE 'Gift Set' END END AS product_type,
        CAST(p_size AS INT) AS collector_number, CAST(round(p_retailprice * 100) AS BIGINT) AS list_price, p_partkey % 5 = 1 AS split_printing, p_partkey % 5 < 3 AS foil_split
        FROM {part}""",
    "floors": """SELECT c.product_id, coalesce(CAST(s.released_at + 1 AS DATE), DATE '1900-01-01') AS floor_date FROM {cards} c LEFT JOIN {sets} s ON s.set_id = c.set_id""",
    "units": """SELECT CAST(l_partkey AS BIGINT) AS product_id, CASE l_returnflag WHEN 'A' THEN 'Normal' WHEN 'N' THEN 'Cold Foil' ELSE 'Holofoil' END AS printing,
        CAST(l_shipdate AS DATE) AS price_date, CAST(floor(round(l_extendedprice * 100) / l_quantity) AS BIGINT) AS unit FROM {lineitem}""",
    "prices": """SELECT product_id, printing, price_date, min(unit) AS low,
        CASE WHEN day(price_date) % 10 <> 3 THEN CAST(floor(CAST(sum(unit) AS DOUBLE) / count(unit)) AS BIGINT) END AS market FROM {units} GROUP BY product_id, printing, price_date""",
    "set_prices": """SELECT s.set_no AS product_id, p.printing, p.price_date, min(p.low) AS low, CAST(floor(CAST(sum(p.market) AS DOUBLE) / count(p.market)) AS BIGINT) AS market
        FROM {prices} p JOIN {cards} c ON c.product_id = p.product_id JOIN {sets} s ON s.set_id = c.set_id GROUP BY s.set_no, p.printing, p.price_date""",
    "set_days": """SELECT product_id, 'All' AS printing, price_date, min(low) AS low, min(market) AS market FROM {set_prices} GROUP BY product_id, price_date""",
    "ticks": """SELECT user_id AS product_id, event_type AS printing, CAST(ts AS DATE) AS price_date, min(CAST(round(value * 100) AS BIGINT)) AS low,
        CASE WHEN count(*) % 4 <> 3 THEN CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) END AS market FROM {events} GROUP BY user_id, event_type, CAST(ts AS DATE)""",
    "traded": """SELECT user_id AS product_id, CASE WHEN user_id % 10 = 9 THEN 'sealed' ELSE 'card' END AS kind, concat('Set', user_id % 6) AS set_id,
        CASE user_id % 5 WHEN 0 THEN 'Common' WHEN 1 THEN 'Rare' WHEN 2 THEN 'Enchanted' WHEN 3 THEN 'Epic' END AS rarity,
        CASE user_id % 4 WHEN 0 THEN 'Amber' WHEN 1 THEN 'Ruby' WHEN 2 THEN 'Steel' END AS ink,
        CASE WHEN user_id % 20 = 9 THEN 'Booster Box' WHEN user_id % 20 = 19 THEN 'Promo Single' END AS product_type,
        DATE '2023-12-31' + CAST(user_id % 6 AS INT) AS floor_date FROM (SELECT DISTINCT user_id FROM {events}) u""",
    "sales": """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_partkey) AS item_id, CAST(l_partkey AS BIGINT) AS card_id,
        CASE l_returnflag WHEN 'A' THEN 'PSA' WHEN 'N' THEN 'BGS' ELSE 'CGC' END AS grader, CAST(10 - l_linenumber % 2 AS INT) AS grade,
        CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 4 = 1 THEN 'Holofoil' WHEN l_suppkey % 4 = 2 THEN 'Normal' ELSE 'Foil' END AS printing,
        CAST(floor(round(l_extendedprice * 100) / l_quantity) * CASE WHEN l_orderkey % 97 = 0 THEN 9 ELSE 1 END AS BIGINT) AS sale_price, CAST(l_shipdate AS DATE) AS sold_date,
        CAST(CAST(l_shipdate AS DATE) + CAST(l_orderkey % 9 AS INT) AS DATE) AS scraped_date, l_discount >= 0.095 AS excluded FROM {lineitem}""",
    "events_held": """SELECT DISTINCT CAST((year(o_orderdate) * 12 + month(o_orderdate)) AS BIGINT) AS event_id, concat('Cup ', year(o_orderdate), '-', month(o_orderdate)) AS name,
        CAST((year(o_orderdate) * 12 + month(o_orderdate)) % 9 AS BIGINT) AS store_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS event_date,
        concat('S', year(o_orderdate)) AS season, CAST(40 + month(o_orderdate) AS INT) AS num_players FROM {orders}""",
    "players": """SELECT CAST(k AS BIGINT) AS player_id, concat('Player ', k) AS display_name, CASE WHEN k % 3 = 0 THEN 'melee' ELSE 'rph' END AS platform,
        CASE WHEN k = 96 THEN CAST(95 AS BIGINT) WHEN k >= 90 THEN CAST(k - 90 AS BIGINT) END AS merged_into_id FROM (SELECT DISTINCT o_custkey % 97 AS k FROM {orders}) x""",
    "matches": """SELECT o_orderkey AS match_id, CAST((year(o_orderdate) * 12 + month(o_orderdate)) AS BIGINT) AS event_id, CAST(o_orderkey % 7 + 1 AS INT) AS round_number,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 11 AS INT) END AS table_number, CAST(o_custkey % 97 AS BIGINT) AS player1_id,
        CASE WHEN o_orderkey % 41 <> 0 THEN CAST((o_custkey * 7 + o_orderkey) % 97 AS BIGINT) END AS player2_id,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 3 AS INT) END AS games_won_p1,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_orderkey / 3) % 3 AS INT) END AS games_won_p2, o_orderkey % 41 = 0 AS is_bye,
        o_orderkey % 29 = 0 AS is_intentional_draw FROM {orders} WHERE o_orderkey % 41 = 0 OR o_custkey % 97 <> (o_custkey * 7 + o_orderkey) % 97""",
    "ratings": """SELECT 2 * m.match_id + s.side AS rating_id, m.match_id,
        CASE WHEN s.side = 0 THEN coalesce(a2.merged_into_id, a.merged_into_id, m.player1_id) ELSE coalesce(b2.merged_into_id, b.merged_into_id, m.player2_id) END AS player_id,
        CASE WHEN s.side = 1 THEN coalesce(a2.merged_into_id, a.merged_into_id, m.player1_id) ELSE coalesce(b2.merged_into_id, b.merged_into_id, m.player2_id) END AS opponent_id,
        CASE WHEN coalesce(games_won_p1, 0) = coalesce(games_won_p2, 0) THEN 0.5E0 WHEN (coalesce(games_won_p1, 0) > coalesce(games_won_p2, 0)) = (s.side = 0) THEN 1.0E0 ELSE 0.0E0 END AS score,
        CAST(1300 + (m.match_id * 13 + s.side * 57 + m.player1_id * 31) % 400 AS DOUBLE) AS rating_before,
        CAST(1300 + (m.match_id * 13 + s.side * 57 + m.player1_id * 31) % 400 + (m.match_id * 7 + s.side) % 41 - 20 AS DOUBLE) AS rating_after,
        CAST(1300 + (m.match_id * 17 + s.side) % 400 AS DOUBLE) AS opponent_rating
        FROM {matches} m CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1) s
        LEFT JOIN {players} a ON a.player_id = m.player1_id LEFT JOIN {players} a2 ON a2.player_id = a.merged_into_id
        LEFT JOIN {players} b ON b.player_id = m.player2_id LEFT JOIN {players} b2 ON b2.player_id = b.merged_into_id WHERE NOT m.is_bye""",
    "official": """SELECT CAST((year(o_orderdate) * 12 + month(o_orderdate)) AS BIGINT) AS event_id, CAST(o_custkey % 97 AS BIGINT) AS player_id, CAST(min(o_orderkey % 32) + 1 AS INT) AS place,
        CAST(count(*) AS INT) AS matches_won, CAST(max(o_orderkey % 3) AS INT) AS matches_lost, CASE WHEN min(o_orderkey) % 2 = 0 THEN CAST(count(*) * 3 AS INT) END AS match_points
        FROM {orders} WHERE o_orderstatus = 'F' GROUP BY CAST((year(o_orderdate) * 12 + month(o_orderdate)) AS BIGINT), CAST(o_custkey % 97 AS BIGINT)""",
    "places": """SELECT o_orderkey AS event_id, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS store_id, concat('Street ', o_custkey % 400) AS full_address, concat('Town ', o_custkey % 40) AS city,
        CASE WHEN o_orderkey % 4 = 0 THEN 'championship' ELSE 'weekly' END AS kind, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS gameplay_format, concat('Night ', o_orderkey) AS name,
        o_orderdate + make_interval(0, 0, 0, 0, CAST(17 + o_custkey % 4 AS INT), 0, 0) AS start_datetime,
        CASE o_custkey % 5 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/Paris' WHEN 2 THEN 'Nowhere/None' WHEN 3 THEN 'UTC' END AS timezone,
        CAST(38 + o_custkey % 173 / 40.0E0 AS DOUBLE) AS latitude, CAST(-77 + o_custkey % 211 / 40.0E0 AS DOUBLE) AS longitude FROM {orders}""",
    "rules": """SELECT c_custkey AS rule_id, c_custkey % 11 <> 0 AS enabled, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 40 END AS watchlist_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS product_id,
        CASE WHEN c_custkey % 3 = 0 THEN CASE c_custkey % 4 WHEN 0 THEN 'Cold Foil' WHEN 1 THEN 'Normal' WHEN 2 THEN 'Etched' END END AS printing,
        CASE WHEN c_custkey % 2 = 0 THEN 'low' ELSE 'market' END AS basis, CASE c_custkey % 5 WHEN 0 THEN 'above' WHEN 1 THEN 'below' WHEN 2 THEN 'pct_up' WHEN 3 THEN 'pct_down' ELSE 'sideways' END AS kind,
        CAST(CASE c_custkey % 5 WHEN 0 THEN 150000 WHEN 1 THEN 95000 WHEN 2 THEN 4 ELSE -4 END AS DOUBLE) AS threshold,
        CASE WHEN c_custkey % 7 < 5 THEN '365d' ELSE '180d' END AS window_key, CAST(c_custkey % 10 AS INT) AS cooldown_days FROM {customer}""",
    "watchlists": """SELECT p_partkey % 40 AS watchlist_id, CAST(p_partkey AS BIGINT) AS product_id, CASE p_partkey % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Cold Foil' WHEN 2 THEN 'Holofoil' ELSE 'Etched' END AS printing
        FROM {part} WHERE p_size < 20""",
    "fired_before": """SELECT c_custkey AS rule_id, c_custkey AS product_id, CASE WHEN c_custkey % 4 = 0 THEN 'Cold Foil' ELSE 'Normal' END AS printing, CAST(DATE '2001-11-04' - CAST(c_custkey % 12 AS INT) AS DATE) AS fired_on
        FROM {customer} WHERE c_custkey % 3 = 0""",
    "holdings": """SELECT CAST(p_partkey AS BIGINT) AS product_id, CASE WHEN p_partkey % 2 = 0 THEN 'Normal' ELSE 'Cold Foil' END AS printing, CAST(p_size % 4 + 1 AS INT) AS quantity,
        CASE WHEN p_partkey % 3 <> 0 THEN CAST(DATE '1999-01-01' + CAST(p_partkey % 700 AS INT) AS DATE) END AS acquired FROM {part}""",
    "slots": """SELECT CAST(p_partkey AS BIGINT) AS slot_id, CAST(p_partkey AS BIGINT) AS card_id, CASE p_partkey % 3 WHEN 0 THEN 'PSA' WHEN 1 THEN 'BGS' ELSE 'CGC' END AS grader, CAST(9 + p_partkey % 2 AS INT) AS grade,
        CASE p_partkey % 6 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Holofoil' WHEN 2 THEN 'Cold Foil' WHEN 3 THEN 'Two Swords' WHEN 4 THEN 'Foil' END AS printing FROM {part}""",
    "decks": """SELECT o_orderkey AS deck_id, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 12 + 1 AS INT) AS place_rank, o_orderkey % 9 AS event_id FROM {orders}""",
    "titles": """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_partkey) AS item_id, CAST(l_partkey AS BIGINT) AS card_id, p_brand AS set_id, CAST(l_shipdate AS DATE) AS sold_date,
        concat(p_name, ' ', CAST(p_size AS STRING), '/204 ', CASE l_suppkey % 32 WHEN 0 THEN 'PSA 10' WHEN 1 THEN 'CGC9.5' WHEN 2 THEN 'GEM MINT 10 BGS' WHEN 3 THEN 'lot of 3' WHEN 4 THEN 'booster box' WHEN 5 THEN 'in toploader' WHEN 6 THEN 'ungraded'
          WHEN 7 THEN 'japanese PSA 9' WHEN 8 THEN 'PSA 10 CONTENDER' WHEN 9 THEN 'signed PSA 10' WHEN 10 THEN 'Cold Foil PSA 9.5' WHEN 11 THEN 'non-foil CGC 10' WHEN 12 THEN 'foil BECKETT 9' WHEN 13 THEN 'kingdom hearts' WHEN 14 THEN '7x cards' WHEN 15 THEN '2X Sword SGC 8'
          WHEN 16 THEN 'PSA 10 + PSA 9 other' WHEN 17 THEN 'prerelease trove' WHEN 18 THEN 'promo enamel pins' WHEN 19 THEN 'DE PSA 8' WHEN 20 THEN 'Cruella de vil DE PSA 8' WHEN 21 THEN 'TAG Grade 9' WHEN 22 THEN 'holo' WHEN 23 THEN 'slab PSA'
          WHEN 24 THEN 'PSA gem mt 10' WHEN 25 THEN 'Set of 2 autographed' WHEN 26 THEN '' WHEN 27 THEN 'BGS 9.5 KOR' WHEN 28 THEN 'would grade 10' WHEN 29 THEN 'Pins: Brave PSA 10' WHEN 30 THEN 'MINT 9 CGC' ELSE 'raw card' END) AS title FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "catalog_cards": """SELECT concat('crd_', p_partkey) AS card_id, set_name, CASE WHEN p_partkey % 53 = 0 THEN set_name ELSE concat('Hero', p_partkey % 61) END AS name,
        CASE WHEN p_partkey % 53 <> 0 OR p_partkey % 2 = 0 THEN concat('Keep', p_partkey % 151, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(' ', p_name) END) END AS version,
        CASE WHEN p_partkey % 29 = 0 THEN concat(p_size, 'ja') WHEN p_partkey % 29 = 1 THEN concat(p_size, 'zh') WHEN p_partkey % 31 = 0 THEN concat(p_size, 'B') WHEN p_partkey % 5 = 0 THEN concat('0', p_size)
          ELSE CAST(p_size + CASE WHEN p_partkey % 3 = 0 THEN 150 ELSE 0 END AS STRING) END AS collector_number,
        CASE p_type WHEN 'ECONOMY' THEN 'Common' WHEN 'STANDARD' THEN 'Rare' WHEN 'MEDIUM' THEN 'Super Rare' WHEN 'LARGE' THEN 'Enchanted' WHEN 'SMALL' THEN 'Epic' ELSE 'Promo' END AS rarity,
        CASE WHEN set_no <> 25 THEN CAST(DATE '1994-11-30' + 90 * set_no AS DATE) END AS released_at
        FROM (SELECT *, CASE CAST(substring(p_brand, 7) AS INT) WHEN 1 THEN 'The First Chapter' WHEN 2 THEN 'Rise of the Floodborn' WHEN 3 THEN 'Into the Inklands' WHEN 4 THEN 'Shimmering Skies' WHEN 5 THEN 'Azurite Sea' WHEN 6 THEN 'Reign of Jafar'
          WHEN 7 THEN 'Fabled' WHEN 8 THEN 'Winterspell' WHEN 9 THEN 'Attack of the Vine!' WHEN 10 THEN 'Promo Set 1' WHEN 11 THEN 'Promo Set 2' WHEN 12 THEN 'D23 Collection' WHEN 13 THEN 'Challenge Promo' WHEN 14 THEN 'Lorcana Challenge Year 3'
          ELSE concat('Set ', substring(p_brand, 7)) END AS set_name, CAST(substring(p_brand, 7) AS INT) AS set_no FROM {part}) p""",
    "listings": """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_partkey) AS item_id, CASE WHEN l_suppkey % 17 <> 0 THEN CAST(date_trunc('year', l_shipdate) AS DATE) END AS sold_date,
        concat('Lorcana ', name, CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' - ', coalesce(version, '')) WHEN 2 THEN concat(' ', lower(coalesce(version, ''))) ELSE upper(concat(' ', coalesce(version, ''))) END,
          CASE l_suppkey % 9 WHEN 0 THEN concat(' #', collector_number) WHEN 1 THEN concat(' ', collector_number, '/204') WHEN 3 THEN concat(' ', collector_number) WHEN 4 THEN concat(' #', 200 + l_suppkey % 5) WHEN 5 THEN concat(' ', l_suppkey % 40, '/P1')
            WHEN 6 THEN concat(' #', l_suppkey % 30, 'B') WHEN 7 THEN ' 10/10/9.5 pop 7 2nd' WHEN 8 THEN concat(' ', l_suppkey % 20, '/C1') ELSE '' END,
          CASE l_suppkey % 13 WHEN 0 THEN ' PSA 10 EN 7' WHEN 1 THEN ' D23 Collection CGC9.5' WHEN 2 THEN ' D23 Expo 1st Edition 2022' WHEN 3 THEN ' Enchanted PSA 9' WHEN 4 THEN concat(' ', set_name) WHEN 5 THEN ' Japanese' WHEN 6 THEN ' Epic BGS 9.5' WHEN 7 THEN ' lot of 3'
            WHEN 8 THEN ' Azurite PSA 10' WHEN 9 THEN ' Top Prize #D23' WHEN 10 THEN ' attack of the vine 118 Chinese' WHEN 11 THEN ' D23 Promos EN11' ELSE ' slab' END) AS title
        FROM {lineitem} JOIN {catalog_cards} ON card_id = concat('crd_', l_partkey)""",
    "decklists": """SELECT l_orderkey AS deck_id, CASE l_orderkey % 9 WHEN 0 THEN '1st' WHEN 1 THEN '2nd' WHEN 2 THEN 'Top 8' WHEN 3 THEN 'T16' WHEN 4 THEN '5th' WHEN 5 THEN ' ' WHEN 6 THEN '3' WHEN 7 THEN 'winner' END AS place,
        array_join(array_sort(collect_list(concat(CASE l_linenumber % 9 WHEN 8 THEN '# note ' WHEN 7 THEN '' ELSE concat(CAST(l_quantity % 5 AS INT), CASE WHEN l_linenumber % 2 = 0 THEN 'x ' ELSE ' ' END) END,
          CASE WHEN l_suppkey % 13 = 0 THEN 'Unknown Hero' ELSE upper(p_name) END))), chr(10)) AS decklist FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey""",
    "deck_cards": """SELECT l_orderkey AS deck_id, CAST(l_partkey AS BIGINT) AS product_id, CAST(l_linenumber AS INT) AS line, CAST(l_quantity % 6 + 1 AS INT) AS quantity FROM {lineitem}""",
}


#: What the views spell otherwise in DuckDB.
SPELLINGS = (
    ("make_interval(0, 0, 0, 0, CAST(17 + o_custkey % 4 AS INT), 0, 0)", "to_hours(CAST(17 + o_custkey % 4 AS INT))"),
    ("array_join(array_sort(collect_list(", "array_to_string(list_sort(list("),
)


def _names(sql: str) -> list[str]:
    return re.findall(r"{(\w+)}", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in dict.fromkeys(_names(VIEWS[name]))})


def rows_of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over tables and views, in the SQL that both engines read."""
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in dict.fromkeys(_names(sql))})


def with_views(sql: str) -> str:
    """SQL for DuckDB: {x} of views become common table expressions in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in _names(text):
            if n not in TABLES and n not in needed:
                need(VIEWS[n])
                needed.append(n)

    need(sql)
    own = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if own and body[:15].upper() == "WITH RECURSIVE ":
        body = f"WITH RECURSIVE {own}, {body[15:]}"
    elif own and body[:5].upper() == "WITH ":
        body = f"WITH {own}, {body[5:]}"
    elif own:
        body = f"WITH {own} {body}"
    body = re.sub(r"{(\w+)}", r"\1", body)
    for spark_form, duck_form in SPELLINGS:
        body = body.replace(spark_form, duck_form)
    return body
