"""Steps that larger tables need: computed once, spread over tasks, or on distinct rows."""

from pyspark.sql import functions as F

from tradewind.sinks.decks import COLUMNS, KEYS, import_decks
from tradewind.sinks.shared import shared_path
from tradewind.sinks.versions import VersionedTable


def test_import_computes_its_decks_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    resolved = spark.createDataFrame([(1, "2 crd_1\n1 crd_2"), (2, "3 crd_3")], "deck_id bigint, entries string")
    resolved = resolved.mapInArrow(counted, resolved.schema)
    problems = spark.createDataFrame([(1, ""), (2, "unmatched lines")], "deck_id bigint, problems string")
    table = VersionedTable(spark, shared_path(spark, "larger"), COLUMNS, KEYS)
    assert import_decks(table, resolved, problems, 0) and not import_decks(table, resolved, problems, 0)
    assert seen.value == 2
    assert sorted(map(tuple, table.rows().collect())) == [(1, "crd_1", 2), (1, "crd_2", 1)]


def test_links_compare_each_pair_of_names_once(spark):
    from tradewind.operators.catalog import linked_events

    wanted = spark.range(300).selectExpr("id AS wid", "DATE '2024-05-01' AS day", "concat('Grand malmogameweek s', id % 2, '00') AS name")
    events = spark.range(400).selectExpr("id AS eid", "DATE '2024-05-02' AS day", "concat('Malmo s', id % 4, '00') AS name")
    twice = wanted.union(wanted).union(wanted.where("wid = 0").selectExpr("wid", "day", "concat(name, ' more') AS name"))
    found = linked_events(twice, events)
    assert found.count() == 300 * 400 and found.distinct().count() == 300 * 400
    assert {tuple(r) for r in found.where("wid < 2 AND eid < 2").collect()} == {(0, 0, "malmogameweek,s000"), (1, 0, "malmogameweek"), (0, 1, "malmogameweek"), (1, 1, "malmogameweek,s100")}
    # words meet in pairs of names and days, never in pairs of ids
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "wid#" in line and " w#" in line]


def test_alike_rules_of_a_list_are_looked_up_once(spark):
    from tradewind.operators.alerts import WINDOWS, fired

    rules = spark.range(50).selectExpr("id AS rule_id", "true AS enabled", "7L AS watchlist_id", "CAST(NULL AS bigint) AS product_id", "CAST(NULL AS string) AS printing", "'low' AS basis", "'above' AS kind", "10D AS threshold", "'7d' AS window_key", "CASE WHEN id <> 4 THEN 3 END AS cooldown_days")
    items = spark.range(40).selectExpr("7L AS watchlist_id", "id AS product_id", "CASE WHEN id % 2 = 0 THEN 'Foil' END AS printing")
    moves = [f"CAST(0 AS double) AS {p}_{w}" for p in ("pct", "mkt_pct") for w in WINDOWS]
    moved = spark.range(40).selectExpr("id AS product_id", "'Normal' AS printing", "id AS low_today", "id AS market_today", *moves)
    history = spark.createDataFrame([(0, 20, "Normal", "2024-05-01"), (1, 20, "Normal", "2024-04-01"), (2, 20, "Foil", "2024-05-01"), (3, 21, None, "2024-05-01"), (4, 22, "Normal", "2024-01-01")], "rule_id bigint, product_id bigint, printing string, fired_on string").withColumn("fired_on", F.to_date("fired_on"))
    found = fired(rules, items, moved, history, "2024-05-02")
    # 30 cards of 10 and more under 50 rules, less the one that fired yesterday and the one whose cooldown is unknown
    rows = {tuple(r) for r in found.collect()}
    assert len(rows) == found.count() == 50 * 30 - 2 and (0, 20, "Normal", 20.0) not in rows and (1, 20, "Normal", 20.0) in rows and (4, 22, "Normal", 22.0) not in rows
    # a rule's history lies with the rule: the rows that fire are not joined with it
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(quiet" in plan


def test_batches_are_spread_over_files_and_stay_batches(spark):
    from tradewind.streaming.runs import each_batch, in_batches

    rows = spark.range(400).selectExpr("id", "timestamp_seconds(CASE WHEN id < 397 THEN id ELSE 100000 + id * 400 END) AS at")
    stream, seen = in_batches(rows, F.col("at"), 4, "spread", rows_per_file=20), []
    each_batch(stream, "spread", lambda batch, number: seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count())))
    # five files a batch, whatever it holds, and all of a batch's rows in its turn
    assert [n for n, _ in seen if n] == [397, 3] and seen[0][1] == 5


def test_values_under_the_threshold_move_the_watermark(spark):
    from tradewind.streaming.alerts import cooled_alerts
    from tradewind.streaming.runs import in_batches, run_once

    rows = spark.createDataFrame([(1, 3600, 90.0), (2, 7200, 95.0), (3, 90000, 1.0)], "user bigint, s bigint, value double").selectExpr("user", "timestamp_seconds(s) AS ts", "value")
    found = run_once(cooled_alerts(in_batches(rows, F.col("ts"), 2, "low"), "user", "value", "ts", 80.0, 2, "6 hours"), "low")
    assert sorted(r.user for r in found.collect()) == [1, 2]


def test_names_of_the_same_words_are_scored_once(spark):
    from tradewind.operators.search import resolve_names

    cards = spark.range(3000).selectExpr("id AS cid", "CASE WHEN id % 3 = 0 THEN 'Red Ring' WHEN id % 3 = 1 THEN 'ring red' ELSE concat('Blue Bolt ', id % 2) END AS name")
    queries = spark.range(200).selectExpr("id AS qid", "CASE WHEN id < 199 THEN 'red ring' ELSE 'bolt 1' END AS text")
    found = resolve_names(queries, cards)
    rows = {tuple(r) for r in found.collect()}
    assert len(rows) == found.count() == 200 * 5
    assert {r for r in rows if r[0] == 7} == {(7, c, 1.0, p + 1) for p, c in enumerate((0, 1, 3, 4, 6))}
    assert {r[1] for r in rows if r[0] == 199} == {5, 11, 17, 23, 29}
    # words are joined for one card and one query of the same words
    assert "first" in found._jdf.queryExecution().optimizedPlan().toString()


def test_titles_are_read_once(spark):
    from tradewind.functions.titles import read_once

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        seen.add(1)
        return title and title.upper()

    rows = spark.range(900).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'psa 10' WHEN 1 THEN 'raw' END AS title")
    found = read_once(rows, {"said": counted("title")}).collect()
    assert seen.value == 3
    assert len(found) == 900 and {(r.title, r.said) for r in found} == {("psa 10", "PSA 10"), ("raw", "RAW"), (None, None)}


def test_trigrams_of_long_texts_take_time_in_proportion(spark):
    import time

    from tradewind.functions.text import trigrams

    texts = ["abcabcd", "aé🂡xé", "ab", "", None]
    want = [["abc", "bca", "cab", "bcd"], ["aé🂡", "é🂡x", "🂡xé"], [], [], []]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.q for r in rows.select("i", trigrams("t").alias("q")).orderBy("i").collect()] == want
    began = time.monotonic()
    long = spark.range(4).selectExpr("repeat(concat('abcdefgh', id), 60000) AS t").withColumn("q", trigrams("t"))
    assert {r.n for r in long.where(F.size("q") > 2).select(F.size("q").alias("n")).collect()} == {9}
    assert time.monotonic() - began < 40


def test_listings_are_read_once_and_whole_names_decided_alone(spark):
    from tradewind.operators.listings import match_titles

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    sales = spark.createDataFrame([("1", "Hero Aurora Dawn #7"), ("2", "Unknown 207/204"), ("3", "Aurora #9")], "item_id string, title string").withColumn("sold_date", F.to_date(F.lit("2024-01-01")))
    named = "concat('c', id) AS card_id, 'Hero' AS name, IF(id = 7, 'Aurora Dawn', concat('Other', id)) AS version, 'Set 1' AS set_name, IF(id = 8, '207', '7') AS collector_number, 'Rare' AS rarity, DATE '2023-01-01' AS released_at"
    cards = spark.sql(f"SELECT {named} FROM range(40)")
    # a card without words is none: its date doesn't make the only other card of number 9 too early
    late = spark.createDataFrame([("w", "???", None, "9", "2020-01-01"), ("late", "Aurora", None, "9", "2025-01-01")], "card_id string, name string, version string, collector_number string, day string")
    late = late.selectExpr("card_id", "name", "version", "'Set 2' AS set_name", "collector_number", "'Rare' AS rarity", "to_date(day) AS released_at")
    found = match_titles(sales.mapInArrow(counted, sales.schema), cards.unionByName(late))
    assert seen.value == 3  # nothing is left to read but the items that the cards are joined to
    assert {r.item_id: r.card_id for r in found.collect()}["1"] == "c7" and seen.value == 6
    alone = match_titles(sales.where("item_id = '3'"), late).collect()
    assert [r.card_id for r in alone] == ["late"]


def test_rate_limits_keep_a_row_once(spark):
    from tradewind.streaming import events as E
    from tradewind.streaming.runs import in_batches, run_once, run_until

    rows = spark.range(300).selectExpr("timestamp_seconds(883612800 + id * 137) AS ts", "id % 7 AS user_id", "id % 3 AS pool")
    batches = lambda name: in_batches(rows, F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, CAST(minute(ts) % 40 AS INT), 0)"), 3, name)
    limits = {"most": 2, "pool_most": 9, "pool_busy": 6, "light": 1}
    live = run_once(E.rate_limits(batches("live"), "user_id", "pool", delay="1 hour", **limits), "limits")
    slots, until = run_until(E.slot_counts(batches("slots"), "user_id", "pool", delay="1 hour"), "slots")
    got = E.refused(slots, until, "user_id", "pool", **limits)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.collect())) and got.count() > 50
    assert slots.agg(F.sum("n")).first()[0] <= 300  # each row lies in one slot, not in six windows
    nothing, until = run_until(E.slot_counts(in_batches(rows.limit(0), F.col("ts"), 2, "none"), "user_id", "pool"), "none")
    assert E.refused(nothing, until, "user_id", "pool").count() == 0
