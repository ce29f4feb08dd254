"""Functions and operators on small made-up rows: boundaries, nulls and ties."""

import datetime as dt
import hashlib
import hmac
import itertools
import unicodedata

import pytest

D = dt.date


def rows(spark, schema, data):
    return spark.createDataFrame(data, schema)


def test_osa_and_deletions(spark):
    from tradewind.functions.text import deletions, osa

    assert [osa(a, b, 2) for a, b in (("rapunzel", "rapunzle"), ("ab", "ba"), ("abc", "abc"), ("abc", "xyz"), ("a", "abcd"), ("kitten", "sitten"), ("ca", "abc"))] == [1, 1, 0, 3, 3, 1, 3]
    got = rows(spark, "w string", [("abca",)]).select(deletions("w").alias("d")).first().d
    assert sorted(got) == sorted({"abca", "bca", "aca", "aba", "abc"})
    words = ["".join(w) for n in (2, 3) for w in itertools.product("ab", repeat=n)]
    cut = lambda w: {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
    assert all(cut(a) & cut(b) for a in words for b in words if osa(a, b, 1) <= 1)


def test_folds_and_keys(spark):
    from tradewind.functions.keys import network_bucket, person_key, player_key
    from tradewind.functions.text import card_key, dice, nfkd_fold, osa_distance, trigrams

    t = rows(spark, "s string, u bigint", [("Malmö & Té Fiti!", None), (None, 7), ("  ÀB  c ", 7)])
    got = t.select(card_key("s").alias("k"), nfkd_fold("s").alias("f"), person_key("u", "s", "key").alias("p"), player_key("s").alias("n")).collect()
    assert [r.k for r in got] == ["malmoandtefiti", "", "abc"]
    assert got[0].f == "".join(c for c in unicodedata.normalize("NFKD", "Malmö & Té Fiti!") if not unicodedata.combining(c)).lower() and got[1].f is None
    want = lambda s: hmac.new(b"key", s.encode(), hashlib.sha256).hexdigest()[:32]
    assert [r.p for r in got] == [want("n:malmö & té fiti!"), want("u:7"), want("u:7")] and got[2].n == "àb c"
    pair = rows(spark, "a string, b string", [("hello", "hallo"), ("hello", "hello"), (None, "x")])
    assert [r.d for r in pair.select(osa_distance("a", "b").alias("d")).collect()] == [1, 0, None]
    sims = pair.where("a IS NOT NULL").select(trigrams("a").alias("x"), trigrams("b").alias("y")).select(dice("x", "y").alias("d")).collect()
    assert [r.d for r in sims] == [pytest.approx(2 / 6), 1.0]
    nets = rows(spark, "a string", [("10.0.0.7",), ("2001:db8:0:12::1",), ("2001:0DB8:0000:0012:1:2:3:4",), ("fe80::1",)]).select(network_bucket("a").alias("n")).collect()
    assert [r.n for r in nets] == ["10.0.0.7", "2001:db8:0:12::/64", "2001:db8:0:12::/64", "fe80:0:0:0::/64"]


def test_local_times_of_unknown_zones(spark):
    from tradewind.functions.keys import with_local_time

    at = dt.datetime(2024, 7, 1, 22, 30)
    t = rows(spark, "i int, at timestamp, z string", [(0, at, "America/New_York"), (1, at, "No/Where"), (2, at, None), (3, at, "")])
    got = [r.local_ts for r in with_local_time(t, "at", "z").orderBy("i").collect()]
    assert got == [dt.datetime(2024, 7, 1, 18, 30), at, at, at]


def test_places_and_rarities(spark):
    from tradewind.functions.titles import place_rank, rarity_name

    labels = ["1st", "Top 8", "T16", "5th", "3", "second", "", None]
    assert [r.p for r in rows(spark, "place string", [(x,) for x in labels]).select(place_rank().alias("p")).collect()] == [1, 8, 16, 5, 3, None, None, None]
    assert [r.r for r in rows(spark, "rarity string", [("super_rare",), ("Epic",), ("odd",), (None,)]).select(rarity_name().alias("r")).collect()] == ["Super Rare", "Epic", "odd", None]


PRICES = "product_id bigint, printing string, price_date date, low bigint, market bigint"


def test_index_gaps_clamps_and_first_day(spark):
    """A gap of seven days counts and one of eight doesn't; a ninefold jump counts as two; the first kept day is 100."""
    from tradewind.operators.index import SCOPES, market_index

    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    data = []
    for p in range(6):
        data += [(p, "Normal", day(k), None, v) for k, v in ((0, 100), (1, 100), (2, 110 if p else 990), (9, 110 if p else 990), (17, 500))]
    dims = [(p, "card", "S", "Rare", None, None, D(1900, 1, 1)) for p in range(6)]
    dims = rows(spark, "product_id bigint, kind string, set_id string, rarity string, ink string, product_type string, floor_date date", dims)
    got = market_index(rows(spark, PRICES, data), dims, SCOPES[:1]).orderBy("price_date").collect()
    assert [(r.price_date, r.n) for r in got] == [(day(1), 6), (day(2), 6), (day(9), 6)]  # day 17 is eight days later
    assert got[0].value == 100 and got[1].value == pytest.approx(100 * (5 * 1.1 + 2) / 6, abs=1e-4) and got[2].value == got[1].value


def test_movers_need_a_fresh_close(spark):
    from tradewind.operators.movers import movers

    data = [(1, "Normal", D(2024, 1, 1), 100, 100), (1, "Normal", D(2024, 1, 20), 150, None), (2, "Normal", D(2024, 1, 1), 0, 50), (2, "Normal", D(2024, 2, 10), 80, 75), (2, "Normal", D(2024, 2, 9), 80, None)]
    floors = rows(spark, "product_id bigint, floor_date date", [(1, D(1900, 1, 1)), (2, D(1900, 1, 1))])
    a, b = movers(rows(spark, PRICES, data), floors).orderBy("product_id").collect()
    assert (a.pct_7d, a.pct_30d, a.low_prev, a.low_date) == (None, 50.0, 100, D(2024, 1, 20))  # closes outside the week, inside the month
    assert (b.pct_30d, b.mkt_pct_30d, b.pct_1d, b.low_last_changed) == (None, 50.0, 0.0, D(2024, 2, 9))  # a base of zero is no base


def test_standing_prefers_the_longest_window(spark):
    from tradewind.operators.movers import standing

    begin = D(2023, 1, 1)
    data = [(1, "Normal", begin + dt.timedelta(days=10 * k), None, 100 + k) for k in range(37)] + [(2, "Normal", begin + dt.timedelta(days=3 * k), None, 200 - k) for k in range(30)] + [(3, "Normal", begin + dt.timedelta(days=k), None, 5) for k in range(29)]
    got = {r.product_id: (r.days, r.tone, r.label) for r in standing(rows(spark, PRICES, data), "market").collect()}
    assert got == {1: (365, "high", "near its 12-month high"), 2: (90, "low", "cheapest in 3 months")}


def test_collection_seeds_and_acquired_dates(spark):
    from tradewind.operators.series import collection_value, sampled_dates

    data = [(1, "Normal", D(2024, 1, 1), 600, None), (2, "Normal", D(2024, 3, 2), 4, None), (2, "Normal", D(2024, 3, 4), 5, None), (3, "Normal", D(2024, 2, 1), 70, None)]
    held = [(1, "Normal", 1, None), (2, "Normal", 10, None), (3, "Normal", 2, D(2024, 3, 3)), (4, "Normal", 9, None)]
    got = collection_value(rows(spark, "product_id bigint, printing string, quantity int, acquired date", held), rows(spark, PRICES, data), "2024-03-01", "2024-03-05")
    assert [r.value for r in got.orderBy("price_date").collect()] == [600, 640, 780, 790, 790]
    dates = sampled_dates("2024-01-01", "2024-03-01")
    assert dates[0] == "2024-01-01" and dates[-14:] == [f"2024-02-{d}" for d in range(17, 30)] + ["2024-03-01"] and dates == sorted(set(dates))


def test_phantom_stretches(spark):
    """A spike of a fortnight that comes back is smoothed, days between included; one that stays, or lasts longer, is not."""
    from tradewind.operators.series import smooth_spikes

    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    data = [(1, "Normal", day(k), 1000 if 40 <= k <= 50 and k != 45 else 100, None) for k in range(100)]
    data += [(2, "Normal", day(k), 1000 if k >= 40 else 100, None) for k in range(100)]
    data += [(3, "Normal", day(k), 1000 if k in (40, 44) else 100, None) for k in range(100)]
    got = {}
    for r in smooth_spikes(rows(spark, PRICES, data)).collect():
        got.setdefault(r.product_id, {})[(r.price_date - day(0)).days] = r.smoothed
    assert {k for k, v in got[1].items() if v is not None} == set(range(40, 51)) and got[1][45] == 100.0
    assert all(v is None for v in got[2].values())
    assert {k for k, v in got[3].items() if v is not None} == {40, 44}  # a gap of four days parts them


def test_alerts_cooldown_and_fallback(spark):
    from tradewind.operators.alerts import WINDOWS, fired

    columns = "product_id bigint, printing string, low_today bigint, market_today bigint, " + ", ".join(f"{p}_{w} double" for p in ("pct", "mkt_pct") for w in WINDOWS)
    moved = rows(spark, columns, [(1, "Normal", 10, 20, *[30.0] * 6, *[12.0] * 6), (2, "Normal", 10, 200, *[-25.0] * 6, *[None] * 6)])
    rule = lambda i, **k: tuple(({"rule_id": i, "enabled": True, "watchlist_id": None, "product_id": 1, "printing": "Normal", "basis": "market", "kind": "above", "threshold": 20.0, "window_key": "7d", "cooldown_days": 7} | k).values())
    given = [rule(1), rule(2, enabled=False), rule(3, kind="below", threshold=19.0), rule(4, kind="pct_up", basis="low", threshold=30.0), rule(5, product_id=2, kind="pct_down", basis="low", threshold=-25.0)]
    given += [rule(6, product_id=2, printing="Cold Foil", threshold=100.0), rule(7, product_id=None, printing=None, watchlist_id=9), rule(8), rule(9), rule(10, cooldown_days=0), rule(11), rule(12, kind="sideways", threshold=0.0)]
    rules = rows(spark, "rule_id bigint, enabled boolean, watchlist_id bigint, product_id bigint, printing string, basis string, kind string, threshold double, window_key string, cooldown_days int", given)
    items = rows(spark, "watchlist_id bigint, product_id bigint, printing string", [(9, 1, "Normal"), (9, 2, "Holofoil"), (9, 3, "Normal")])
    history = rows(spark, "rule_id bigint, product_id bigint, printing string, fired_on date", [(8, 1, "Normal", D(2024, 1, 4)), (9, 1, "Normal", D(2024, 1, 3)), (10, 1, "Normal", D(2024, 1, 9)), (11, 1, "Normal", D(2024, 1, 10))])
    got = sorted((r.rule_id, r.product_id, r.printing, r.observed) for r in fired(rules, items, moved, history, "2024-01-10").collect())
    assert got == [(1, 1, "Normal", 20.0), (4, 1, "Normal", 30.0), (5, 2, "Normal", -25.0), (6, 2, "Normal", 200.0), (7, 1, "Normal", 20.0), (7, 2, "Normal", 200.0), (9, 1, "Normal", 20.0), (10, 1, "Normal", 20.0)]


def test_roots_of_chains_and_cycles(spark):
    from tradewind.operators.ratings import roots

    chain = [(i, i + 1 if i < 30 else None) for i in range(31)] + [(40, 41), (41, 42), (42, 40)]
    got = {r.player_id: r.root_id for r in roots(rows(spark, "player_id bigint, merged_into_id bigint", chain)).collect()}
    assert got == {i: 30 for i in range(31)} | {40: 40, 41: 40, 42: 40}


def test_global_rank_equals_rank(spark):
    from tradewind.operators.ratings import global_rank

    values = [1500.0, 1500.0, 1499.9, 1500.4, 900.0, 1500.4, 2000.0]
    got = sorted((r.v, r.rank) for r in global_rank(rows(spark, "v double", [(v,) for v in values]), "v").collect())
    assert got == sorted((v, 1 + sum(x > v for x in values)) for v in values)


def test_merges(spark):
    from tradewind.sinks.merge import inserted, last_of_batch, upserted

    stored, batch = rows(spark, "k int, n int, v string", [(1, 1, "a"), (2, 1, "b")]), rows(spark, "k int, n int, v string", [(2, 5, "x"), (2, 7, "y"), (3, 1, None)])
    assert sorted(upserted(stored, batch, ["k"], ["n"]).collect(), key=str) == [(1, 1, "a"), (2, 7, "y"), (3, 1, None)]
    assert last_of_batch(batch, ["k"], ["n"]).count() == 2 and [tuple(r) for r in inserted(stored, batch, ["k"], ["n"]).collect()] == [(3, 1, None)]


def test_pruning_guards(spark):
    from tradewind.sinks.merge import fates, trusted

    assert trusted(4000, 5000) and not trusted(3999, 10) and not trusted(4000, 5715) and not trusted(9999, None) and trusted(4000, 0)
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    seen = rows(spark, "k int, at timestamp, starts timestamp", [(1, at(1, 23), at(20, 0)), (2, at(2, 0), at(20, 0)), (3, at(1, 0), at(3, 11)), (4, None, at(20, 0)), (5, at(1, 0), dt.datetime(2023, 12, 4, 11)), (6, at(3, 0), dt.datetime(2023, 12, 4, 12)), (7, at(1, 0), None)])
    fate = lambda whole: {r.k: r.fate for r in fates(seen, "at", "starts", "2024-01-03 12:00:00", whole).collect()}
    assert fate(True) == {1: "delisted", 2: "kept", 3: "kept", 4: "kept", 5: "archived", 6: "kept", 7: "kept"}
    assert set(fate(False).values()) == {"kept"}


def test_reread_plans(spark):
    from tradewind.sinks.merge import reread_plan

    had = [(1, 1), (1, 2), (2, 1), (5, 1), *((3, m) for m in range(6)), *((4, m) for m in range(9))]
    has = [(1, 2), (1, 3), *((3, m) for m in range(3)), *((4, m) for m in range(4)), (6, 1)]
    read = rows(spark, "e int", [(e,) for e in (1, 2, 3, 4, 6, 7)])
    got = {r.e: (r.state, r.adds, r.deletes) for r in reread_plan(rows(spark, "e int, m int", had), rows(spark, "e int, m int", has), read, "e", "m").collect()}
    # three rows may always go; five of nine are more than half; event 5 wasn't read
    assert got == {1: ("apply", [3], [1]), 2: ("untrusted", [], []), 3: ("apply", [], [3, 4, 5]), 4: ("held back", [], []), 6: ("apply", [1], []), 7: ("apply", [], [])}


def test_sales_lines_keep_the_line_seen_first(spark, tmp_path):
    from tradewind.sources.feeds import sales_lines

    (tmp_path / "b.json").write_text('{"item_id": "1", "title": "later file", "price": 1.0}\n')
    (tmp_path / "a.json").write_text("".join(f'{{"item_id": "{i}", "title": "{t}", "price": {p}, "sold": "2024-01-01"}}\n' for i, t, p in [("1", "zebra first", 2.0), ("1", "apple second", 9.0), ("", "x", 2.5), ("", "x", 2.5), ("", "x", 2.51)]))
    got = sorted((r.key, r.title, r.price) for r in sales_lines(spark, str(tmp_path)).collect())
    assert got == [("1", "zebra first", 2.0), ("x|2.50|2024-01-01", "x", 2.5), ("x|2.51|2024-01-01", "x", 2.51)]


def test_archive_leaves_loaded_days_unread(spark, tmp_path):
    from tradewind.sources.feeds import archive_prices

    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "a.json").write_text('{"productId": 1, "marketPrice": 2.0}\n{"productId": 2, "marketPrice": 0}\n')
    loaded = rows(spark, "price_date date", [(dt.date(2024, 1, 1),), (None,)])
    left = archive_prices(spark, str(tmp_path), loaded)
    assert [(r.product_id, str(r.price_date)) for r in left.collect()] == [(1, "2024-01-02")] and archive_prices(spark, str(tmp_path)).count() == 2


def test_versioned_table(spark, tmp_path):
    """A batch that runs twice or dies half way changes nothing; readers see whole versions."""
    from pyspark.sql import functions as F

    from tradewind.sinks.versions import VersionedTable, refreshed

    table = VersionedTable(spark, f"file://{tmp_path}/t", "k int, n int, v string", ["k"], buckets=4)
    assert table.rows().count() == 0 and table.version() == 0
    batch = rows(spark, "k int, n int, v string", [(1, 1, "a"), (1, 3, "c"), (2, 1, "b"), (None, 1, "n")])
    assert table.merge(batch, ["n"], 0) and not table.merge(batch, ["n"], 0)
    old = table.rows()
    assert sorted(map(tuple, old.collect()), key=str) == [(1, 3, "c"), (2, 1, "b"), (None, 1, "n")]
    dying = rows(spark, "k int, n int, v string", [(1, 9, "x"), (7, 1, "y")]).withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.merge(dying, ["n"], 1)
    # whoever opens the path reads the last whole version
    again = VersionedTable(spark, f"file://{tmp_path}/t", "k int, n int, v string", ["k"], buckets=4)
    assert sorted(map(tuple, again.rows().collect()), key=str) == [(1, 3, "c"), (2, 1, "b"), (None, 1, "n")] and not again.holds(1)
    assert again.merge(rows(spark, "k int, n int, v string", [(1, 9, "x")]), ["n"], 1) and again.rows(before=1).where("v = 'c'").count() == 1
    assert sorted(map(tuple, old.collect()), key=str)[0] == (1, 3, "c")  # a reader's version stays as it was
    with pytest.raises(Exception, match="lost"):
        refreshed(again, [lambda: dying])
    assert refreshed(again, [lambda: dying, lambda: batch.where("k = 2")]) == 1 and [tuple(r) for r in again.rows().collect()] == [(2, 1, "b")]
    again.replace(batch.limit(0))
    assert again.rows().count() == 0


def test_chains_of_merges_of_any_length(spark):
    from tradewind.operators.ratings import roots

    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 131)] + [(200 + i, 200 + (i + 1) % 3) for i in range(3)] + [(300, 200)]
    got = {r.player_id: r.root_id for r in roots(rows(spark, "player_id bigint, merged_into_id bigint", chain)).collect()}
    assert all(got[i] == 1 for i in range(1, 131)) and all(got[i] == 200 for i in (200, 201, 202, 300))
    assert roots(rows(spark, "player_id bigint, merged_into_id bigint", [])).count() == 0


def test_imported_decks(spark, tmp_path):
    from tradewind.sinks.decks import COLUMNS, KEYS, import_decks
    from tradewind.sinks.versions import VersionedTable

    table = VersionedTable(spark, f"file://{tmp_path}/decks", COLUMNS, KEYS, buckets=3)
    resolved = rows(spark, "deck_id int, entries string", [(1, "4 crd_a\n2 crd_b"), (2, "1 crd_a"), (3, "")])
    problems = rows(spark, "deck_id int, problems string", [(1, ""), (2, "unmatched lines"), (3, "")])
    assert import_decks(table, resolved, problems, 0) and not import_decks(table, resolved, problems, 0)
    assert sorted(map(tuple, table.rows().collect())) == [(1, "crd_a", 4), (1, "crd_b", 2)]
    assert import_decks(table, rows(spark, "deck_id int, entries string", [(1, "3 crd_c")]), problems, 1)
    assert [tuple(r) for r in table.rows().collect()] == [(1, "crd_c", 3)]  # the newer list, whole


def test_snapshot_gate(spark):
    from tradewind.operators.series import group_averages, snapshot_gate

    day = lambda d: dt.date(2024, 1, d)
    prices = [(p, "N", day(1), 5, 7 if p else None) for p in range(20)] + [(p, "N", day(4), 5, 7 if p else None) for p in range(21)] + [(p, "N", day(5), 5 if p else 6, 7 if p else None) for p in range(20)] + [(99, "N", day(6), 1, 1)]
    got = {r.price_date.day: (r.compared, r.matched, r.stale) for r in snapshot_gate(rows(spark, "product_id int, printing string, price_date date, low bigint, market bigint", prices)).collect()}
    # over a gap the last available day counts; 19 of 20 are no more than 95 %
    assert got == {1: (0, 0, False), 4: (20, 20, True), 5: (20, 19, False), 6: (0, 0, False)}
    some = rows(spark, "product_id int, printing string, price_date date, low bigint, market bigint", [(1, "N", day(1), 99, 100), (2, "N", day(1), 100, None), (3, "N", day(1), 4, None)])
    cards = rows(spark, "product_id int, set_id string, rarity string", [(1, "a", "r"), (2, "a", "r"), (3, None, "r")])
    assert [tuple(r)[4:] for r in group_averages(some, cards).collect()] == [(100, 100, 50, 100, 2)]


def test_store_windows(spark):
    from pyspark.sql import functions as F

    from tradewind.operators import stores as S

    sets = rows(spark, "name string, code string, released_at date", [("Five", "5", dt.date(2024, 5, 1)), ("Four", " 4 ", dt.date(2024, 4, 1)), ("Three", "3", dt.date(2024, 3, 1)), ("Promo", "P1", dt.date(2024, 4, 15)), ("Six", "6", dt.date(2024, 6, 1))])
    found = S.main_sets(sets, "2024-05-20")
    assert [n for n, _ in found] == ["Five", "Four", "Three"] and S.season_window(found, 2) == (dt.date(2024, 3, 1), dt.date(2024, 5, 1), ["Four", "Three"])
    assert S.season_window(found, 4) == (dt.date(2024, 3, 1), None, ["Five", "Four", "Three"]) and S.season_window(found, 1, skip_current=False)[1] is None
    day = lambda m, d: dt.date(2024, m, d)
    events = rows(spark, "event_id int, store_id int, day date, cancelled boolean", [(1, 1, day(3, 1), False), (2, 1, day(4, 1), True), (3, 1, day(4, 30), True), (4, 1, day(5, 1), False), (5, None, day(4, 1), False), (6, 9, day(4, 1), False)])
    came = [(1, 7, "x", None, 1, 0, 0, None), (1, None, " Ann ", 3, 0, 0, 0, None), (1, 8, "noshow", None, 0, 0, 0, "COMPLETE"), (3, 7, "x", 1, 0, 0, 0, None), (3, None, "ann", 2, 0, 0, 0, None), (4, 9, "y", None, 0, 0, 0, ""), (4, 10, "z", None, 0, 0, 0, "CANCELED"), (2, 11, "w", None, 0, 0, 0, None)]
    attendance, scans = rows(spark, "event_id int, user_id int, identifier string, place int, won int, lost int, drawn int, status string", came), rows(spark, "event_id int", [(1,), (4,)])
    held = S.held_events(events, attendance, rows(spark, "store_id int", [(1,)]))
    assert sorted(r.event_id for r in held.collect()) == [1, 3, 4]  # a cancelled event without results is none
    sold = S.tickets(held, attendance, scans)
    assert sorted((r.event_id, r.person, r.recorded) for r in sold.collect()) == [(1, "n:ann", True), (1, "u:7", True), (3, "n:ann", True), (3, "u:7", True), (4, "u:9", False)]
    tiers = lambda since, until: [tuple(r) for r in S.store_tiers(held, sold, scans, since, until, (("Both", 2, 2, 4), ("One", 1, 1, 1))).collect()]
    assert tiers(day(3, 1), day(5, 1)) == [(1, 2, 1, 4, 0, 2, "Both")] and tiers(day(4, 30), None) == [(1, 2, 1, 3, 1, 3, "One")] and tiers(day(5, 2), None) == []
    # numbers are dense whatever the parts, so bitmaps are few
    people = spark.range(70_000).selectExpr("concat('p', id) AS person")
    n = S.numbered(people, parts=7)
    assert n.agg(F.min("number"), F.max("number"), F.countDistinct("number")).first() == (1, 70_000, 70_000)
    rows_ = people.withColumns({"store_id": F.lit(1), "day": F.lit(day(3, 2))}).unionByName(people.limit(10).withColumns({"store_id": F.lit(1), "day": F.lit(day(4, 2))}))
    windows = rows(spark, "window_id string, season string", [("a", "Three"), ("b", "Three"), ("b", "Four")])
    got = S.window_people(S.season_bitmaps(rows_, n, S.season_of("day", found)), windows)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 70_000, 70_000), ("b", 1, 70_000, 70_010)]


def test_sku_buckets_prefer_english(spark):
    from tradewind.sources.feeds import BUCKETS, sku_buckets

    week = lambda n: [("2024-01-01", 1.0, 1, n)]
    data = [(1, [("N", "NM", "German", week(9)), ("N", "NM", "English", week(2)), ("F", "NM", "German", week(3)), ("F", "NM", "French", week(4))]), (2, None)]
    got = sorted((r.product, r.printing, r.language, r.transactions) for r in sku_buckets(rows(spark, BUCKETS, data)).collect())
    assert got == [(1, "F", "French", 4), (1, "N", "English", 2)]


def test_merged_rings_and_parsed_searches(spark):
    from tradewind.operators.catalog import merged_rings
    from tradewind.operators.search import parse_search

    near, far = (rows(spark, "series_key string, n int", d) for d in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)]))
    assert sorted(tuple(r) for r in merged_rings([near, far]).collect()) == [("a", 1), ("b", 2), ("c", 2)]
    known = {"ruby": ("ink", "Ruby"), "super rare": ("rarity", "Super Rare"), "rare": ("rarity", "Rare")}
    assert parse_search("Ruby super rare elsa cost>=3", known) == ([("cost>=", 3.0), ("rarity", "Super Rare"), ("ink", "Ruby")], "elsa")


def test_refetch(spark):
    from tradewind.streaming.events import needs_refetch

    at = lambda h: dt.datetime(2024, 1, 1, h)
    stored = rows(spark, "k int, inserted_at timestamp", [(1, at(5)), (2, at(9)), (2, at(3))])
    publish = rows(spark, "k int, published_at timestamp", [(1, at(6)), (2, at(6)), (3, at(6))])
    assert sorted(r.k for r in needs_refetch(stored, publish, ["k"]).collect()) == [1, 3] and needs_refetch(stored, publish, ["k"], explicit=True).count() == 0


def test_draw_tiers_of_four_rules(spark):
    from tradewind.operators.draws import RULES, draw_tiers

    one = lambda r, t, a, b, w, g: (1, r, t, a, b, w, g[0], g[1], False)
    data = [one(1, 1, 1, 2, 1, (2, 0)), one(1, 2, 3, 4, 3, (2, 0)), one(1, 3, 5, 6, 5, (2, 0)), one(1, 4, 7, 8, 7, (2, 0))]
    data += [one(2, 1, 1, 3, 1, (2, 0)), one(2, 2, 5, 7, 5, (2, 0)), one(2, 3, 2, 4, 2, (2, 0)), one(2, 4, 6, 8, 6, (2, 0))]
    data += [one(3, 1, 1, 5, None, (None, 0)), one(3, 2, 2, 3, None, (1, 1)), one(3, None, 4, 8, None, (1, 1)), one(3, 4, 6, 7, 6, (2, 1))]
    data += [one(4, 1, 1, 6, 1, (2, 0)), one(4, 2, 5, 2, 5, (2, 0)), one(5, 1, 1, 5, 1, (2, 0)), (1, 5, 2, 9, None, None, None, None, True)]
    matches = rows(spark, "event_id int, round_number int, table_number int, player1_id int, player2_id int, winner_id int, games_won_p1 int, games_won_p2 int, is_bye boolean", data)
    # the third round has four matches, but so has the second: the cut is the last two rounds, of four players, and its line is three points
    want = {"position": ["ID-likely", "real", "real"], "position-only": ["ID-strong", "ID-strong", "unclear"], "score-only": ["ID-likely", "real", "real"], "score-or-position": ["ID-strong", "ID-strong", "unclear"]}
    for rule in RULES:
        assert [r.tier for r in draw_tiers(matches, rule).orderBy("player1_id").collect()] == want[rule], rule
    ruled = rows(spark, "event_id int, round_number int, table_number int, intentional boolean", [(1, 3, None, True), (1, 3, 1, False), (1, 3, 1, True), (1, 3, 2, False), (1, 9, 9, True)])
    got = draw_tiers(matches, ruled=ruled).orderBy("player1_id").collect()
    assert [(r.tier, r.intentional) for r in got] == [("ID-manual", True), ("real-manual", False), ("ID-manual", True)]
    assert draw_tiers(matches.limit(0)).count() == 0
    with pytest.raises(ValueError, match="rule is one of"):
        draw_tiers(matches, "score")


def test_ranked_places(spark):
    from tradewind.operators.catalog import ranked_places

    data = [(1, "Dublin", "OH", "US", 40.1, -83.1), (2, "Dublin", None, "IE", 53.35, -6.26), (3, "Dublin 8", None, "IE", 53.34, -6.29), (4, "Dublin", None, "IE", 0.0, 0.0), (5, " ", None, "IE", 1.0, 1.0)]
    data += [(6, "Dublin", "XX", "US", float("nan"), 1.0), (7, "Dublin", "YY", "US", None, 1.0), (8, "Cork", None, "IE", 51.9, -8.47), (9, "Córk", "C", "IE", 10.0, 10.0)]
    places = rows(spark, "place_id int, city string, state string, country string, latitude double, longitude double", data)
    got = [(r.place, r.city, r.country, r.latitude) for r in ranked_places(places, " dublin", "ie").collect()]
    # Dublin 8 lies within 15 miles of Dublin, whose row with the smallest id counts
    assert got == [(1, "Dublin", "IE", 53.35), (2, "Dublin", "US", 40.1), (3, "Cork", "IE", 51.9), (4, "Córk", "IE", 10.0)]
    assert [r.city for r in ranked_places(places, "cork", most=1).collect()] == ["Cork"]
    assert ranked_places(places.limit(0), "x").count() == 0
