"""Listing titles: what is read out of them, and the card that they are matched to."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewind.functions import listings as L
from tradewind.operators.listings import catalogue_cards, match_titles, read_titles, title_candidates

CARDS = [
    ("elsa", "Elsa", "Snow Queen", "The First Chapter", "41", "Common", "2023-08-18"),
    ("elsa-e", "Elsa", "Snow Queen", "The First Chapter", "207", "Enchanted", "2023-08-18"),
    ("tailor", "Mickey Mouse", "Brave Little Tailor", "The First Chapter", "115", "Legendary", "2023-08-18"),
    ("tailor-p", "Mickey Mouse", "Brave Little Tailor", "Promo Set 1", "1", "Promo", None),
    ("mickey", "Mickey Mouse", "Detective", "The First Chapter", "154", "Common", "2023-08-18"),
    ("let", "Let It Go", None, "The First Chapter", "163", "Rare", "2023-08-18"),
    ("let-again", "Let It Go", None, "Winterspell", "163", "Rare", "2026-02-13"),
    ("robin-24a", "Robin Hood", "Champion of Sherwood", "Promo Set 2", "24A", "Promo", None),
    ("robin-24b", "Robin Hood", "Champion of Sherwood", "Promo Set 2", "24B", "Enchanted", None),
    ("robin-d23", "Robin Hood", "Unrivaled Archer", "Promo Set 1", "6", "Promo", None),
    ("robin-17", "Robin Hood", "Capable Fighter", "Promo Set 1", "17", "Promo", None),
    ("stitch-ja", "Stitch", "Rock Star", "Promo Set 1", "25ja", "Promo", None),
    ("stitch-zh", "Stitch", "Rock Star", "Promo Set 1", "25zh", "Promo", None),
    ("vine", "Attack of the Vine!", None, "Attack of the Vine!", "77", "Rare", "2026-07-17"),
    ("vine-chase", "Sleepy", "Garden Keeper", "Attack of the Vine!", "202", "Epic", "2026-07-17"),
    ("sail", "Sail the Azurite Sea", None, "Azurite Sea", "99", "Common", "2024-11-15"),
    ("minnie", "Minnie Mouse", "Pirate Lookout", "Azurite Sea", "186", "Uncommon", "2024-11-15"),
    ("prize", "Tinker Bell", "Giant Fairy", "Challenge Promo", "42", "Promo", None),
    ("tink", "Tinker Bell", "Giant Fairy", "The First Chapter", "193", "Super Rare", "2023-08-18"),
]
#: title, day of sale, the card, and whether the number conflicts.
TITLES = [
    ("Lorcana Elsa Snow Queen 41/204 PSA 10", "2024-05-01", "elsa", False),
    ("Elsa Snow Queen Enchanted PSA 10", "2024-05-01", "elsa-e", False),  # the rarity named
    ("Elsa Snow Queen 207/204 CGC 9.5", "2024-05-01", "elsa-e", False),  # a number outranks the missing rarity
    ("Elsa 207 PSA 9", "2024-05-01", "elsa-e", False),  # a bare number of three digits
    ("Mickey Mouse Brave Little Tailor First Chapter PSA 10", "2024-05-01", "tailor", False),
    ("Mickey Mouse Brave Little Tailor 1/P1 PSA 10", "2024-05-01", "tailor-p", False),
    ("Mickey Mouse PSA 10", "2024-05-01", None, False),  # half of nothing
    ("Let It Go PSA 10", "2024-05-01", "let", False),  # the reprint isn't out
    ("Let It Go 163/204 PSA 10", "2026-05-01", "let", False),  # the earlier printing of equals
    ("Let It Go Winterspell PSA 10", "2026-01-30", "let-again", False),  # 14 days before release
    ("Let It Go Winterspell PSA 10", "2026-01-29", "let", False),  # 15
    ("Robin Hood Champion of Sherwood #24B PSA 10", "2024-05-01", "robin-24b", False),
    ("Robin Hood Champion of Sherwood #24A PSA 10", "2024-05-01", "robin-24a", False),
    ("Robin Hood D23 Expo 1st Edition PSA 10", "2024-05-01", "robin-d23", False),
    ("Stitch Rock Star #25 P1 Japanese PSA 10", "2024-05-01", "stitch-ja", False),
    ("Stitch Rock Star #25 P1 Chinese PSA 10", None, "stitch-zh", False),
    ("Sleepy Attack of the Vine #202 PSA 10", "2026-09-01", "vine-chase", False),  # the owner of the number before the card named like its set
    ("Minnie Mouse Azurite Sea PSA 10", "2025-01-01", "minnie", False),  # words of the set don't name "Sail the Azurite Sea"
    ("Tinker Bell Giant Fairy Top Prize 3/C1 PSA 10", "2025-01-01", "prize", False),  # the set agrees, so the number is forgiven
    ("Tinker Bell Giant Fairy #18 PSA 10", "2025-01-01", None, True),
    ("Elsa Snow Queen complete set of 4", "2024-05-01", None, False),
    ("Elsa Snow Queen x3 PSA 10", "2024-05-01", None, False),
    ("Unrelated words", "2024-05-01", None, False),
    ("", None, None, False),
    (None, "2024-05-01", None, False),
]


@pytest.fixture(scope="module")
def tables(spark):
    day = lambda s: None if s is None else dt.date.fromisoformat(s)
    cards = spark.createDataFrame([(*c[:6], day(c[6])) for c in CARDS], "card_id string, name string, version string, set_name string, collector_number string, rarity string, released_at date")
    sales = spark.createDataFrame([(str(k), t, day(d)) for k, (t, d, *_) in enumerate(TITLES)], "item_id string, title string, sold_date date")
    return sales, cards


def test_matches(tables):
    got = {int(r.item_id): r for r in match_titles(*tables).collect()}
    assert len(got) == len(TITLES)
    for k, (title, day, card, conflict) in enumerate(TITLES):
        assert (got[k].card_id, got[k].cn_conflict) == (card, conflict), (title, day, got[k])
        assert (got[k].confidence is None) == (card is None)


def test_repeated_sales_and_empty_tables(tables):
    sales, cards = tables
    twice = match_titles(sales.unionByName(sales), cards).groupBy("item_id").count()
    assert {r["count"] for r in twice.collect()} == {2}
    assert match_titles(sales.limit(0), cards).count() == 0
    assert {r.card_id for r in match_titles(sales, cards.limit(0)).collect()} == {None}


def test_no_candidate_is_lost(tables):
    """The keys' join gives every card that has the title's number or half of whose name it covers, and none by a lone frequent word."""
    own, read = catalogue_cards(tables[1]), read_titles(tables[0])
    got = {(r.title, r.sold_date, r.card_id) for r in title_candidates(read, own).collect()}
    cards = own.collect()
    want = {(t.title, t.sold_date, c.card_id) for t in read.collect() for c in cards if c.number in t.numbers or 2 * len(set(t.words) & set(c.words)) >= len(c.words)}
    assert want <= got
    # "mouse" alone is a frequent word
    assert not any(t == "Minnie Mouse Azurite Sea PSA 10" and c in ("tailor", "tailor-p") for t, _, c in got)


def test_reading(spark):
    rows = spark.createDataFrame([("x 012/204 #24b 10/10 7/C1 (1234/204) #5x7",), ("Elsa 207 215. 2023 PSA 10 1st pop 300 99 1000",), ("D23 Promos 04D23",), ("D23 Collector 2022",), ("en-07 card",), ("EN 99",), (None,)], "t string")
    t = F.col("t")
    got = rows.select(L.printed_numbers(t).alias("printed"), L.lettered_numbers(t).alias("lettered"), L.likely_numbers(t).alias("likely"), L.set_hint(t).alias("hint"), L.of_earlier_fair(t).alias("fair")).collect()
    assert set(got[0].printed) == {"12", "24B", "24", "7"} and got[0].lettered == ["24B"]
    assert got[1].likely == ["207"] and not got[1].printed
    assert [g.hint for g in got[2:6]] == ["D23 Collection", "Promo Set 1", "Archazia's Island", None]
    assert [g.fair for g in got[2:4]] == [False, True]


def test_best_of_keys_is_best_of_all_cards(spark, monkeypatch):
    """The index gives what comparing every candidate gives, and holds one card of a key however many are alike."""
    import random

    from tradewind.operators import listings as O

    rng = random.Random(4)
    names = ["Elsa Ice", "Robin Hood", "Azurite Sea", "Winterspell", "Attack Vine", "Hero"]
    rest = ["Hot Bolt", "Hot Ring", "Red Bolt", "Sea Captain Bolt", "", "Keep One Red Ring Tall Dark Bolt"]  # the last has more than LONGEST words
    sets = ["Azurite Sea", "Winterspell", "Attack of the Vine!", "Promo Set 1", "D23 Collection", "Set 9"]
    numbers = ["7", "12", "207", "24A", "24B", "25ja", "25zh", "6"]
    day = lambda: dt.date(2023 + rng.randrange(3), 1 + rng.randrange(12), 1)
    cards = [(f"c{k}", rng.choice(names), rng.choice(rest), rng.choice(sets), rng.choice(numbers), rng.choice(["Common", "Enchanted", "Epic", "Promo"]), rng.choice([None, day(), day()])) for k in range(400)]
    tails = ["#7", "207/204", "#24B", "25/P1 Japanese", "25/P1 Chinese", "Enchanted #12", "Epic", "Azurite PSA 10", "Winterspell 207", "D23 Expo 1st Edition 6/204", "D23 Collection", "attack of the vine 12/204", ""]
    titles = [(str(k), f"{rng.choice(names)} {rng.choice(rest)} {rng.choice(tails)} {rng.choice(['', 'Bolt', 'Hot', rng.choice(tails)])}", rng.choice([None, day(), day()])) for k in range(500)]
    sales = spark.createDataFrame(titles, "item_id string, title string, sold_date date")
    catalogue = spark.createDataFrame(cards, "card_id string, name string, version string, set_name string, collector_number string, rarity string, released_at date")
    got = sorted(tuple(r) for r in match_titles(sales, catalogue).collect())
    monkeypatch.setattr(O, "MOST_KNOWN", 3)  # some titles one by one
    assert sorted(tuple(r) for r in match_titles(sales, catalogue).collect()) == got
    monkeypatch.setattr(O, "LONGEST", 0)  # all cards one by one
    assert sorted(tuple(r) for r in match_titles(sales, catalogue).collect()) == got and sum(r[1] is not None for r in got) > 100
    monkeypatch.setattr(O, "LONGEST", 6)
    alike = spark.range(3000).selectExpr("concat('c', id) AS card_id", "'Hot Bolt' AS name", "concat('keep', id) AS version", "'Set 9' AS set_name", "'7' AS collector_number", "'Common' AS rarity", "DATE '2023-01-01' AS released_at")
    held = O.card_index(catalogue_cards(alike), read_titles(sales).select("hint", "hint_words").limit(0)).selectExpr("max(size(held)) AS n", "count(*) AS keys").first()
    assert held.n == 1 and held.keys > 3000
