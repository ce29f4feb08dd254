"""Names resolved to cards: boundaries of each rule, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

CARDS = "cid bigint, name string, version string, extra string, played double, collected double"


@pytest.fixture(scope="module")
def cards(spark):
    rows = [
        (1, "Mowgli", "Man Cub", "jungle", 0.0, 1.0),
        (2, "Baloo", "Friend and Guardian", "jungle bear", 1.0, 0.0),
        (3, "Baloo", "Carefree Bear", None, 0.0, None),
        (4, "Elsa", None, "ice", 0.5, 0.5),
        (5, None, None, None, None, None),
        (6, "Rapunzel", "Letting Her Hair Down", "", 0.0, 0.0),
    ]
    return spark.createDataFrame(rows, CARDS).withColumn("qid", F.lit(1)).withColumn("text", F.lit("clash"))


def resolved(spark, cards, text, **options):
    from tradewind.operators.resolver import resolve_cards

    asked = spark.createDataFrame([(7, text)], "qid bigint, text string")
    rows = resolve_cards(asked, cards.drop("qid", "text"), stop=("and", "her"), **options).collect()
    return [r.cid for r in sorted(rows, key=lambda r: r.place)]


def test_edits_prefixes_and_prior(spark, cards):
    assert resolved(spark, cards, "mogwli") == [1]  # a swap
    assert resolved(spark, cards, "repunzle") == [6]  # an edit and a swap, from six letters
    assert resolved(spark, cards, "esla") == [4]  # a swap in four letters
    assert resolved(spark, cards, "asle") == []  # two edits in four letters
    assert resolved(spark, cards, "rapun") == [6] and resolved(spark, cards, "rap") == []
    assert resolved(spark, cards, "baloo") == [2, 3]  # the prior
    assert resolved(spark, cards, "baloo carefree", least=0.4) == [3, 2]  # the text outweighs it
    assert resolved(spark, cards, "") == [] == resolved(spark, cards, None)
    assert resolved(spark, cards, "baloo carefree") == [3]  # the other covers ln 4 of ln 4 + ln 7: 0.416
    assert resolved(spark, cards, "nothing here") == []


def test_least_coverage_is_whole(spark, cards):
    """Candidates of the heaviest words are all that reach the coverage: the same as of all words, filtered."""
    from tradewind.operators.resolver import resolve_cards

    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["baloo bear jungle", "friend guardian mowgli", "man cub ice", "hair bear elsa", "jungle jungle"])], "qid bigint, text string")
    every = resolve_cards(asked, cards.drop("qid", "text"), k=99, least=0.0)
    for least in (0.2, 0.4, 0.5, 0.7):
        want = {(r.qid, r.cid, r.rank) for r in every.where(F.col("coverage") >= least).collect()}
        assert {(r.qid, r.cid, r.rank) for r in resolve_cards(asked, cards.drop("qid", "text"), k=99, least=least).collect()} == want


def test_empty_tables(spark, cards):
    from tradewind.operators.resolver import resolve_cards

    asked = spark.createDataFrame([(1, "elsa")], "qid bigint, text string")
    assert resolve_cards(asked.limit(0), cards.drop("qid", "text")).count() == 0
    assert resolve_cards(asked, spark.createDataFrame([], CARDS)).count() == 0


def test_keys_of_words_are_not_broadcast(spark):
    from tradewind.operators.resolver import expansions

    words = lambda n: spark.range(n).selectExpr("lower(hex(id * 104729 % 268435456)) AS w").distinct()
    met = expansions(words(300).selectExpr("w AS q"), words(3000).selectExpr("w AS word"))
    assert met.where("q = word").count() == 300
    plan = met._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1].split("Initial Plan")[0]
    # whatever their sizes are taken for: prefixes, one deletion and two
    assert plan.count("SortMergeJoin") >= 3


def test_no_table_goes_to_the_driver(spark, cards):
    """Only the one row of the cards' number is broadcast, however small the tables look."""
    from tradewind.operators.resolver import expansions, resolve_cards

    asked = spark.createDataFrame([(7, "baloo carefree")], "qid bigint, text string")
    plans = [resolve_cards(asked, cards.drop("qid", "text")), expansions(spark.sql("SELECT 'baloo' AS q"), spark.sql("SELECT 'balloo' AS word"))]
    for rows in plans:
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
