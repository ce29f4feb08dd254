"""Snapshots as variants, and documents in pages."""

import json

from pyspark.sql import functions as F

from tradewind.operators import documents as D


def test_snapshots(spark):
    one = lambda *cards: json.dumps([dict(zip(("card_id", "printing", "quantity"), c)) for c in cards])
    given = [
        (1, 1, one(("a", None, 2), ("b", "Foil", 1))), (1, 2, "{broken"), (1, 3, one(("a", "Normal", 2), ("b", "Foil", 3), ("c", None, 1))), (1, 4, one(("a", None, 1), ("a", None, 1), ("c", None, 1))),
        (2, 1, None), (2, 2, '"text"'), (2, 3, "[]"), (2, 4, one(("z", None, None), ("y", None, 4))),
    ]
    rows = spark.createDataFrame(given, "deck_id int, version int, cards string")
    read = {(r.deck_id, r.version): r for r in D.read_snapshots(rows).select("deck_id", "version", "shape", "n_cards").collect()}
    assert [read[1, v].n_cards for v in (1, 2, 3, 4)] == [3, None, 6, 3] and [read[2, v].n_cards for v in (1, 2, 3, 4)] == [None, None, 0, 4]
    assert read[1, 1].shape.startswith("ARRAY<OBJECT<card_id: STRING") and read[2, 2].shape == "STRING"
    got = sorted(tuple(r) for r in D.snapshot_changes(rows).collect())
    assert got == [(1, 1, "a", "Normal", 0, 2), (1, 1, "b", "Foil", 0, 1), (1, 3, "b", "Foil", 1, 3), (1, 3, "c", "Normal", 0, 1), (1, 4, "b", "Foil", 3, 0), (2, 4, "y", "Normal", 0, 4)]
    cards = spark.createDataFrame([(1, "b", None, 1), (1, "a", "x", 2)], "k int, card_id string, printing string, quantity int")
    assert json.loads(D.snapshot(cards, ["k"]).first().cards) == [{"card_id": "a", "printing": "x", "quantity": 2}, {"card_id": "b", "printing": None, "quantity": 1}]


def test_pages(spark):
    rows = spark.range(250).withColumn("k", F.lit("s")).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id")))
    got = {r.page: json.loads(r.document) for r in D.pages(rows, "k", [F.desc("id")], ["id", "v"]).collect()}
    assert [len(got[p]["rows"]) for p in range(3)] == [100, 100, 50] and [r["id"] for p in range(3) for r in got[p]["rows"]] == list(range(249, -1, -1))
    assert got[0]["rows"][0] == {"id": 249, "v": None} and got[2]["k"] == "s"


def test_snapshots_are_read_once(spark):
    from tradewind.plans.documents import fn_json_deck_changes

    found = fn_json_deck_changes(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # one scan of the cards, which are shuffled by deck and stay there
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
