"""Searches: what is read out of them, what they find, and what reaches the scan."""

import pytest
from pyspark.sql import functions as F

from tradewind.operators.screener import Catalogue, Condition, Search, compiled, parse, screened

CATALOGUE = Catalogue(
    phrases={"ruby": ("ink", "Ruby"), "amber": ("ink", "Amber"), "super rare": ("rarity", "Super Rare"), "rare": ("rarity", "Rare"), "princess": ("classes", "Princess"), "hero": ("classes", "Hero"), "reign of jafar": ("set", 8), "reign": ("set", 8), "evasive": ("keywords", "Evasive")},
    texts=("name", "text"), arrays=frozenset({"classes", "keywords"}), numbers={"lore": "lore", "cost": "cost"}, prefixes={"rarity": ("Common", "Uncommon", "Rare", "Legendary", "Enchanted", "Epic")}, price="price", names=frozenset({"ruby", "elsa", "hero"}),
)


def said(text):
    return [({(c.column, c.op, *c.values) for c in s.conditions}, s.name) for s in parse(text, CATALOGUE)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("elsa super rare", [({("rarity", "=", "Super Rare")}, ["elsa"])]), ("lore>=2 cost 3", [({("lore", ">=", 2.0), ("cost", "=", 3.0)}, [])]), ("3 lore cost2 elsa", [({("lore", "=", 3.0), ("cost", "=", 2.0)}, ["elsa"])]), ("lore < 4", [({("lore", "<", 4.0)}, [])]),
        ("ench elsa", [({("rarity", "=", "Enchanted")}, ["elsa"])]), ("en elsa", [({}.keys() | set(), ["en", "elsa"])]), ("epi com", [({("rarity", "=", "Epic"), ("rarity", "=", "Common")}, [])]), ("reign of jafar reign jafar", [({("set", "=", 8)}, ["jafar"])]),
        ("Rüby", [({("ink", "=", "Ruby")}, []), (set(), ["ruby"])]), ("amber under $5.50 over 2", [({("ink", "=", "Amber"), ("price", "<", 5.5), ("price", ">", 2.0)}, [])]), ("", [(set(), [])]),
    ],
)
def test_reading(text, want):
    assert said(text) == want


@pytest.fixture(scope="module")
def cards(spark):
    rows = [(1, "Elsa", "draws a card", "Ruby", "Rare", ["Princess", "Hero"], ["Evasive"], 2, 3, 1.0), (2, "Ruby Hero", None, "Amber", "Epic", ["Hero"], None, None, 1, 9.0), (3, "Anna", "names elsa", None, "Rare", None, [], 2, 2, None), (4, "Elsa Queen", "", "Ruby", "Super Rare", ["Queen", "Princess"], ["Evasive", "Ward"], 3, 5, 5.0)]
    return spark.createDataFrame(rows, "id int, name string, text string, ink string, rarity string, classes array<string>, keywords array<string>, lore int, cost int, price double")


@pytest.mark.parametrize(
    "text, match, chips, want",
    [
        ("elsa", "all", None, [(1, 0), (3, 0), (4, 0)]), ("elsa queen", "all", None, [(4, 0)]), ("elsa anna", "any", None, [(1, 0), (3, 0), (4, 0)]), ("princess hero", "all", None, [(1, 0)]), ("princess evasive", "any", None, [(1, 0), (4, 0)]), ("ruby", "all", None, [(1, 0), (2, 1), (4, 0)]),
        ("lore>=2", "all", None, [(1, 0), (3, 0), (4, 0)]), ("lore<3", "all", None, [(1, 0), (3, 0)]), ("rare", "all", {"ink": ("Ruby",)}, [(1, 0)]), ("rare super rare", "all", None, [(1, 0), (3, 0), (4, 0)]), ("", "all", {"classes": ("Queen", "Hero")}, [(1, 0), (2, 0), (4, 0)]), ("under $6", "all", None, [(1, 0), (4, 0)]), ("", "any", None, [(1, 0), (2, 0), (3, 0), (4, 0)]),
    ],
)
def test_finding(cards, text, match, chips, want):
    assert sorted((r.id, r.reading) for r in screened(cards, text, CATALOGUE, match, chips).collect()) == want


def test_filters_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    search = Search([Condition("p_type", ("LARGE",)), Condition("p_size", (5.0,), ">="), Condition("p_brand", ("Brand#1", "Brand#2"))], ["gear"])
    rows = part.where(compiled(search, ("p_name",))).select("p_partkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,LARGE)" in plan and "In(p_brand" in plan and "GreaterThanOrEqual(p_size" in plan and "p_retailprice" not in plan
    with pytest.raises(ValueError, match="any or all"):
        compiled(search, ("p_name",), "some")


def test_an_array_that_is_missing_fails(cards):
    assert [r.id for r in cards.where(compiled(Search([Condition("keywords", ("Ward",), array=True)]), ("name",))).collect()] == [4]
    assert cards.where(compiled(Search(), ("name",))).agg(F.count("*")).first()[0] == 4
