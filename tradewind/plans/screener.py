"""Searches of the parts as cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.screener import Catalogue, screened
from tradewind.plans.registered import query
from tradewind.sources.views import view

TYPES = ("ECONOMY", "STANDARD", "MEDIUM", "LARGE", "SMALL", "PROMO")
CATALOGUE = Catalogue(
    phrases={t.lower(): ("p_type", t) for t in TYPES} | {f"brand {n}": ("p_brand", f"Brand#{n}") for n in range(1, 26)} | {"brand 1 and 2": ("p_brand", "Brand#12")} | {w: ("classes", w) for w in ("gear", "widget", "hot")},
    texts=("p_name", "p_brand"),
    arrays=frozenset({"classes"}),
    numbers={"size": "p_size", "sz": "p_size"},
    prefixes={"p_type": TYPES},
    price="p_retailprice",
    names=frozenset({"small", "large", "red", "blue", "gear"}),
)
#: A search, its mode, and the values chosen beside it.
SEARCHES = (
    ("eco size>=40 bolt", "all", None), ("small gear", "all", None), ("gear hot", "any", None), ("hot gear brand 12", "all", None), ("sz 7", "all", None), ("7 size ring rod", "any", None), ("brand 1 and 2 size < 5", "all", None),
    ("under $905 stand", "all", None), ("red brand#3", "all", {"p_type": ("LARGE", "SMALL")}), ("", "all", {"classes": ("widget",), "p_type": ("MEDIUM",)}), ("över 990.5 brand 3 brand 4", "all", None), ("su blue", "all", None),
)
_HAY = "lower(p_name || ' ' || p_brand)"
_FILTERS = (
    f"CASE WHEN p_type = 'ECONOMY' AND p_size >= 40 AND contains({_HAY}, 'bolt') THEN 0 END",
    f"CASE WHEN p_type = 'SMALL' AND list_contains(classes, 'gear') THEN 0 WHEN contains({_HAY}, 'small') AND contains({_HAY}, 'gear') THEN 1 END",
    f"CASE WHEN list_contains(classes, 'gear') OR list_contains(classes, 'hot') THEN 0 WHEN list_contains(classes, 'hot') AND contains({_HAY}, 'gear') THEN 1 END",
    f"CASE WHEN list_contains(classes, 'gear') AND list_contains(classes, 'hot') AND p_brand = 'Brand#12' THEN 0 WHEN list_contains(classes, 'hot') AND contains({_HAY}, 'gear') AND p_brand = 'Brand#12' THEN 1 END",
    "CASE WHEN p_size = 7 THEN 0 END",
    f"CASE WHEN p_size = 7 AND (contains({_HAY}, 'ring') OR contains({_HAY}, 'rod')) THEN 0 END",
    "CASE WHEN p_brand = 'Brand#12' AND p_size < 5 THEN 0 END",
    "CASE WHEN p_retailprice < 905 AND p_type = 'STANDARD' THEN 0 END",
    f"CASE WHEN p_type IN ('LARGE', 'SMALL') AND p_brand = 'Brand#3' AND contains({_HAY}, 'red') THEN 0 END",
    "CASE WHEN p_type = 'MEDIUM' AND list_contains(classes, 'widget') THEN 0 END",
    "CASE WHEN p_retailprice > 990.5 AND p_brand IN ('Brand#3', 'Brand#4') THEN 0 END",
    f"CASE WHEN contains({_HAY}, 'su') AND contains({_HAY}, 'blue') THEN 0 END",
)


@query(f"WITH c AS (SELECT *, string_split(p_name, ' ') AS classes FROM {{part}}) {' UNION ALL '.join(f'SELECT {i} AS search, p_partkey, CAST({f} AS INTEGER) AS reading FROM c WHERE {f} IS NOT NULL' for i, f in enumerate(_FILTERS))}")
def prj20_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ19, PRJ20, SRC8: cards by search strings over types, brands, classes, sizes, prices and names, in both modes and with chosen values."""
    cards = view(spark, sf_dir, "part").withColumn("classes", F.split("p_name", " "))
    found = [screened(cards, text, CATALOGUE, match, chips).select(F.lit(i).alias("search"), "p_partkey", "reading") for i, (text, match, chips) in enumerate(SEARCHES)]
    return reduce(DataFrame.unionAll, found)
