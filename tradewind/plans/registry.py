"""All queries of the library and the SQL that checks them, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewind.plans import catalog, documents, feeds, latest, listings, market, people, people_keys, prices, resolver, registered, screener, softest, stores, streams, tournament, trade  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**latest.QUERIES, **prices.QUERIES, **people.QUERIES, **registered.QUERIES}
ORACLES: dict[str, str] = {**latest.ORACLES, **prices.ORACLES, **people.ORACLES, **registered.ORACLES}
