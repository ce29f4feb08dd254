"""Where plans register: queries by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewind.sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan under its function's name, with the SQL over the library's views that gives the same rows."""

    def register(plan: Query) -> Query:
        QUERIES[plan.__name__] = plan
        if oracle is not None:
            ORACLES[plan.__name__] = with_views(oracle)
        return plan

    return register


def percent_sql(now: str, base: str, guard: str = "TRUE", digits: int = 2) -> str:
    """DuckDB SQL of operators.scalar.percent()."""
    unit = 10**digits
    return f"CASE WHEN {base} > 0 AND {guard} THEN sign({now} - {base}) * CAST((200 * {unit} * abs({now} - {base}) + {base}) // (2 * {base}) AS DOUBLE) / {unit} END"
