"""Every query of the library against its SQL."""

import duckdb
import pytest

from tradewind.plans.registry import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "conversations", "pages", "labels")


def sortable(row: tuple) -> tuple:
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"  # the smallest with brands of 15 prices in 30 days
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(ORACLES[name]).arrow()
    want = got.read_all() if hasattr(got, "read_all") else got
    rows = QUERIES[name](spark, sf_dir)
    assert sorted(rows.columns) == sorted(want.column_names)
    spark_rows = sorted((tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect()), key=sortable)
    sql_rows = sorted((tuple(r[c] for c in sorted(rows.columns)) for r in want.to_pylist()), key=sortable)
    assert len(spark_rows) == len(sql_rows) > 0
    for a, b in zip(spark_rows, sql_rows):
        for x, y in zip(a, b):
            assert x == y and (x is None or type(x) is type(y)), (a, b)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
