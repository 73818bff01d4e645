"""Every graph query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from modweave.plans import queries, source_queries  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(df):
    columns = sorted(df.columns)
    rows = [tuple(None if v is None or v != v else str(v) for v in row) for row in df[columns].astype(object).itertuples(index=False)]
    return columns, sorted(rows, key=lambda row: tuple((v is None, v or "") for v in row))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert normal(got) == normal(duck.sql(queries.ORACLE_SQL[name]).df())


def test_flagship_numbers(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.site_count for r in rows) == 82 and sum(r.total_excess for r in rows) == 303
    assert rows[0].barrel == "r:1" and (rows[0].site_count, rows[0].actual_cost, rows[0].total_excess) == (7, 20, 113)


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
