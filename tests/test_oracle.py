"""Every registered batch query against its DuckDB statement on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as registry
from check import TABLES, normalised

SF = "/root/testdata/sf0.001"
# The document queries have tests of their own, beside their subpackage.
QUERIES = {n: q for n, q in registry.queries().items() if not n.endswith("_stream") and n not in registry.LLM_QUERIES}
STATEMENTS = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in QUERIES if n in STATEMENTS])
def test_equals_statement(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    expected = duck.sql(STATEMENTS[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    want = normalised([tuple(r[i] for i in order) for r in expected.fetchall()])
    assert normalised(frame.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_only_processing_time_lacks_a_statement():
    assert {n for n in registry.queries() if n not in STATEMENTS and n not in registry.LLM_QUERIES} == {"q12", "q12_stream"}


def test_entry(spark):
    assert registry.entry(spark).count() == 5


def test_processing_time_counts_every_bid(spark):
    rows = QUERIES["q12"](spark, SF)
    assert rows.groupBy().sum("bid_count").first()[0] == 6000
