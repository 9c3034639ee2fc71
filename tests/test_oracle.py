"""Every registered query with SQL against DuckDB on the smallest data."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, connection, name):
    problems, count = compare(spark, connection, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    # a filter may find nothing in so few rows
    assert [p for p in problems if p != "no rows"] == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
