"""Every query with a SQL twin must give the same rows on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture()
def con():
    """A connection per test: a fatal error ends the database it happens in."""
    with connect(SF) as opened:
        yield opened


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, SQL[name]) is None


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert {"account_id", "start_day", "end_day", "scale_days", "coverage", "n_days"} == set(df.columns)
    assert df.count() > 0


def test_oracle_keys_are_queries():
    assert set(SQL) <= set(entry.queries())
