"""Every query with a SQL form against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    status, rows, _, note = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", note


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["line_id", "period", "availability", "performance", "quality", "oee"]
    assert frame.count() > 0
