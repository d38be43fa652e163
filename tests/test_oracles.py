"""Every query with a SQL oracle equals DuckDB on the sf0.01 tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF01
from tools.oracle_check import compare

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF01).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert compare(got, want) in ("EQUAL", "CLOSE")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "n_previous_clicks" in df.columns and "channel_custom_score" in df.columns
