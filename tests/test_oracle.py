"""Every registered query with a DuckDB twin returns the same rows (sf0.001)."""

import pytest

from __spark_entry__ import oracle_sql, queries
from conftest import SF_SMALL
from oracle_compare import compare, duck

SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_duckdb(spark, con, key):
    problems, n, _ = compare(spark, con, key, QUERIES[key], SQL[key], SF_SMALL)
    assert not problems, problems


def test_every_sql_key_is_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["channel", "total", "fraud_cases", "fraud_rate_pct"]
