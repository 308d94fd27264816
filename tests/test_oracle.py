"""Every registered query against its SQL, on the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks import oracle, queries
from checks.compare import connect, difference

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "compressed", "original_tokens", "compressed_tokens", "ratio", "multiplier"]
    assert df.count() == 287
