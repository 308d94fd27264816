"""Queries with SQL against it, and the registration."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference
from promptloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None


def test_all_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names
