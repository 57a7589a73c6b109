"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks import all_queries
from checks.verify import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_queries.QUERIES, all_queries.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    outcome = compare(spark, con, QUERIES[name], ORACLE.get(name), SF)
    assert not outcome.startswith("FAIL"), outcome


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
