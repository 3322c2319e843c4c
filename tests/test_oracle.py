"""Every registered query against its DuckDB statement."""

import pytest

import __spark_entry__ as entry
from oracle import all_statements
from sievebase.plans.queries import all_queries
from tools.compare import compare, duck

QUERIES, SQL = {name: entry.queries()[name] for name in all_queries()}, all_statements()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, info = compare(spark, con, QUERIES[name], SQL[name], sf_dir)
    assert ok, info


def test_entry_is_the_health_score(spark):
    assert entry.entry(spark).columns == ["repo", "critical", "warning", "info", "health_score"]
