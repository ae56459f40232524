"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.compare import difference, duck
from trendloom.plans.oracle import oracle
from trendloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TWINS = oracle()


@pytest.fixture(scope="module")
def tables():
    return duck(FOLDER)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 11


@pytest.mark.parametrize("name", sorted(TWINS))
def test_equals_sql(spark, tables, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), tables.execute(TWINS[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
