"""Each query of the catalog against its SQL; those without SQL run and keep their schema."""

import pytest
from compare import database, difference
from conftest import DATA

from citelens import catalog


@pytest.fixture(scope="module")
def tables():
    return database(DATA)


@pytest.mark.parametrize("key", sorted(catalog.SQL))
def test_agrees_with_sql(spark, tables, key):
    assert difference(catalog.QUERIES[key](spark, DATA), tables, catalog.SQL[key]) == ""


@pytest.mark.parametrize("key", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, key):
    a, b = (catalog.QUERIES[key](spark, DATA) for _ in range(2))
    assert a.count() > 0 and a.schema == b.schema


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
