"""Every registered query against its SQL form in DuckDB."""

import pytest

from orrery import registry
from same import assert_same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, sf, name):
    assert_same(registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
