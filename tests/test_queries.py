"""Every query of the engine against its SQL; those without SQL must run and give rows."""

import pytest

from tidemark import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
