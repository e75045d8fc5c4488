"""Every core query against its SQL in DuckDB, on the smallest tables."""

import pytest

from pairlab.queries import QUERIES, SQL

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf, duck):
    assert_same(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
