"""Queries of the training-data operators against their SQL, on the smallest tables."""

import pytest

from pairlab.llm.oracle import SQL
from pairlab.llm.queries import QUERIES

from ..compare import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf, duck):
    assert_same(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
