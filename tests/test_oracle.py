"""Every core query that has SQL gives the same rows as DuckDB, over the whole smallest tables."""

from __future__ import annotations

import pytest

from tests import compare
from tidelog.plans import problems, problems_sql, reference, reference_sql

QUERIES = problems.QUERIES | reference.QUERIES
SQL = problems_sql.SQL | reference_sql.SQL


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, small, name):
    assert compare.difference(spark, compare.connect(small), QUERIES[name], SQL[name], small) == ""
