"""Each operator over literal texts and facts against the rows that were read through by hand."""

import duckdb
import pytest

import literal_queries


def test_every_query_has_rows():
    assert set(literal_queries.FOUND) == set(literal_queries.ROWS) == set(literal_queries.oracle_sql())
    assert all(rows for _, rows in literal_queries.ROWS.values())


@pytest.mark.parametrize("name", sorted(literal_queries.FOUND))
def test_rows(spark, name):
    got = literal_queries.FOUND[name](spark, "")
    want = duckdb.sql(literal_queries.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
