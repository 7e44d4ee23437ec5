"""Every registered query on the smallest tables; those with SQL must give the same rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

# At this size these results are legitimately empty.
MAY_BE_EMPTY = {"ad_outliers", "correlation_filter", "correlation_filter_gaps", "tanimoto_search", "tanimoto_search_prefix", "all_targets_met"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, data, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, data).count() > 0
    else:
        problem = compare(spark, con, data, name, query, sql)
        assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["toxic", "n", "first_doc"] and rows.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
