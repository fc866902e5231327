"""Every registered query against its SQL, on the smallest data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from suite import ALL
from suite.check import connect, difference


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_names_are_unique():
    names = [q.name for q in ALL]
    assert len(set(names)) == len(names) and set(names) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("query", ALL, ids=lambda q: q.name)
def test_query(spark, con, sf, query):
    df = query.run(spark, sf)
    if query.sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, query.sql) is None
