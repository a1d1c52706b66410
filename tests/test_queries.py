"""Every query of the engine against its SQL on the test tables."""

import pytest

import __spark_entry__ as entry_points
from tests.oracle import compare, connect

QUERIES, SQL = entry_points.QUERIES, entry_points.SQL


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, data, db, name):
    frame = QUERIES[name](spark, data)
    assert compare(frame, db, SQL[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 220
