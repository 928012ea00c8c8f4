"""Every registered query against its SQL twin on the smallest data."""

import pytest
from harness import compare, duck
from riskframe.plans import load_all

PATH = "/root/testdata/sf0.001"
QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def con():
    c = duck(PATH)
    c.execute("SET TimeZone='UTC'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    ok, message = compare(QUERIES[name](spark, PATH), con, SQL[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, PATH).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
