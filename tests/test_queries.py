"""Every query beside its SQL on the smallest tables; those without SQL must run and keep their columns."""

import os

import pytest

import __spark_entry__ as entry
from loomwright.plans import catalogue
from tests.compare import canonical, tables

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    tables(c, FOLDER)
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    ours = entry.queries()[name](spark, FOLDER).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        theirs = con.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert canonical(ours) == canonical(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
