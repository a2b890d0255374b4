"""Every registered query of the reference's operators on the smallest tables: against DuckDB, or at least its schema."""

import os

import pytest

from oracle import connect, rows_of, rows_of_sql
from sluice.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = rows_of(catalog.QUERIES[name](spark, DATA))
    if name in catalog.ORACLE_SQL:
        assert got == rows_of_sql(con, catalog.ORACLE_SQL[name])
    else:
        assert got[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 1
    assert set(e.oracle_sql()) <= set(e.queries())
