"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    equal, message = compare(spark, FOLDER, entry.queries()[name], entry.oracle_sql()[name], con)
    assert equal, message


def test_own_queries_have_sql():
    assert set(entry.QUERIES) <= set(entry.oracle_sql())
