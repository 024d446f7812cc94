"""Every registered query beside its check SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert ok, note


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["rank", "skill", "n", "pct", "category"] and rows.count() == 10


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLE)
