"""Every registered query against its SQL in the other engine."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from checks import oracle, registry
from checks.compare import connect, difference

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registry.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, db, name):
    assert difference(QUERIES[name](spark, SF_DIR), db, SQL[name]) is None


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
