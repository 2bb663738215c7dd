"""Every registered query against DuckDB on the smallest data folder."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, compare, connect

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    run, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert run(spark, FOLDER).count() > 0
    else:
        assert compare(spark, duck, run, sql, FOLDER) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
