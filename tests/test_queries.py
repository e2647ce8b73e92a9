"""Every registered query: against its SQL where there is one, else that it returns rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entries
from checks.compare import database, difference
from conftest import DATA

QUERIES, ORACLES = entries.queries(), entries.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return database(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, DATA), connection, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, name):
    assert not QUERIES[name](spark, DATA).isEmpty()


def test_entry(spark):
    assert entries.entry(spark).columns == ["year_month", "mean_energy"]
