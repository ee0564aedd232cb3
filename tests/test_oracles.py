"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle_check import compare, oracle_connection

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
FEW_ORDERS = {"busy_states"}  # no state has 200 orders in the smallest tables
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, con, name):
    if name not in FEW_ORDERS:
        assert con.execute(f"SELECT count(*) > 0 FROM ({ORACLES[name]})").fetchone()[0], "the oracle has no rows"
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_estimator_queries_return_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
