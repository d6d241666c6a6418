"""Every registered query against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) == []


def test_entry(spark):
    assert entry(spark).columns == ["loan_id", "month_idx", "delinquency_12", "upb_12", "copies"]


def test_names():
    assert len(queries()) > 140
    assert set(oracle_sql()) <= set(queries())
