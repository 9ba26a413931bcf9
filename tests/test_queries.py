"""Every registered query against its SQL on the smallest tables; the others must return rows."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from tabloom.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = {n for n in QUERIES if n in REGISTRY}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(OWN & set(SQL)))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(OWN - set(SQL)))
def test_returns_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
