"""Every registered query against its SQL on the smallest folder."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    problem = compare(spark, con, SF, name)
    assert problem in ("", "both empty"), problem


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "ml_risk_tier" in df.columns
