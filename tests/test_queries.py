"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from tests.oracle import compare, duck

PATH = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, PATH), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, PATH).count() > 0


def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["quarter", "rank", "org_struct_lvl_2_name", "cases", "volume", "given_back", "remainder"]
    assert df.count() >= 3


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
