"""Every registered query against its SQL oracle."""

import pytest

from newswatch.plans import registry
from tests.oracle_check import compare, connect

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf_dir, con, name):
    rows, problems = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert not problems
    assert rows > 0


def test_the_comparison_sees_differences(spark, con):
    df = spark.sql("SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, 'y'")
    assert compare(df, con, "SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, 'y'")[1] == []
    assert compare(df, con, "SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, 'z'")[1]
    assert compare(df, con, "SELECT 1 AS a, 'x' AS b")[1]
    assert compare(df, con, "SELECT 1 AS a, 'x' AS c UNION ALL SELECT 2, 'y'")[1]
    assert compare(df, con, "SELECT 1.0::DOUBLE AS a, 'x' AS b UNION ALL SELECT 2.0, 'y'")[1]
