"""Every registered query with SQL, on the smallest benchmark scale."""

import pytest

import workloads
from check_queries import compare, database

SF = "/root/testdata/sf0.001"
# exact bounds by recursion are slow in SQL for long counts; the larger scale covers them
NAMES = sorted(workloads.ORACLES)


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name).startswith("ok")


def test_every_query_is_callable():
    assert len(workloads.QUERIES) >= 150 and set(workloads.ORACLES) <= set(workloads.QUERIES)
