"""Registered queries against their check SQL on the smallest tables."""

import pytest

from cuespan.plans.catalog import CHECKS, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_check_sql(spark, con, name):
    assert compare(spark, con, name, SF, QUERIES, CHECKS).startswith("ok")


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
