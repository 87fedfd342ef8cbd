from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from entry_queries.oracle import ORACLE
from entry_queries.queries import REGISTRY
from tests.oracle_compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, duck, name):
    assert differences(REGISTRY[name](spark, SF_DIR), duck, ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_flagship(spark):
    assert driver.entry(spark).columns == ["word", "n"]
