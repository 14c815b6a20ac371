"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from counterscope.registry.queries import REGISTRY
from tests import oracle_check

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SMALL)


def test_every_query_has_sql():
    assert all(q.sql for q in REGISTRY.values())
    assert REGISTRY.keys() <= driver.queries().keys() and driver.oracle_sql().keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    assert oracle_check.compare(spark, con, SMALL, driver.queries()[name], driver.oracle_sql()[name]) is None


def test_known_counts(spark):
    """Figures measured on this fixture beforehand."""
    count = lambda name: driver.queries()[name](spark, SMALL).count()
    assert count("snapshot_log") == 835
    assert count("dedup") == 704
    assert count("deltas") == 202
    assert count("delta_rejects") == 117


def test_entry(spark):
    assert driver.entry(spark).count() > 0
