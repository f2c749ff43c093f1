"""Every query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from loomlight.plans.catalog import QUERIES
from loomlight.plans.oracle import ORACLES
from tests.compare import database, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "InPandas")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    """The rows are those of the SQL twin; the plan compares no two tables pair by pair and runs no Python."""
    df = driver.queries()[name](spark, SF_DIR)
    assert not [node for node in (*PAIRWISE, *PYTHON) if node in plan(df)]
    assert differences(df, con, driver.oracle_sql()[name]) is None


def test_entry_is_in_order(spark):
    found = driver.entry(spark).limit(200).collect()
    order = [(r.req_id, r.tier, r.distance, r.name) for r in found]
    assert len(order) == 200 and order == sorted(order)
