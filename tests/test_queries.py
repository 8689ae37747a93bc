import os

import compare
import pytest
from quillon.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, con, name):
    assert name in queries.ORACLES or name in ("logistic_manual", "graph_forward")
    assert compare.one(name, queries.QUERIES, queries.ORACLES, spark, con, SF)
