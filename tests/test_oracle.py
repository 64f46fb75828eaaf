"""Every query of the core against its SQL, over the smallest tables."""

import os

import pytest

from lodestrata.plans import catalog
from lodestrata.testing.oracle import connect, differences

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
REGISTRY = catalog.registry()
#: queries that SQL cannot state, or only at the cost of whole tables
WITHOUT_SQL = {"python_declarations", "split_oversize", "md_chunks", "umap_fuzzy_graph", "umap_layout"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_equals_sql(spark, con, name):
    _, _, only_spark, only_sql = differences(REGISTRY.fns[name](spark, DATA), con, REGISTRY.sql[name])
    assert (only_spark, only_sql) == ([], [])


def test_what_has_no_sql():
    assert set(REGISTRY.fns) - set(REGISTRY.sql) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    assert REGISTRY.fns[name](spark, DATA).count() > 0
