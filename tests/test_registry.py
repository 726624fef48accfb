"""Every registered query against its DuckDB SQL, and the entry points."""

import pytest
from compare import check, connect

import __spark_entry__ as entry
from kerbline.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(small_sf):
    return connect(small_sf)


def test_every_query_has_sql():  # but one that goes label by label
    assert QUERIES.keys() - ORACLE.keys() == {"SCL24"}


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, small_sf, con, name):
    check(QUERIES[name](spark, small_sf), con, ORACLE[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()


def test_no_python_in_the_engine(spark, small_sf):
    for name in ("EVT5", "EVT8", "EVT10", "AGG4", "AGG7", "STA1"):
        plan = QUERIES[name](spark, small_sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))
