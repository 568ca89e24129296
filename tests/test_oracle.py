"""Every query with SQL must equal DuckDB on the smallest tables; the rest must run."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Model training, minutes each, run when TEST_ALL=1; tests/compare.py runs it too.
LONG = {"i3_gbt_robust", "i4_quantile_trees", "i5_random_forest", "i6_boosted_native_cat", "i7_boosted_multi_quantile", "i20_training_window_comparison"}
# The operators of the optional subpackage have tests of their own.
LONG |= {n for n in queries() if n.startswith("op") or n == "pipeline"}
NAMES = [n for n in queries() if os.environ.get("TEST_ALL") or n not in LONG]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert result["status"] in ("ok", "close", "rows-only"), result


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
