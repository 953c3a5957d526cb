"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(E._QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(E._QUERIES))
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, key, SF, con)
    assert res.get("cols_match"), res
    assert res.get("rows_match"), res
    assert res.get("types_match"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["cohort_month", "cohort_size", "month_index", "active_shoppers", "retention_rate"]
    assert df.count() > 0
