"""Bucketed tables: the fact is not moved, and the results are those of the plain path."""

from __future__ import annotations

import glob
import re
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohorts, ltv, purchases, retention
from cohortlens.sources import testdata as td
from cohortlens.sources.bucketed import read_bucketed, write_bucketed
from tests.conftest import orders_df, rows
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """(bucketed customers, bucketed orders, plain customers, plain orders); no broadcast joins, which would hide exchanges."""
    folder, tag = tempfile.mkdtemp(prefix="bucketed-"), uuid.uuid4().hex
    plain = td.customers(spark, SF), td.orders(spark, SF)
    for table, df in zip(("customers", "orders"), plain, strict=True):
        write_bucketed(df, table, f"{table}_{tag}", 6, f"{folder}/{table}")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield (*(read_bucketed(spark, f"{t}_{tag}") for t in ("customers", "orders")), *plain, folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for t in ("customers", "orders"):
        spark.sql(f"DROP TABLE {t}_{tag}")


def _moved(df) -> list[str]:
    """What exchanges by customer move, with the node below each."""
    return re.findall(r"Exchange hashpartitioning\([^)]*customer_id[^\n]*\n[^\n]*", plan(df))


CUSTOMER_QUERIES = {
    "retention": lambda c, o: retention.retention_matrix(c, o),
    "first_index": lambda c, o: retention.retention_first_index(c, o),
    "activity": lambda c, o: cohorts.customer_activity(c, o),
    "monthly_spend": lambda c, o: cohorts.monthly_spend(c, o),
    "ltv": lambda c, o: ltv.cohort_ltv(c, o),
    "dense_ltv": lambda c, o: ltv.ltv_matrix_long(c, o),
    "repeats": lambda c, o: purchases.repeat_interval_stats(o, c),
    "mean": lambda c, o: purchases.mean_interval(o),
    "histogram": lambda c, o: purchases.interval_histogram(o),
    "sequence_stats": lambda c, o: purchases.dense_rank_orders(o),
}


@pytest.mark.parametrize("name", CUSTOMER_QUERIES)
def test_nothing_is_moved_by_customer_and_results_agree(tables, name):
    c, o, plain_c, plain_o, _ = tables
    query = CUSTOMER_QUERIES[name]
    if name not in ("dense_ltv",):  # writes its cells before its plan is made
        assert _moved(query(plain_c, plain_o)) and not _moved(query(c, o))
    assert rows(query(c, o)) == rows(query(plain_c, plain_o))


def test_intervals_read_the_fact_in_place(spark, tables):
    c, o, _, plain_o, _ = tables
    key = "spark.sql.requireAllClusterKeysForCoPartition"  # rows and days meet on (customer, day), partitioned by customer
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert "Exchange" not in plan(purchases.purchase_intervals(o))
        assert rows(purchases.purchase_intervals(o)) == rows(purchases.purchase_intervals(plain_o))
    finally:
        spark.conf.set(key, old)


def test_one_sorted_file_a_bucket(spark, tables):
    *_, folder = tables
    for t in ("customers", "orders"):
        files = glob.glob(f"{folder}/{t}/*.parquet")
        assert len(files) == 6
        for f in files:
            ids = [r[0] for r in spark.read.parquet(f).select("customer_id").collect()]
            assert ids == sorted(ids)


def test_null_customers_and_wrong_arguments(spark):
    o = orders_df(spark, [(1, None, "2024-01-01", 2), (2, 5, None, 3), (3, 5, "2024-01-02", 4)])
    name = f"o_{uuid.uuid4().hex}"
    write_bucketed(o, "orders", name, 2, f"{tempfile.mkdtemp(prefix='bucketed-')}/o")
    assert rows(read_bucketed(spark, name)) == rows(o)
    spark.sql(f"DROP TABLE {name}")
    with pytest.raises(ValueError, match="customer_id"):
        write_bucketed(o.drop("customer_id"), "orders", "x", 2)
    with pytest.raises(ValueError, match="bucket"):
        write_bucketed(o.select(F.lit(1).alias("customer_id")), "orders", "x", 0)
