"""All segments in one pass, distinct counts by bitmaps, the row count beside an ad hoc result, the sized month export."""

from __future__ import annotations

import glob
import os
import random
import re
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import sales
from cohortlens.operators.scope import segment_scope
from cohortlens.plans import catalog
from cohortlens.sources import readers, sinks
from tests.conftest import customers_df, orders_df, products_df, rows
from tests.test_plans import plan

KPIS = ["total_sales", "total_customers", "total_orders", "avg_order_value", "items_per_order"]


def _star(spark, seed=1):
    """Customers without a segment, in two segments, repeated, without an id; orders without a customer, repeated ids."""
    r = random.Random(seed)
    c = customers_df(spark, [
        *[(i, "2024-01-03", r.choice(["Retail", "Corporate", None])) for i in range(1, 30)],
        (1, "2024-01-03", "Retail"), (1, "2024-01-03", "Corporate"), (1, "2024-01-03", "Corporate"), (40, "2024-01-01", "Empty"), (None, "2024-01-01", "Retail"),
    ])
    o = orders_df(spark, [
        (r.choice([None, r.randint(-50, 200), 10**15 + i]), r.choice([None, 99, r.randint(1, 30), 7]),
         r.choice([None, f"2024-0{r.randint(1, 9)}-05"]), r.choice([None, r.randint(1, 500)]), r.randint(1, 3), r.randint(1, 4))
        for i in range(300)
    ])
    return c, o, products_df(spark, [(1, "Hats"), (2, "Shoes"), (3, "Hats")])


def _scope(customers, orders, segment):
    """One segment's frames; the null segment by hand, as the plain filter can't name it."""
    if segment is not None:
        return segment_scope(customers, orders, segment)
    c = customers.where("segment IS NULL")
    return c, orders.join(c.select("customer_id").distinct(), "customer_id", "left_semi")


@pytest.mark.parametrize("dense", [False, True])
def test_every_row_equals_the_single_scope(spark, dense):
    c, o, p = _star(spark)
    got = {(r["all_segments"], r["segment"]): r for r in sales.kpi_by_segment(c, o, dense_ids=dense).collect()}
    assert set(got) == {(True, None), (False, None), (False, "Retail"), (False, "Corporate"), (False, "Empty")}
    for (whole, segment), r in got.items():
        cs, os_ = (c, o) if whole else _scope(c, o, segment)
        assert [r[k] for k in KPIS] == list(sales.kpi_summary(cs, os_).first()) == list(sales.kpi_summary(cs, os_, dense_ids=True).first())
    assert got[False, "Empty"]["total_orders"] == 0 and got[False, "Empty"]["items_per_order"] is None
    months, categories = sales.monthly_sales_by_segment(c, o).collect(), sales.category_sales_by_segment(c, o, p).collect()
    for (whole, segment) in got:
        os_ = o if whole else _scope(c, o, segment)[1]
        one = [tuple(r)[2:] for r in months if (r["all_segments"], r["segment"]) == (whole, segment)]
        assert sorted(one) == rows(sales.monthly_sales(os_))
        one = [tuple(r)[2:] for r in categories if (r["all_segments"], r["segment"]) == (whole, segment)]
        assert sorted(one) == rows(sales.category_sales(os_, p))


def test_empty_tables(spark):
    c, o, p = _star(spark)
    got = sales.kpi_by_segment(c.limit(0), o.limit(0)).collect()
    assert [tuple(r) for r in got] == [(True, None, 0.0, 0, 0, 0.0, None)]
    assert sales.monthly_sales_by_segment(c.limit(0), o.limit(0)).count() == 0
    only = sales.kpi_by_segment(c.limit(0), o, dense_ids=True).first()
    assert only["all_segments"] and list(only)[2:] == list(sales.kpi_summary(c.limit(0), o).first())


def test_one_pass_over_the_fact(spark):
    c, o, _ = _star(spark)
    path = f"{tempfile.mkdtemp(prefix='fact-')}/o"
    o.write.parquet(path)
    p = plan(sales.kpi_by_segment(c, spark.read.parquet(path), dense_ids=True))
    assert len(re.findall(r"FileScan parquet", p)) == 1


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "decimal(20,0)"])
def test_bitmaps_count_as_the_plain_way(spark, kind):
    r = random.Random(5)
    ids = [r.choice([None, 0, -1, 1, 32_767, 32_768, 32_769, -32_768, -32_769, 2**31 - 1, -(2**31), r.randint(-(2**31), 2**31 - 1)]) for _ in range(3_000)]
    if kind == "bigint":
        ids += [2**63 - 1, -(2**63), -(2**63) + 1, 2**40]
    o = orders_df(spark, [(1, 1, "2024-01-01", 2)]).drop("order_id").crossJoin(
        spark.createDataFrame([(None if i is None else str(i),) for i in ids], "i string").select(F.col("i").cast(kind).alias("order_id"))
    )
    c = o.select(F.col("order_id").alias("customer_id"), F.lit("x").alias("segment"))
    dense, plain = sales.kpi_summary(c, o, dense_ids=True), sales.kpi_summary(c, o)
    assert dense.first() == plain.first() and dense.first()["total_orders"] == len(set(ids) - {None})
    moved = [x for x in plan(dense).splitlines() if "Exchange hashpartitioning" in x]
    assert moved and all(("_id#" in x) == (kind not in ("bigint", "int")) for x in moved)


def test_counted_adhoc_sql_runs_once(spark):
    c, o, p = _star(spark)
    runs = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def touch(i):
        runs.add(1)
        return i

    spark.udf.register("touch", touch)
    res, count = catalog.adhoc_sql_counted(spark, "SELECT touch(product_id) AS i FROM products WHERE category = 'Hats'", c, p, o)
    assert runs.value == 0
    assert rows(res) == [(1,), (3,)] and count() == 2 and count() == 2 and runs.value == 2
    none, count = catalog.adhoc_sql_counted(spark, "SELECT * FROM orders WHERE 1 = 0", c, p, o)
    assert none.collect() == [] and count() == 0


def _files(path: str) -> dict[str, list[str]]:
    return {os.path.basename(m): glob.glob(f"{m}/*.csv") for m in glob.glob(f"{path}/order_month=*")}


def test_month_export_has_files_by_size_and_not_by_task(spark):
    r = random.Random(2)
    data = [(r.randint(1, 5_000), 1, f"2024-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", 5) for _ in range(6_000)]
    data += [(77, 1, "2024-03-03", 5)] * 3_000  # copies of one order: a third of all rows
    o = orders_df(spark, data).repartition(40)
    path = f"{tempfile.mkdtemp(prefix='months-')}/{uuid.uuid4().hex}"
    sinks.write_csv(o, path, "orders", partition_by_month=True, rows_per_file=1_000)
    files = _files(path)
    per_month = {f"order_month={m}": n for m, n in o.groupBy(F.date_format("order_date", "yyyy-MM").alias("m")).count().collect()}
    assert set(files) == set(per_month)
    for month, n in per_month.items():
        assert len(files[month]) <= 1.5 * n / 1_000 + 2, (month, n, len(files[month]))
        for f in files[month]:
            with open(f) as lines:
                assert sum(1 for _ in lines) - 1 <= 2_000
    assert rows(readers.read_csv(spark, path, "orders"), *o.columns) == rows(o)
    with pytest.raises(ValueError, match="positive"):
        sinks.write_csv(o, path, "orders", partition_by_month=True, rows_per_file=0)


def test_month_filter_reads_that_months_files_only(spark):
    o = orders_df(spark, [(i, 1, f"2024-0{1 + i % 5}-02", 5) for i in range(50)] + [(99, 1, None, 1)])
    path = f"{tempfile.mkdtemp(prefix='months-')}/{uuid.uuid4().hex}"
    sinks.write_csv(o, path, "orders", partition_by_month=True)
    two = readers.read_csv(spark, path, "orders", months=["2024-02", "2024-05"])
    assert rows(two) == rows(o.where("month(order_date) IN (2, 5)"))
    assert "PartitionFilters: [order_month" in plan(two)
    read = {r[0].split("/")[-2] for r in two.select(F.input_file_name()).collect()}
    assert read == {"order_month=2024-02", "order_month=2024-05"}
    flat = f"{path}-flat"
    sinks.write_csv(o, flat, "orders", with_order_month=True)
    assert rows(readers.read_csv(spark, flat, "orders", months=["2024-02"])) == rows(o.where("month(order_date) = 2"))
