"""Physical-plan shape: the properties the operators are designed around."""

from __future__ import annotations

import re

from cohortlens.operators import cohorts, ltv, purchases, retention, sales
from cohortlens.operators.scope import segment_scope
from cohortlens.sources import testdata as td

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dense_rank_orders_uses_window_group_limit(spark):
    df = purchases.dense_rank_orders(td.orders(spark, SF))
    p = plan(df)
    assert "WindowGroupLimit" in p


def test_repeat_intervals_needs_no_window(spark):
    df = purchases.repeat_intervals(td.orders(spark, SF))
    p = plan(df)
    assert "Window" not in p
    assert "TakeOrderedAndProject" in p


def test_retention_pre_aggregates_orders_before_join(spark):
    df = retention.retention_matrix(td.customers(spark, SF), td.orders(spark, SF))
    p = plan(df)
    # orders are reduced to one set of months per customer before the customer join, in one exchange
    assert re.search(r"ObjectHashAggregate\(keys=\[customer_id#\d+L\], functions=\[partial_collect_set", p)
    assert "PushedFilters: [IsNotNull(o_orderdate), IsNotNull(o_custkey)]" in p
    # the orders scan reads only the two columns it needs
    assert "o_orderpriority" not in p and "o_orderstatus" not in p


def test_segment_filter_pushed_to_scan(spark):
    c, o = segment_scope(td.customers(spark, SF), td.orders(spark, SF), "BUILDING")
    text = c._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in text


def test_scan_reads_only_needed_columns(spark):
    df = sales.monthly_sales(td.orders(spark, SF))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan(df)


def test_row_level_results_stay_in_the_jvm(spark):
    for df in (purchases.purchase_intervals(td.orders(spark, SF)), purchases.purchase_sequence(td.orders(spark, SF))):
        assert not re.search("Python|Arrow|Pandas", plan(df))


def test_interval_histogram_reads_and_shuffles_orders_once(spark):
    p = plan(purchases.interval_histogram(td.orders(spark, SF)))
    assert p.count("FileScan") == 1
    assert p.index("HashAggregate") < p.index("FileScan")  # reduced to customer days before the first exchange


def test_dense_rank_orders_shuffles_orders_once(spark):
    p = plan(purchases.dense_rank_orders(td.orders(spark, SF)))
    assert p.count("Exchange hashpartitioning") == 2  # customer_id, purchase_sequence


def test_monthly_spend_aggregates_once_after_the_join(spark):
    p = plan(cohorts.monthly_spend(td.customers(spark, SF), td.orders(spark, SF)))
    assert "HashAggregate" not in p[: p.index("Join")]


def test_building_a_plan_starts_no_job(spark):
    """Exceptions, documented as eager: a wide matrix without a column list, and the dashboard."""
    sc = spark.sparkContext
    c, o, p = td.customers(spark, SF), td.order_facts(spark, SF), td.products(spark, SF)
    months = list(range(120))
    sc.setJobGroup("lazy", "lazy")
    try:
        purchases.purchase_intervals(o), purchases.purchase_sequence(o), purchases.interval_histogram(o)
        purchases.repeat_intervals(o), purchases.dense_rank_orders(o), purchases.mean_interval(o)
        retention.retention_matrix(c, o), retention.retention_first_index(c, o)
        retention.retention_wide(c, o, "pct", months), retention.retention_wide(c, o, "count", months)
        ltv.cohort_ltv(c, o), ltv.ltv_matrix_long(c, o), ltv.ltv_matrix_wide(c, o, months)
        ltv.ltv_latest_cohorts(c, o), ltv.cac_payback(c, o), ltv.cac_target_line(c, o)
        sales.category_sales(o, p), sales.kpi_summary(c, o), sales.monthly_sales(o)
        cohorts.cohort_sizes(c), cohorts.monthly_spend(c, o)
        assert not sc.statusTracker().getJobIdsForGroup("lazy")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_segment_repeat_intervals_semi_joins_after_aggregate(spark):
    from cohortlens.operators.scope import segment_customers

    df = purchases.repeat_intervals(
        td.orders(spark, SF), customers=segment_customers(td.customers(spark, SF), "BUILDING")
    )
    lines = optimized(df).splitlines()
    at = next(i for i, l in enumerate(lines) if "LeftSemi" in l)
    indent = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    left = []  # lines of the semi join's first (left) child subtree
    for l in lines[at + 1:]:
        if l[indent:indent + 2] == "+-":
            break
        left.append(l)
    # the semi join's left input is the per-customer aggregate, not the raw orders
    assert any(re.search(r"Aggregate \[customer_id#\d+L?\]", l) and "count(1)" in l for l in left), "\n".join(left)


def test_row_level_purchases_move_whole_rows_once(spark):
    """Neither rows nor days are moved again for the join of the two levels; days are combined before they move."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query, narrow in ((purchases.purchase_intervals, 0), (purchases.purchase_sequence, 1)):
            p = plan(query(td.orders(spark, SF)))
            below = re.findall(r"Exchange hashpartitioning.*\n[^\n]*?(Project|HashAggregate|Filter|Window)([^\n]*)", p)
            whole = [text for _, text in below if "order_value" in text]
            assert len(whole) == 1, p
            # distinct keys of the sequence; then the days, by day, by customer and back by day
            assert len(below) == 1 + narrow + 3, p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
