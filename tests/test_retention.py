from __future__ import annotations

import pytest

from cohortlens.operators import cohorts, ltv, retention
from tests.conftest import customers_df, orders_df, rows


def test_month_after_signup_and_customer_without_orders(spark):
    c = customers_df(spark, [(1, "2024-01-30"), (2, "2024-01-05"), (3, "2024-01-10")])
    o = orders_df(spark, [(10, 1, "2024-02-01", 5), (11, 3, "2024-01-12", 5)])
    assert rows(cohorts.cohort_sizes(c)) == [("2024-01", 3)]
    act = rows(cohorts.customer_activity(c, o))
    assert act == [(1, "2024-01", 1), (3, "2024-01", 0)]  # customer 2 has no activity row
    m = rows(retention.retention_matrix(c, o))
    # month-0 actives (1) < cohort size (3); rate = 1*100/3 = 33.33
    assert m == [("2024-01", 3, 0, 1, 33.33), ("2024-01", 3, 1, 1, 33.33)]


def test_cohort_without_orders_is_absent(spark):
    c = customers_df(spark, [(1, "2024-01-03"), (2, "2024-02-03"), (3, "2024-02-04")])
    o = orders_df(spark, [(10, 1, "2024-01-05", 5)])
    sizes = rows(cohorts.cohort_sizes(c))
    assert sizes == [("2024-01", 1), ("2024-02", 2)]
    assert {r[0] for r in rows(retention.retention_matrix(c, o))} == {"2024-01"}


def test_two_orders_one_month_count_once(spark):
    c = customers_df(spark, [(1, "2024-01-03")])
    o = orders_df(spark, [(10, 1, "2024-01-05", 5), (11, 1, "2024-01-25", 7)])
    assert rows(retention.active_shoppers(c, o)) == [("2024-01", 0, 1)]
    assert rows(cohorts.monthly_spend(c, o)) == [(1, "2024-01", 0, 12.0)]


def test_order_before_signup_moves_first_index(spark):
    # cohort A has an order one month before signup -> global min index -1;
    # cohort B has no index -1 -> its fractions are null.
    c = customers_df(spark, [(1, "2024-03-10"), (2, "2024-03-12"), (3, "2024-05-01")])
    o = orders_df(
        spark,
        [(10, 1, "2024-02-25", 1), (11, 1, "2024-03-11", 1), (12, 2, "2024-03-20", 1), (13, 3, "2024-05-02", 1)],
    )
    m = rows(retention.retention_matrix(c, o), "cohort_month", "month_index", "active_shoppers")
    assert ("2024-03", -1, 1) in m  # SQL form keeps the negative index as a row
    fi = rows(retention.retention_first_index(c, o))
    assert ("2024-03", -1, 1, 1, 1.0) in fi
    assert ("2024-03", 0, 2, 1, 2.0) in fi
    assert ("2024-05", 0, 1, None, None) in fi


def test_null_keys_and_dates_drop(spark):
    c = customers_df(spark, [(1, "2024-01-03"), (2, None), (None, "2024-01-04")])
    o = orders_df(
        spark,
        [(10, 1, "2024-01-05", 5), (11, None, "2024-01-05", 5), (12, 2, "2024-01-06", 5), (13, 1, None, 5)],
    )
    m = rows(retention.retention_matrix(c, o))
    # null customer id counts toward no cohort size (COUNT DISTINCT ignores nulls)
    assert m == [("2024-01", 1, 0, 1, 100.0)]


def test_retention_rate_half_up(spark):
    # 1 of 8 -> 12.5 exactly; 1 of 3 -> 33.333 -> 33.33; 2 of 3 -> 66.67
    c = customers_df(spark, [(i, "2024-01-02") for i in range(1, 4)])
    o = orders_df(spark, [(10, 1, "2024-01-05", 1), (11, 2, "2024-02-05", 1), (12, 1, "2024-02-06", 1)])
    m = {(r[2]): r[4] for r in rows(retention.retention_matrix(c, o))}
    assert m == {0: 33.33, 1: 66.67}


def test_wide_forms(spark):
    c = customers_df(spark, [(1, "2024-01-03"), (2, "2024-01-04"), (3, "2024-02-01")])
    o = orders_df(
        spark, [(10, 1, "2024-01-05", 1), (11, 2, "2024-01-06", 1), (12, 1, "2024-03-01", 1), (13, 3, "2024-02-02", 1)]
    )
    counts = retention.retention_wide(c, o, "count")
    assert sorted(counts.columns) == ["0", "2", "cohort_month"]  # only observed indices
    got = {r["cohort_month"]: (r["0"], r["2"]) for r in counts.collect()}
    assert got == {"2024-01": (2, 1), "2024-02": (1, None)}
    pct = {r["cohort_month"]: (r["0"], r["2"]) for r in retention.retention_wide(c, o, "pct").collect()}
    assert pct == {"2024-01": (100.0, 50.0), "2024-02": (100.0, None)}
    fixed = retention.retention_wide(c, o, "count", indices=[0, 1, 2])
    assert sorted(fixed.columns) == ["0", "1", "2", "cohort_month"]


def test_unlisted_month_index_fails(spark):
    c = customers_df(spark, [(1, "2024-01-03")])
    o = orders_df(spark, [(10, 1, "2024-01-05", 1), (11, 1, "2024-04-06", 1)])  # months 0 and 3
    for build in (
        lambda: retention.retention_wide(c, o, "count", indices=[0, 1]),
        lambda: retention.retention_wide(c, o, "pct", indices=[0, 1]),
        lambda: ltv.ltv_matrix_wide(c, o, indices=[0, 1]),
    ):
        with pytest.raises(Exception, match="not in the column list: 3"):
            build().collect()
    wide = retention.retention_wide(c, o, "count", indices=[3, 0, 1])
    assert wide.columns == ["cohort_month", "3", "0", "1"] and rows(wide) == [("2024-01", 1, 1, None)]
