from __future__ import annotations

from cohortlens.operators import ltv
from tests.conftest import customers_df, orders_df, rows


def _gap_fixture(spark):
    # cohort 2024-01 (2 customers): spend in month 0 and 2 only;
    # cohort 2024-03 (1 customer): only its own month 0 (young cohort).
    c = customers_df(spark, [(1, "2024-01-03"), (2, "2024-01-09"), (3, "2024-03-05")])
    o = orders_df(
        spark,
        [(10, 1, "2024-01-05", 100), (11, 1, "2024-03-07", 50), (12, 3, "2024-03-06", 30)],
    )
    return c, o


def test_sparse_ltv_has_no_empty_cells(spark):
    c, o = _gap_fixture(spark)
    got = rows(ltv.cohort_ltv(c, o))
    assert got == [("2024-01", 2, 0, 50.0), ("2024-01", 2, 2, 75.0), ("2024-03", 1, 0, 30.0)]


def test_dense_ltv_flat_through_gaps_and_for_young_cohort(spark):
    c, o = _gap_fixture(spark)
    got = rows(ltv.ltv_matrix_long(c, o))
    # columns = indices observed in any cohort: 0 and 2 (not 1)
    assert got == [
        ("2024-01", 0, 50.0),
        ("2024-01", 2, 75.0),
        ("2024-03", 0, 30.0),
        ("2024-03", 2, 30.0),
    ]
    wide = {r["cohort_month"]: (r["0"], r["2"]) for r in ltv.ltv_matrix_wide(c, o).collect()}
    assert wide == {"2024-01": (50.0, 75.0), "2024-03": (30.0, 30.0)}


def test_half_cent_average_rounds_up(spark):
    c = customers_df(spark, [(1, "2024-01-03"), (2, "2024-01-09")])
    o = orders_df(spark, [(10, 1, "2024-01-05", "0.01")])
    assert rows(ltv.cohort_ltv(c, o), "average_ltv_inr") == [(0.01,)]


def test_latest_cohorts_and_payback(spark):
    c = customers_df(spark, [(i, f"2024-{i:02d}-01") for i in range(1, 11)])
    o = orders_df(spark, [(100 + i, i, f"2024-{i:02d}-02", 600) for i in range(1, 11)]
                  + [(200 + i, i, f"2024-{min(i + 1, 12):02d}-02", 600) for i in range(1, 11)])
    latest = {r[0] for r in rows(ltv.ltv_latest_cohorts(c, o, n=8))}
    assert latest == {f"2024-{i:02d}" for i in range(3, 11)}
    pay = {r[0]: (r[2], r[3]) for r in rows(ltv.cac_payback(c, o, cac=1000.0))}
    assert pay["2024-01"] == (1, True)  # 600 after month 0, 1200 after month 1
    none = {r[0]: (r[2], r[3]) for r in rows(ltv.cac_payback(c, o, cac=5000.0))}
    assert none["2024-01"] == (None, False)
