"""Every dashboard metric for one customer segment, with one fact-table join for all cohort views.

The lifecycle dashboard shows, for a segment (or everyone):

* sales KPIs, revenue per month and per product category;
* the retention heatmap as counts and as percentages of first-index actives;
* cumulative LTV curves of the latest cohorts, the full dense LTV matrix and
  the constant CAC line;
* the repeat-interval histogram and the mean repeat interval.

Plan: the segment filter is pushed into the customer scan. All cohort views
come from one ``cohort_cells`` table (distinct actives and spend per cohort
cell, at most months^2 rows) materialized once, and the dense LTV table is
materialized once for both of its views. Sales metrics read the segment's
orders (left semi join). Per-customer interval metrics take the segment as
``customers=``, so they scope after their per-customer reduction. Calling
:func:`dashboard` runs the jobs that write these two tables and those that
find the matrices' month indices; the rest is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.calendar import month_label
from cohortlens.operators import ltv, purchases, retention, sales
from cohortlens.operators.cohorts import cohort_cells, cohort_size_by_ordinal
from cohortlens.operators.scope import segment_scope
from cohortlens.plans.materialize import materialize
from cohortlens.sources.schema import CAC_TARGET, HISTOGRAM_BINS, LATEST_COHORTS


def dashboard(
    customers: DataFrame,
    products: DataFrame,
    orders: DataFrame,
    segment: str | None = None,
    cac: float = CAC_TARGET,
    latest: int = LATEST_COHORTS,
    nbins: int = HISTOGRAM_BINS,
) -> dict[str, DataFrame]:
    """All dashboard metrics for ``segment`` (``None``/``"All"``: every customer).

    Keys: ``kpi_summary``, ``monthly_sales``, ``category_sales``,
    ``retention_counts_wide``, ``retention_pct_wide``, ``ltv_matrix_wide``,
    ``ltv_latest_cohorts``, ``cac_target_line``, ``interval_histogram``,
    ``mean_interval``.
    """
    scoped_customers, scoped_orders = segment_scope(customers, orders, segment)
    # Inner join with the scoped customers already limits orders to the segment.
    cells = materialize(cohort_cells(scoped_customers, orders), "dashboard-cells")
    sizes = cohort_size_by_ordinal(scoped_customers)
    dense = materialize(ltv.dense_from_cells(cells, sizes), "dashboard-ltv-dense")
    active = cells.select(
        month_label("cohort_ord").alias("cohort_month"), "month_index", "active_shoppers"
    )
    pct = retention.first_index_from_cells(cells).withColumn(
        "pct", F.col("retention_fraction") * 100.0
    )
    in_scope = None if scoped_customers is customers else scoped_customers
    return {
        "kpi_summary": sales.kpi_summary(scoped_customers, scoped_orders),
        "monthly_sales": sales.monthly_sales(scoped_orders),
        "category_sales": sales.category_sales(scoped_orders, products),
        "retention_counts_wide": retention.pivot_months(active, "active_shoppers", None, cheap_input=True),
        "retention_pct_wide": retention.pivot_months(pct, "pct", None, cheap_input=True),
        "ltv_matrix_wide": retention.pivot_months(ltv.dense_out(dense), "ltv", None, cheap_input=True),
        "ltv_latest_cohorts": ltv.dense_out(ltv.latest_from_dense(dense, latest)),
        "cac_target_line": ltv.cac_line_from_cells(cells, cac),
        "interval_histogram": purchases.interval_histogram(orders, nbins, customers=in_scope),
        "mean_interval": purchases.mean_interval(orders, customers=in_scope),
    }
