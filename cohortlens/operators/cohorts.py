"""Shared cohort building blocks.

Plan shape used by retention and LTV (scale notes):

1. ``customer_months``: orders are reduced to one row per (customer, order
   month) with a map-side partial aggregate *before* any join. Where no spend
   is needed, ``active_months`` reduces them to one set of months per customer. A customer
   holding a third of all orders becomes at most one row per month per map
   task, so no later exchange is skewed by it.
2. ``customer_activity``: that reduced table is joined to the customer's
   signup cohort on ``customer_id``. AQE turns this into a broadcast join
   when the customer side is measured small at runtime and keeps a
   sort-merge join otherwise; nothing is broadcast unmeasured.
3. Cells ``(cohort, month_index)`` are at most (#months)^2 rows, so the final
   aggregates, windows and joins with ``cohort_sizes`` (one row per signup
   month) run on tiny, calendar-bounded data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.calendar import month_label, month_ordinal
from cohortlens.functions.numeric import money_cents


def order_cents(orders: DataFrame) -> "F.Column":
    """``order_value`` of ``orders`` as BIGINT cents."""
    return money_cents(F.col("order_value"), orders.schema["order_value"].dataType)


def signup_cohorts(customers: DataFrame) -> DataFrame:
    """(customer_id, cohort_ord, copies): customers with a known id and signup date.

    Repeated customer rows are reduced map-side to one row per (customer,
    cohort) with their multiplicity, so a customer copied many times is one
    row per task before any shuffle; ``copies`` keeps SQL join semantics
    (repeated rows multiply spend, not distinct counts).
    """
    return (
        customers.where(F.col("customer_id").isNotNull() & F.col("signup_date").isNotNull())
        .groupBy("customer_id", month_ordinal("signup_date").alias("cohort_ord"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def cohort_size_by_ordinal(customers: DataFrame) -> DataFrame:
    """(cohort_ord, cohort_size): distinct customers per signup month.

    Customers without orders count; a null signup date has no cohort (and a
    null id is not counted). :func:`signup_cohorts` is already unique per
    (customer, cohort), so a plain count is the distinct count.
    """
    return (
        signup_cohorts(customers)
        .groupBy("cohort_ord")
        .agg(F.count(F.lit(1)).alias("cohort_size"))
    )


def cohort_sizes(customers: DataFrame) -> DataFrame:
    """A1: ``cohort_month, cohort_size``."""
    return cohort_size_by_ordinal(customers).select(
        month_label("cohort_ord").alias("cohort_month"), "cohort_size"
    )


def customer_months(orders: DataFrame) -> DataFrame:
    """(customer_id, order_ord, order_count, spend_cents), pre-aggregated map-side.

    Orders without customer or date cannot be placed in a cohort cell and are
    dropped here (the filter is pushed into the scan).
    """
    return (
        orders.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
        .select(
            "customer_id",
            month_ordinal("order_date").alias("order_ord"),
            order_cents(orders).alias("cents"),
        )
        .groupBy("customer_id", "order_ord")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("cents").alias("spend_cents"),
        )
    )


def activity_by_ordinal(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """(customer_id, cohort_ord, month_index, spend_cents): one row per customer, cohort and active month.

    Both join inputs are unique on their keys, (customer, order month) and
    (customer, cohort), so the rows are unique per (customer, cohort,
    month index): distinct customer counts over them are plain counts.

    Inner join: customers without orders and orders of unknown customers drop
    out, as in the cohort queries. A customer row repeated in ``customers``
    counts as in a SQL join: its spend is multiplied by the number of copies
    (``spend_cents``), while distinct customer counts are unaffected.
    """
    cm = customer_months(orders)
    sc = signup_cohorts(customers)
    return cm.join(sc, "customer_id").select(
        "customer_id",
        "cohort_ord",
        (F.col("order_ord") - F.col("cohort_ord")).alias("month_index"),
        (F.col("spend_cents") * F.col("copies")).alias("spend_cents"),
    )


def active_months(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """(customer_id, cohort_ord, month_index): one row per customer, cohort and active month, without spend.

    A customer's months are gathered as one set (at most one element per
    calendar month, combined map-side), so the orders cross a single exchange,
    on the customer, which the join with the signups uses too.
    """
    months = (
        orders.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
        .groupBy("customer_id")
        .agg(F.collect_set(month_ordinal("order_date")).alias("months"))
    )
    return (
        months.join(signup_cohorts(customers), "customer_id")
        .select("customer_id", "cohort_ord", F.explode("months").alias("order_ord"))
        .select("customer_id", "cohort_ord", (F.col("order_ord") - F.col("cohort_ord")).alias("month_index"))
    )


def customer_activity(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct ``customer_id, cohort_month, month_index`` of active customers.

    The activity rows are already unique on these columns (see
    :func:`active_months`), so no extra distinct shuffle is needed.
    """
    return (
        active_months(customers, orders)
        .select(
            "customer_id",
            month_label("cohort_ord").alias("cohort_month"),
            "month_index",
        )
    )


def monthly_spend(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """A5: ``customer_id, cohort_month, month_index, total_spend`` (spend summed per cell)."""
    return activity_by_ordinal(customers, orders).select(  # unique per customer cell already
        "customer_id",
        month_label("cohort_ord").alias("cohort_month"),
        "month_index",
        (F.col("spend_cents").cast("double") / 100.0).alias("total_spend"),
    )


def cohort_cells(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """(cohort_ord, month_index, active_shoppers, spend_cents): every cohort cell in one pass.

    Distinct active customers and summed spend per cell come from one
    aggregation over the customer-month rows, so retention and LTV views can
    share a single fact-table join (see :mod:`cohortlens.plans.dashboard`).
    """
    return (
        activity_by_ordinal(customers, orders)
        .groupBy("cohort_ord", "month_index")
        .agg(
            F.count(F.lit(1)).alias("active_shoppers"),  # rows are unique per customer
            F.sum("spend_cents").alias("spend_cents"),
        )
    )
