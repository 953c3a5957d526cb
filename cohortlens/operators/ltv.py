"""Cohort lifetime value: sparse SQL form, dense matrix form, payback.

All spend stays in BIGINT cents until the final projection.

* ``cohort_ltv`` (sparse): rows only for (cohort, index) cells with orders;
  ``average_ltv_inr = round(cumulative spend / cohort size, 2)``.
* ``ltv_matrix_long`` (dense): every observed cohort x every month index
  observed in *any* cohort, empty cells as 0 spend, so a curve stays flat
  through gaps and out to the largest index; unrounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.calendar import month_label
from cohortlens.functions.numeric import half_up_div
from cohortlens.operators.cohorts import activity_by_ordinal, cohort_size_by_ordinal
from cohortlens.operators.retention import pivot_months
from cohortlens.sources.schema import CAC_TARGET, LATEST_COHORTS


def spend_by_ordinal(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """(cohort_ord, month_index, spend_cents): spend per cohort cell.

    Aggregated straight from the customer-month rows (sum is associative, so
    the per-customer step of the SQL formulation is not needed).
    """
    return (
        activity_by_ordinal(customers, orders)
        .groupBy("cohort_ord", "month_index")
        .agg(F.sum("spend_cents").alias("spend_cents"))
    )


def cohort_monthly_spend(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """``cohort_month, month_index, cohort_spend``."""
    return spend_by_ordinal(customers, orders).select(
        month_label("cohort_ord").alias("cohort_month"),
        "month_index",
        (F.col("spend_cents").cast("double") / 100.0).alias("cohort_spend"),
    )


def _cumulative(cells: DataFrame) -> DataFrame:
    # Window per cohort over at most (#months) cells: tiny, calendar-bounded.
    w = Window.partitionBy("cohort_ord").orderBy("month_index")
    return cells.withColumn("cum_cents", F.sum("spend_cents").over(w))


def ltv_cells(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """(cohort_ord, month_index, cohort_size, cum_cents) for observed cells."""
    cells = _cumulative(spend_by_ordinal(customers, orders))
    sizes = cohort_size_by_ordinal(customers)  # one row per signup month
    return cells.join(F.broadcast(sizes), "cohort_ord")


def cohort_ltv(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """L1: ``cohort_month, cohort_size, month_index, average_ltv_inr`` (sparse, rounded)."""
    return ltv_cells(customers, orders).select(
        month_label("cohort_ord").alias("cohort_month"),
        "cohort_size",
        "month_index",
        (half_up_div(F.col("cum_cents"), F.col("cohort_size")).cast("double") / 100.0).alias(
            "average_ltv_inr"
        ),
    )


def _dense_grid(cells: DataFrame) -> DataFrame:
    """Observed cohorts x observed month indices, missing cells with 0 spend; reads ``cells`` once.

    A cohort's cells become one map (at most one entry per calendar month);
    the observed indices are the union of the maps' keys, gathered by a window
    over one row per cohort. The grid is at most (#months)^2 rows.
    """
    per_cohort = cells.groupBy("cohort_ord").agg(
        F.map_from_entries(F.collect_list(F.struct("month_index", "spend_cents"))).alias("spend")
    )
    indices = F.collect_list("indices").over(Window.partitionBy())
    observed = per_cohort.withColumn("indices", F.map_keys("spend")).select("cohort_ord", "spend", indices.alias("indices"))
    grid = observed.select("cohort_ord", "spend", F.explode(F.array_distinct(F.flatten("indices"))).alias("month_index"))
    return grid.select(
        "cohort_ord",
        "month_index",
        F.coalesce(F.try_element_at("spend", F.col("month_index")), F.lit(0).cast("bigint")).alias("spend_cents"),
    )


def ltv_dense_by_ordinal(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """(cohort_ord, month_index, cohort_size, cum_cents) on the dense grid."""
    return dense_from_cells(spend_by_ordinal(customers, orders), cohort_size_by_ordinal(customers))


def dense_from_cells(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Dense cumulative cells from ``cells (cohort_ord, month_index, spend_cents, ...)``.

    Returns ``(cohort_ord, month_index, cohort_size, cum_cents)``. ``sizes``
    is ``(cohort_ord, cohort_size)``, one row per signup month.
    """
    dense = _cumulative(_dense_grid(cells.select("cohort_ord", "month_index", "spend_cents")))
    return dense.join(F.broadcast(sizes), "cohort_ord")


def latest_from_dense(dense: DataFrame, n: int = LATEST_COHORTS) -> DataFrame:
    """Rows of the ``n`` most recent cohorts of a dense table (at most months^2 rows, ranked in one task)."""
    place = F.dense_rank().over(Window.orderBy(F.desc("cohort_ord")))
    return dense.withColumn("place", place).where(F.col("place") <= n).drop("place")


def dense_out(df: DataFrame) -> DataFrame:
    """``cohort_month, month_index, ltv`` from dense cumulative cells."""
    return df.select(
        month_label("cohort_ord").alias("cohort_month"),
        "month_index",
        (F.col("cum_cents").cast("double") / (F.col("cohort_size") * 100)).alias("ltv"),
    )


def ltv_matrix_long(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """L2 (long): ``cohort_month, month_index, ltv`` = cumulative spend / signup size, unrounded."""
    return dense_out(ltv_dense_by_ordinal(customers, orders))


def ltv_matrix_wide(
    customers: DataFrame, orders: DataFrame, indices: Sequence[int] | None = None
) -> DataFrame:
    """L2 (wide): one row per cohort, one DOUBLE column per month index; ``indices`` as in ``pivot_months``."""
    return pivot_months(ltv_matrix_long(customers, orders), "ltv", indices)


def ltv_latest_cohorts(
    customers: DataFrame, orders: DataFrame, n: int = LATEST_COHORTS
) -> DataFrame:
    """L3: dense LTV rows of the ``n`` most recent cohorts that have orders."""
    return dense_out(latest_from_dense(ltv_dense_by_ordinal(customers, orders), n))


def cac_target_line(
    customers: DataFrame, orders: DataFrame, cac: float = CAC_TARGET
) -> DataFrame:
    """``month_index, cac_target``: the CAC line drawn under the LTV curves.

    One row per month index of the dense LTV matrix (indices observed in any
    cohort), all with the constant ``cac``.
    """
    return cac_line_from_cells(spend_by_ordinal(customers, orders), cac)


def cac_line_from_cells(cells: DataFrame, cac: float = CAC_TARGET) -> DataFrame:
    """P7 from a cell table ``(cohort_ord, month_index, ...)``."""
    return cells.select("month_index").distinct().select(
        "month_index", F.lit(float(cac)).alias("cac_target")
    )


def cac_payback(
    customers: DataFrame, orders: DataFrame, cac: float = CAC_TARGET
) -> DataFrame:
    """L4: ``cohort_month, cohort_size, payback_month_index, cac_reached``.

    First observed month index whose cumulative LTV reaches ``cac``, compared
    exactly in cents (``cum_cents >= cac_cents * cohort_size``); null and
    ``cac_reached = false`` when the cohort never reaches it.
    """
    cac_cents = int(round(cac * 100))
    reached = F.col("cum_cents") >= F.lit(cac_cents) * F.col("cohort_size")
    return (
        ltv_cells(customers, orders)
        .groupBy("cohort_ord", "cohort_size")
        .agg(F.min(F.when(reached, F.col("month_index"))).alias("payback_month_index"))
        .select(
            month_label("cohort_ord").alias("cohort_month"),
            "cohort_size",
            "payback_month_index",
            F.col("payback_month_index").isNotNull().alias("cac_reached"),
        )
    )
