"""Cohort retention: long tables (canonical) and wide matrices (presentation).

Two denominators exist and are kept apart on purpose:

* ``retention_matrix`` divides active shoppers by the signup cohort size,
  customers without any order included.
* ``retention_first_index`` divides by the cohort's active shoppers at the
  smallest month index seen in any cohort (normally month 0); a cohort without
  that index gets null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.calendar import month_label
from cohortlens.functions.numeric import half_up_div
from cohortlens.operators.cohorts import active_months, cohort_size_by_ordinal
from cohortlens.plans.materialize import materialize


def active_by_ordinal(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """(cohort_ord, month_index, active_shoppers): exact distinct customer counts.

    Activity rows are unique per (customer, cohort, month index), so the
    distinct count is a plain count, combined map-side.
    """
    return (
        active_months(customers, orders)
        .groupBy("cohort_ord", "month_index")
        .agg(F.count(F.lit(1)).alias("active_shoppers"))
    )


def active_shoppers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """A2: ``cohort_month, month_index, active_shoppers``."""
    return active_by_ordinal(customers, orders).select(
        month_label("cohort_ord").alias("cohort_month"), "month_index", "active_shoppers"
    )


def retention_matrix(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """A3: ``cohort_month, cohort_size, month_index, active_shoppers, retention_rate``.

    ``retention_rate`` is ``active * 100 / cohort_size`` rounded half up to
    2 places. Cohorts without orders do not appear. The join with the sizes
    is a broadcast of at most one row per signup month.
    """
    cells = active_by_ordinal(customers, orders)
    sizes = cohort_size_by_ordinal(customers)
    return cells.join(F.broadcast(sizes), "cohort_ord").select(
        month_label("cohort_ord").alias("cohort_month"),
        "cohort_size",
        "month_index",
        "active_shoppers",
        (
            half_up_div(F.col("active_shoppers") * 10000, F.col("cohort_size")).cast("double")
            / 100.0
        ).alias("retention_rate"),
    )


def retention_first_index(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """A4: ``cohort_month, month_index, active_shoppers, first_index_shoppers, retention_fraction``.

    ``retention_fraction = active_shoppers / first_index_shoppers`` where the
    denominator is the cohort's actives at the global minimum month index;
    null when the cohort has no row at that index.
    """
    return first_index_from_cells(active_by_ordinal(customers, orders))


def first_index_from_cells(cells: DataFrame) -> DataFrame:
    """A4 from a cell table ``(cohort_ord, month_index, active_shoppers, ...)``, read once.

    The windows run over the cells, at most months^2 rows.
    """
    first_index = F.min("month_index").over(Window.partitionBy())
    base = F.max(F.when(F.col("month_index") == F.col("first_index"), F.col("active_shoppers")))
    return (
        cells.select("cohort_ord", "month_index", "active_shoppers", first_index.alias("first_index"))
        .withColumn("first_index_shoppers", base.over(Window.partitionBy("cohort_ord")))
        .select(
            month_label("cohort_ord").alias("cohort_month"),
            "month_index",
            "active_shoppers",
            "first_index_shoppers",
            (F.col("active_shoppers").cast("double") / F.col("first_index_shoppers")).alias(
                "retention_fraction"
            ),
        )
    )


def pivot_months(
    long_df: DataFrame, value: str, indices: Sequence[int] | None, cheap_input: bool = False
) -> DataFrame:
    """``cohort_month`` rows x one column per month index holding ``value``.

    With ``indices`` the columns are exactly these, in their order; an
    observed index that is not listed fails the query, so no cell is lost.

    Without, every observed index becomes a column. Spark then runs a job for
    the distinct indices while the plan is built; unless the long input is
    ``cheap_input`` (derived from an already written cell table), it (at most
    months^2 rows) is written once in the shared folder so that this job does
    not recompute it from the fact table.
    """
    if indices is not None:
        known = F.col("month_index").isin([int(i) for i in indices])
        unlisted = F.raise_error(F.concat(F.lit("month index not in the column list: "), F.col("month_index").cast("string")))
        checked = long_df.withColumn("month_index", F.when(known, F.col("month_index")).otherwise(unlisted.cast("int")))
        return checked.groupBy("cohort_month").pivot("month_index", [int(i) for i in indices]).agg(F.first(value))
    if not cheap_input:
        long_df = materialize(long_df.select("cohort_month", "month_index", value), "pivot-input")
    return long_df.groupBy("cohort_month").pivot("month_index").agg(F.first(value))


def retention_wide(
    customers: DataFrame,
    orders: DataFrame,
    metric: str = "pct",
    indices: Sequence[int] | None = None,
) -> DataFrame:
    """Cohort rows x month-index columns; a missing cell stays null.

    ``metric="count"``: active shoppers. ``metric="pct"``: the first-index
    fraction times 100. Column names are the month indices as strings;
    ``indices`` as in :func:`pivot_months`.
    """
    if metric == "count":
        long_df = active_shoppers(customers, orders)
        return pivot_months(long_df, "active_shoppers", indices)
    if metric == "pct":
        long_df = retention_first_index(customers, orders).withColumn(
            "pct", F.col("retention_fraction") * 100.0
        )
        return pivot_months(long_df, "pct", indices)
    raise ValueError("metric must be 'pct' or 'count'")
