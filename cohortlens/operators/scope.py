"""Segment scope (P1, P2): narrow customers, then their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.sources.schema import ALL_SEGMENTS


def segment_customers(customers: DataFrame, segment: str | None) -> DataFrame:
    """Customers of ``segment`` (case-sensitive); ``None``/``"All"`` keeps everyone.

    The equality predicate is pushed into the Parquet/JDBC scan.
    """
    if segment is None or segment == ALL_SEGMENTS:
        return customers
    return customers.where(F.col("segment") == F.lit(segment))


def segment_orders(orders: DataFrame, scoped_customers: DataFrame) -> DataFrame:
    """Orders whose customer is in ``scoped_customers`` (left semi join).

    The customer side is reduced to distinct keys (map-side combined, so a
    copied customer row is one key); AQE broadcasts it when measured small,
    otherwise a sort-merge semi join runs with skew splitting of hot keys on
    the orders side.
    """
    keys = scoped_customers.select("customer_id").distinct()
    return orders.join(keys, "customer_id", "left_semi")


def segment_scope(
    customers: DataFrame,
    orders: DataFrame,
    segment: str | None,
    semi_join_orders: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(customers, orders)`` narrowed to one segment, as every dashboard metric expects.

    Cohort metrics inner-join orders to the (scoped) customers anyway, which
    already keeps exactly the in-scope orders; they pass
    ``semi_join_orders=False`` to skip a redundant join of the fact table.
    """
    scoped = segment_customers(customers, segment)
    if segment is None or segment == ALL_SEGMENTS or not semi_join_orders:
        return scoped, orders
    return scoped, segment_orders(orders, scoped)


def all_scopes(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """``orders`` once for the whole and once for each segment of its customer: ``all_segments, segment`` and all columns.

    One pass over the fact serves every choice of segment: the customers'
    segments, one row a customer, are joined to it and each order is expanded
    in place. ``all_segments`` tells the whole (its ``segment`` is null) from
    customers whose segment is null. As in :func:`segment_scope`, repeated
    customer rows don't repeat orders, a customer in two segments counts in
    both, and the whole keeps orders without a customer.
    """
    of_customer = customers.groupBy("customer_id").agg(F.collect_set(F.struct("segment")).alias("of"))
    whole = F.array(F.struct(F.lit(True).alias("all_segments"), F.lit(None).cast("string").alias("segment")))
    own = F.transform("of", lambda x: F.struct(F.lit(False).alias("all_segments"), x["segment"].alias("segment")))
    joined = orders.select("customer_id", F.struct("*").alias("o")).join(of_customer, "customer_id", "left")
    scopes = F.concat(whole, F.when(F.col("of").isNotNull(), own).otherwise(F.array().cast(_SCOPES)))
    return joined.select("o", F.explode(scopes).alias("scope")).select("scope.*", "o.*")


_SCOPES = "array<struct<all_segments: boolean, segment: string>>"
