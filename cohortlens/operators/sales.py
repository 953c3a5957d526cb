"""Sales KPIs, revenue by month and by category.

Pass segment-scoped frames (:func:`cohortlens.operators.scope.segment_scope`)
for one segment's figures; the ``_by_segment`` functions give the whole and all
segments in one pass over the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.calendar import month_label, month_ordinal
from cohortlens.operators.cohorts import order_cents
from cohortlens.operators.scope import all_scopes


#: What tells the scopes of :func:`cohortlens.operators.scope.all_scopes` apart.
SCOPE = ["all_segments", "segment"]


def _order_totals(orders: DataFrame, by: list[str], dense_ids: bool) -> DataFrame:
    """``*by, sales_cents, total_orders, qty_sum, qty_n``.

    With ``dense_ids`` and an integer order id, the distinct ids are counted
    by bitmaps: rows are combined by blocks of 32,768 ids before they move, one
    bitmap of 4 KB a block and task, so that no order id is exchanged. That
    saves where ids are numbered densely in the order they are stored; ids strewn over a wide range would
    cost a bitmap each, so it is the caller's choice. Other ids are counted plainly.
    """
    quantity = F.col("quantity") if "quantity" in orders.columns else F.lit(None).cast("int")
    sums = [F.sum(order_cents(orders)).alias("sales_cents"), F.sum(quantity).alias("qty_sum"), F.count(quantity).alias("qty_n")]
    if not (dense_ids and _is_integer(orders, "order_id")):
        return orders.groupBy(*by).agg(*sums, F.count_distinct("order_id").alias("total_orders"))
    blocks = orders.groupBy(*by, F.bitmap_bucket_number("order_id").alias("block")).agg(*sums, _bitmap("order_id"))
    added = [F.sum(c).alias(c) for c in ("sales_cents", "qty_sum", "qty_n")]
    return blocks.groupBy(*by).agg(*added, F.coalesce(F.sum(F.bitmap_count("ids")), F.lit(0)).alias("total_orders"))


def _is_integer(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


def _bitmap(column: str) -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("ids")


def _customer_totals(customers: DataFrame, by: list[str], dense_ids: bool) -> DataFrame:
    """``*by, total_customers``: distinct customer ids."""
    if not (dense_ids and _is_integer(customers, "customer_id")):
        return customers.groupBy(*by).agg(F.count_distinct("customer_id").alias("total_customers"))
    blocks = customers.groupBy(*by, F.bitmap_bucket_number("customer_id").alias("block")).agg(_bitmap("customer_id"))
    return blocks.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("ids")), F.lit(0)).alias("total_customers"))


def _kpis(total_customers: Column) -> list[Column]:
    cents, n = F.coalesce("sales_cents", F.lit(0).cast("bigint")), F.coalesce("total_orders", F.lit(0).cast("bigint"))
    return [
        (cents.cast("double") / 100.0).alias("total_sales"),
        total_customers.alias("total_customers"),
        n.alias("total_orders"),
        F.when(n > 0, cents.cast("double") / (n * 100)).otherwise(F.lit(0.0)).alias("avg_order_value"),
        F.when(F.col("qty_n") > 0, F.col("qty_sum").cast("double") / F.col("qty_n")).alias("items_per_order"),
    ]


def kpi_summary(customers: DataFrame, orders: DataFrame, dense_ids: bool = False) -> DataFrame:
    """One row: ``total_sales, total_customers, total_orders, avg_order_value, items_per_order``.

    * ``total_sales``: sum of order values, 0 when there are no orders.
    * ``total_customers``: distinct customers, with or without orders.
    * ``total_orders``: distinct order ids.
    * ``avg_order_value``: sales / orders, 0 when there are no orders.
    * ``items_per_order``: mean ``quantity`` over order rows, null when empty
      (or when the fact table carries no ``quantity`` column).

    Both inputs are reduced by global aggregates (partial per task); the
    customer count enters as a scalar subquery. ``dense_ids`` counts integer
    ids by bitmaps, which pays where they are numbered densely.
    """
    n_customers = _customer_totals(customers, [], dense_ids).scalar()
    return _order_totals(orders, [], dense_ids).select(*_kpis(n_customers))


def kpi_by_segment(customers: DataFrame, orders: DataFrame, dense_ids: bool = False) -> DataFrame:
    """The KPIs of the whole and of every segment in one pass over the fact: ``all_segments, segment`` and :func:`kpi_summary`'s columns.

    Each row equals :func:`kpi_summary` of that scope; a segment without orders has its row too.
    """
    scope = F.struct(*SCOPE).alias("scope")
    whole = customers.select(F.lit(True).alias("all_segments"), F.lit(None).cast("string").alias("segment"), "customer_id")
    own = customers.select(F.lit(False).alias("all_segments"), F.col("segment").cast("string").alias("segment"), "customer_id")
    no_one = customers.sparkSession.range(1).select(
        F.lit(True).alias("all_segments"), F.lit(None).cast("string").alias("segment"),
        F.lit(None).cast(customers.schema["customer_id"].dataType).alias("customer_id"),
    )
    people = _customer_totals(whole.unionByName(own).unionByName(no_one), SCOPE, dense_ids).select(scope, "total_customers")
    totals = _order_totals(all_scopes(customers, orders), SCOPE, dense_ids).select(scope, "sales_cents", "qty_sum", "qty_n", "total_orders")
    return people.join(totals, "scope", "left").select("scope.*", *_kpis(F.col("total_customers")))


def monthly_sales_by_segment(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """A14 of the whole and of every segment in one pass: ``all_segments, segment, order_month, sales``."""
    dated = all_scopes(customers, orders.where(F.col("order_date").isNotNull()))
    return (
        dated.groupBy(*SCOPE, month_ordinal("order_date").alias("ord"))
        .agg(F.sum(order_cents(orders)).alias("cents"))
        .select(*SCOPE, month_label("ord").alias("order_month"), (F.col("cents").cast("double") / 100.0).alias("sales"))
    )


def category_sales_by_segment(customers: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """A15 of the whole and of every segment in one pass: ``all_segments, segment, category, sales, sales_share`` (share within the scope)."""
    sold = all_scopes(customers, orders.where(F.col("product_id").isNotNull()))
    per_product = sold.groupBy(*SCOPE, "product_id").agg(F.sum(order_cents(orders)).alias("cents"))
    per_category = (
        per_product.join(products.select("product_id", "category"), "product_id")
        .groupBy(*SCOPE, "category")
        .agg(F.sum("cents").alias("cents"))
    )
    total = F.sum("cents").over(Window.partitionBy(*SCOPE))
    return per_category.select(
        *SCOPE,
        "category",
        (F.col("cents").cast("double") / 100.0).alias("sales"),
        F.try_divide(F.col("cents").cast("double"), total.cast("double")).alias("sales_share"),
    )


def monthly_sales(orders: DataFrame) -> DataFrame:
    """``order_month, sales`` (sum of order values per calendar month of the order date)."""
    return (
        orders.where(F.col("order_date").isNotNull())
        .groupBy(month_ordinal("order_date").alias("ord"))
        .agg(F.sum(order_cents(orders)).alias("cents"))
        .select(
            month_label("ord").alias("order_month"),
            (F.col("cents").cast("double") / 100.0).alias("sales"),
        )
    )


def category_sales(orders: DataFrame, products: DataFrame) -> DataFrame:
    """``category, sales, sales_share`` (inner join of orders and products on product_id).

    Orders are first summed per product (map-side combine, so a hot product
    is one row per task), then joined to the product dimension. The share's
    denominator is a window over the per-category sums, one row per category.
    """
    per_product = (
        orders.where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.sum(order_cents(orders)).alias("cents"))
    )
    per_category = (
        per_product.join(products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(F.sum("cents").alias("cents"))
    )
    total = F.sum("cents").over(Window.partitionBy())
    return per_category.select(
        "category",
        (F.col("cents").cast("double") / 100.0).alias("sales"),
        F.try_divide(F.col("cents").cast("double"), total.cast("double")).alias("sales_share"),
    )
