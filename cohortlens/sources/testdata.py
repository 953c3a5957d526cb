"""Adapter from the driver's TPC-H-style test tables to the star schema.

The test tables have no signup date and no product on an order, so this
module only renames/derives columns to give rows in the star-schema shape;
it does none of the analytics. The operators never rely on how these rows
were made.

* ``orders``: one row per ``orders`` row (``o_orderkey`` is the order id,
  ``o_totalprice`` the order value, ``o_orderdate`` cast to DATE).
* ``customers``: one row per ``customer`` row; ``signup_date`` is the
  customer's first order date minus ``c_custkey % 40`` days (null when the
  customer has no orders), ``segment`` is ``c_mktsegment``.
* ``customers_late``: the same with ``signup_date`` that many days *after* the
  first order for every third customer.
* ``products``: ``part`` with ``p_type`` as category.
* ``order_lines``: ``lineitem`` rows as one-product order lines
  (``l_partkey`` product, ``l_quantity`` quantity, ``l_extendedprice`` value).
* ``order_facts``: ``order_lines`` with the order's customer and date.
* ``orders_with_quantity``: ``orders`` plus the order's total line quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNUP_OFFSET_DAYS = 40  # fixed: signup lies 0..39 days before the first order

LINES_PER_PARTITION = 1_000_000  # of the join of lines and orders; some 100 MB to sort

# Fixed schemas of the test tables used here (no schema inference on read).
TABLE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("order_value"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (
        orders(spark, sf_dir)
        .groupBy("customer_id")
        .agg(F.min("order_date").alias("first_order_date"))
    )
    c = _table(spark, sf_dir, "customer")
    return c.join(first, c["c_custkey"] == first["customer_id"], "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.date_sub(
            "first_order_date", (F.col("c_custkey") % SIGNUP_OFFSET_DAYS).cast("int")
        ).alias("signup_date"),
        F.col("c_mktsegment").alias("segment"),
    )


def customers_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customers`` with every third signup after the first order, so that month indices below 0 occur."""
    shift = (F.col("customer_id") % SIGNUP_OFFSET_DAYS).cast("int")
    late = F.date_add("signup_date", 2 * shift)  # first order date plus, not minus, the offset
    return customers(spark, sf_dir).withColumn(
        "signup_date", F.when(F.col("customer_id") % 3 == 0, late).otherwise(F.col("signup_date"))
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("order_value"),
    )


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order's customer and date: rows of the full fact schema.

    Tables of many lines are joined in as many partitions as they need, not in the session's fixed number.
    """
    o = orders(spark, sf_dir).select("order_id", "customer_id", "order_date")
    lines = order_lines(spark, sf_dir)
    partitions = -(-lines.count() // LINES_PER_PARTITION)
    if partitions > int(spark.conf.get("spark.sql.shuffle.partitions")):
        o, lines = (x.repartition(partitions, "order_id") for x in (o, lines))
    return lines.join(o, "order_id").select(
        "order_id", "customer_id", "product_id", "order_date", "quantity", "order_value"
    )


def orders_with_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty = (
        order_lines(spark, sf_dir)
        .groupBy("order_id")
        .agg(F.sum("quantity").cast("int").alias("quantity"))
    )
    return orders(spark, sf_dir).join(qty, "order_id", "left").select(
        "order_id", "customer_id", "order_date", "quantity", "order_value"
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem")


def _customer_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer_id, row): ``customers`` as row tuples of an INSERT (quotes doubled, nulls bare)."""

    def literal(name: str):
        quoted = F.concat(F.lit("'"), F.replace(F.col(name).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(quoted, F.lit("NULL"))

    row = F.concat(
        F.lit("("), F.col("customer_id").cast("string"), F.lit(", "),
        F.concat_ws(", ", literal("customer_name"), literal("signup_date"), literal("segment")), F.lit(")"),
    )
    return customers(spark, sf_dir).select("customer_id", row.alias("row"))


def write_customer_dump(spark: SparkSession, sf_dir: str, path: str, rows_per_file: int = 500) -> None:
    """``customers`` as text files of INSERT statements, the input of the dump reader."""
    statement = F.concat(F.lit("INSERT INTO customers VALUES\n"), F.array_join(F.collect_list("row"), ",\n"), F.lit(";\n"))
    _customer_tuples(spark, sf_dir).groupBy(F.floor(F.col("customer_id") / rows_per_file).alias("file")).agg(
        statement.alias("value")
    ).select("value").write.text(path)


def write_customer_script(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``customers`` as one file with one INSERT statement, as a seed script holds them; one task streams the file."""
    tuples = _customer_tuples(spark, sf_dir).select(F.lit(1).alias("o"), F.concat("row", F.lit(",")).alias("value"))
    edges = spark.createDataFrame([(0, "INSERT INTO customers VALUES"), (2, ";")], "o int, value string")
    tuples.unionByName(edges).repartitionByRange(1, "o").sortWithinPartitions("o").select("value").write.text(path)
