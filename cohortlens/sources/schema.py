"""Fixed schemas of the star schema (never inferred) and model defaults."""

from __future__ import annotations

from pyspark.sql import types as T

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.LongType(), True),
        T.StructField("customer_name", T.StringType(), True),
        T.StructField("signup_date", T.DateType(), True),
        T.StructField("segment", T.StringType(), True),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType(), True),
        T.StructField("product_name", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("price", T.DecimalType(10, 2), True),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType(), True),
        T.StructField("customer_id", T.LongType(), True),
        T.StructField("product_id", T.LongType(), True),
        T.StructField("order_date", T.DateType(), True),
        T.StructField("quantity", T.IntegerType(), True),
        T.StructField("order_value", T.DecimalType(10, 2), True),
    ]
)

SCHEMAS = {"customers": CUSTOMERS, "products": PRODUCTS, "orders": ORDERS}
PRIMARY_KEYS = {"customers": ["customer_id"], "products": ["product_id"], "orders": ["order_id"]}
DATE_COLUMNS = {"customers": ["signup_date"], "orders": ["order_date"]}

# Fixed values of the analytics model.
CAC_TARGET = 1000.0          # customer acquisition cost line
HISTOGRAM_BINS = 50          # upper bound on interval histogram bins
LATEST_COHORTS = 8           # cohorts drawn in the LTV chart
TOP_REPEATERS = 20           # rows of the repeat-interval report
MAX_PURCHASE_SEQUENCE = 5    # purchase sequence cap
ALL_SEGMENTS = "All"         # segment value meaning "no filter"

# Output columns of the four named analyses, in order.
NAMED_RESULT_COLUMNS = {
    "retention_matrix": ["cohort_month", "cohort_size", "month_index", "active_shoppers", "retention_rate"],
    "cohort_ltv": ["cohort_month", "cohort_size", "month_index", "average_ltv_inr"],
    "repeat_intervals": ["customer_id", "total_repeat_orders", "avg_days_between"],
    "dense_rank_orders": ["purchase_sequence", "total_orders", "average_order_value_inr"],
}
