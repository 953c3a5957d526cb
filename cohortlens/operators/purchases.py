"""Repeat-purchase latency and purchase-sequence value.

Per customer, orders are ordered by ``(order_date, order_id)``; the order id
breaks same-day ties, and same-day repeats keep their 0-day gap.

Plan choices at scale (one customer may hold a third of all orders):

* Per-customer *aggregates* of gaps never need the ordered rows: the gaps
  between consecutive dates of a customer sum to ``last - first``, so the
  count and mean gap come from a plain ``count/min/max`` group-by, which is
  combined map-side before its shuffle.
* ``dense_rank_orders`` keeps only sequence numbers <= 5; Spark plans this as
  ``WindowGroupLimit`` on both sides of the shuffle, so a hot customer ships
  the rows of at most 5 distinct (date, id) keys per map task.
* Row-level results (``purchase_intervals``, ``purchase_sequence``) rank in
  two levels: rows within (customer, day), which is the one exchange of whole
  rows, and a customer's *days*, at most one row per calendar day, whose answer
  is joined to the rows where they are. A hot customer's orders spread over
  their days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.calendar import day_gap
from cohortlens.functions.numeric import half_up_div
from cohortlens.operators.cohorts import order_cents
from cohortlens.sources.schema import HISTOGRAM_BINS, MAX_PURCHASE_SEQUENCE, TOP_REPEATERS

ORDER_KEYS = ["order_date", "order_id"]


def _scope(per_customer: DataFrame, customers: DataFrame | None) -> DataFrame:
    """Keep rows of customers in ``customers`` (left semi join on customer_id).

    Applied *after* a per-customer reduction: scoping and per-customer work
    commute, and the semi join then sees at most a few rows per customer
    instead of the raw orders of a possibly hot customer.
    """
    if customers is None:
        return per_customer
    keys = customers.select("customer_id").distinct()
    return per_customer.join(keys, "customer_id", "left_semi")


def repeat_interval_stats(orders: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """A7 for every repeat customer: ``customer_id, total_repeat_orders, avg_days_between``.

    Same result as ``LAG(order_date) OVER (PARTITION BY customer_id ORDER BY
    order_date, order_id)``, dropping rows without a previous date, then
    ``COUNT(*)`` and ``ROUND(AVG(DATEDIFF(order_date, prev)), 1)`` per
    customer: with m dated orders there are m-1 gaps summing to
    ``max(date) - min(date)``. Null-date orders sort first and never yield a
    gap; a null customer id is a group of its own, as in SQL windows.
    ``customers`` optionally scopes the result to those customers.
    """
    per_customer = (
        orders.where(F.col("order_date").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("dated_orders"),
            F.min("order_date").alias("first_date"),
            F.max("order_date").alias("last_date"),
        )
        .where(F.col("dated_orders") >= 2)
    )
    repeats = F.col("dated_orders") - 1
    return _scope(per_customer, customers).select(
        "customer_id",
        repeats.alias("total_repeat_orders"),
        (
            half_up_div(day_gap("last_date", "first_date") * 10, repeats).cast("double") / 10.0
        ).alias("avg_days_between"),
    )


def repeat_intervals(
    orders: DataFrame, top_n: int = TOP_REPEATERS, customers: DataFrame | None = None
) -> DataFrame:
    """Named query ``repeat_intervals``: the ``top_n`` customers by repeat orders.

    Descending repeat count, ties broken by ascending customer id (nulls
    first); a top-k report, so the limit is the feature
    (``TakeOrderedAndProject``: per-partition top-k, then a merge).
    """
    return (
        repeat_interval_stats(orders, customers)
        .orderBy(F.desc("total_repeat_orders"), F.asc_nulls_first("customer_id"))
        .limit(top_n)
    )


def _dated(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())


def _previous_days(days: DataFrame) -> DataFrame:
    """``days`` (one row per customer and order date) with the customer's previous order date."""
    return days.withColumn("prev", F.lag("order_date").over(Window.partitionBy("customer_id").orderBy("order_date")))


def purchase_intervals(orders: DataFrame) -> DataFrame:
    """Every repeat order with ``prev_order_date`` and ``days_between``.

    All columns of ``orders`` plus the previous order date of the same
    customer (order by date, then order id) and the day gap; first orders
    are dropped, as are orders without customer or date (they have no
    place in a customer's dated sequence).

    The first order of a day follows the customer's previous day, all others
    follow an order of the same day. Rows that repeat the first order's id on
    its day count one after another, by their other columns.

    Whole rows move once, by (customer, day); the customer's days, combined
    before they move, come to them.
    """
    dated = _dated(orders)
    days = _previous_days(dated.select("customer_id", "order_date").distinct())
    day = ["customer_id", "order_date"]
    rows = dated.select(*day, F.struct("*").alias("o"))
    first = F.row_number().over(Window.partitionBy(*day).orderBy("o.order_id", "o")) == 1
    joined = rows.withColumn("first", first).join(days, day)
    prev = F.when(F.col("first"), F.col("prev")).otherwise(F.col("order_date"))
    out = joined.select("o", prev.alias("prev")).where(F.col("prev").isNotNull())
    return out.select("o.*", F.col("prev").alias("prev_order_date"), day_gap("o.order_date", "prev").alias("days_between"))


def purchase_sequence(orders: DataFrame) -> DataFrame:
    """W3 row level: every order with ``purchase_sequence``.

    ``DENSE_RANK() OVER (PARTITION BY customer_id ORDER BY order_date,
    order_id)``; a repeated (date, id) pair shares its number. Null customers
    form a group, null dates and ids come first, as in a SQL window.

    The number is the count of distinct (date, id) pairs on the customer's
    earlier days plus the rank within the day, so that only the orders of one
    customer *and* day are ranked together. Whole rows move once, by
    (customer, day); beside them the distinct keys and the customer's days.
    """
    per_day = orders.groupBy("customer_id", "order_date").agg(F.count_distinct(F.struct("order_id")).alias("n"))
    w = Window.partitionBy("customer_id").orderBy("order_date").rowsBetween(Window.unboundedPreceding, -1)
    before = per_day.select(
        F.struct("customer_id", "order_date").alias("day"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")
    )
    # Null customers and dates: inside a struct, null parts are equal, as in a SQL window.
    rows = orders.select(F.struct("*").alias("o"), F.struct("customer_id", "order_date").alias("day"))
    in_day = F.dense_rank().over(Window.partitionBy("day").orderBy("o.order_id"))
    ranked = rows.select("o", "day", in_day.alias("in_day")).join(before, "day")
    return ranked.select("o.*", (F.col("before") + F.col("in_day")).cast("int").alias("purchase_sequence"))


def dense_rank_orders(
    orders: DataFrame,
    max_sequence: int = MAX_PURCHASE_SEQUENCE,
    customers: DataFrame | None = None,
) -> DataFrame:
    """Named query ``dense_rank_orders``: ``purchase_sequence, total_orders, average_order_value_inr``.

    For the first ``max_sequence`` purchases of every customer: number of
    orders (non-null order ids) and the mean order value rounded half up to
    2 places, per sequence number. ``customers`` optionally scopes the
    ranked rows (at most ``max_sequence`` per customer) to those customers.
    """
    w = Window.partitionBy("customer_id").orderBy(*ORDER_KEYS)
    ranked = orders.select(
        "customer_id", "order_id", order_cents(orders).alias("cents"), F.dense_rank().over(w).alias("purchase_sequence")
    ).where(F.col("purchase_sequence") <= max_sequence)
    return _scope(ranked, customers).groupBy("purchase_sequence").agg(
        F.count("order_id").alias("total_orders"),
        (half_up_div(F.sum("cents"), F.count("cents")).cast("double") / 100.0).alias(
            "average_order_value_inr"
        ),
    )


def mean_interval(orders: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """``n_intervals, mean_days_between`` over all repeat gaps (1 place, half up).

    One row, or no row when nobody repeats. Uses the same telescoping sums
    as :func:`repeat_interval_stats`: sum of all gaps = sum over customers of
    ``last - first``; number of gaps = sum of ``m - 1``. Orders without a
    customer are excluded (they form no customer sequence). ``customers``
    optionally scopes the per-customer sums to those customers.
    """
    per_customer = (
        orders.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("m"),
            day_gap(F.max("order_date"), F.min("order_date")).alias("span"),
        )
        .where(F.col("m") >= 2)
    )
    total = _scope(per_customer, customers).agg(
        F.sum(F.col("m") - 1).alias("n_intervals"), F.sum("span").alias("gap_days")
    )
    return total.where(F.col("n_intervals") > 0).select(
        "n_intervals",
        (half_up_div(F.col("gap_days") * 10, F.col("n_intervals")).cast("double") / 10.0).alias(
            "mean_days_between"
        ),
    )


# Bin widths 1, 2, 5 x 10^k: the "round" widths a chart axis uses.
_ROUND_WIDTHS = [m * 10**k for k in range(0, 16) for m in (1, 2, 5)]


def interval_histogram(orders: DataFrame, nbins: int = HISTOGRAM_BINS, customers: DataFrame | None = None) -> DataFrame:
    """``bin_start, bin_width, n_intervals`` of the repeat gaps (non-empty bins).

    Width: smallest ``w`` in {1, 2, 5} x 10^k with
    ``floor(max/w) - floor(min/w) + 1 <= nbins``; bins are ``[k*w, (k+1)*w)``.
    A customer's day with n orders has n - 1 gaps of 0 and one gap to the
    customer's previous day, so the orders are first reduced to (customer, day,
    n). The gaps are then counted per distinct day value (at most the calendar
    span of the data in days), on which min/max and the width are computed.
    ``customers`` optionally scopes the reduced rows to those customers.
    """
    days = _dated(orders).groupBy("customer_id", "order_date").agg(F.count(F.lit(1)).alias("n"))
    days = _previous_days(_scope(days, customers))
    gaps = F.array(
        F.struct(day_gap("order_date", "prev").alias("days_between"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit(0).alias("days_between"), (F.col("n") - 1).alias("n")),
    )
    per_day = (
        days.select(F.inline(gaps))
        .where(F.col("days_between").isNotNull() & (F.col("n") > 0))
        .groupBy("days_between")
        .agg(F.sum("n").alias("n"))
    )
    everything = Window.partitionBy()  # one task over <= (date span in days) rows
    lo = F.min("days_between").over(everything).cast("bigint")
    hi = F.max("days_between").over(everything).cast("bigint")
    widths = F.array(*[F.lit(w).cast("bigint") for w in _ROUND_WIDTHS])
    width = F.array_min(
        F.filter(
            widths,
            lambda w: F.floor(hi / w) - F.floor(lo / w) + F.lit(1) <= F.lit(nbins),
        )
    )
    binned = per_day.select("days_between", "n", width.alias("bin_width"))
    start = (F.floor(F.col("days_between") / F.col("bin_width")) * F.col("bin_width")).cast("bigint")
    return binned.groupBy(start.alias("bin_start"), "bin_width").agg(
        F.sum("n").alias("n_intervals")
    )
