"""DuckDB reference SQL for every key of ``__spark_entry__.queries()``.

Each statement starts from the driver's pre-registered tables and rebuilds
the star-schema views of ``cohortlens.sources.testdata`` in a WITH clause.
Money is summed in BIGINT cents and "rounded" values use the same integer
half-up rule as the Spark side, so both engines produce identical doubles.
"""

from __future__ import annotations

SEGMENT = "BUILDING"
CAC_TEST = 500000.0

# Star-schema views over the test tables (same definitions as the Spark adapter).
_VIEWS = """
orders_v AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CAST(o_orderdate AS DATE) AS order_date,
         CAST(o_totalprice AS DECIMAL(12,2)) AS order_value,
         CAST(round(CAST(o_totalprice AS DECIMAL(12,2)) * 100) AS BIGINT) AS cents
  FROM orders
),
first_order AS (
  SELECT customer_id, min(order_date) AS first_order_date FROM orders_v GROUP BY customer_id
),
customers_v AS (
  SELECT c.c_custkey AS customer_id, c.c_name AS customer_name,
         CAST(f.first_order_date - CAST(c.c_custkey % 40 AS INTEGER) AS DATE) AS signup_date,
         c.c_mktsegment AS segment
  FROM customer c LEFT JOIN first_order f ON f.customer_id = c.c_custkey
),
customers_late_v AS (
  SELECT customer_id, customer_name, segment,
         CAST(CASE WHEN customer_id % 3 = 0 THEN f.first_order_date + CAST(customer_id % 40 AS INTEGER)
                   ELSE signup_date END AS DATE) AS signup_date
  FROM customers_v LEFT JOIN first_order f USING (customer_id)
),
products_v AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(12,2)) AS price
  FROM part
),
lines_v AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
         CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * 100) AS BIGINT) AS cents
  FROM lineitem
)"""

# Segment-scoped customer/order views.
_SCOPED = f"""
seg_customers AS (SELECT * FROM customers_v WHERE segment = '{SEGMENT}'),
seg_orders AS (SELECT * FROM orders_v WHERE customer_id IN (SELECT customer_id FROM seg_customers))"""


def _half_up(num: str, den: str) -> str:
    """Integer round-half-away-from-zero of num/den (den > 0)."""
    return f"(sign({num}) * ((2 * abs({num}) + ({den})) // (2 * ({den}))))"


def _month_ord(d: str) -> str:
    return f"CAST(year({d}) * 12 + month({d}) - 1 AS INTEGER)"


def _label(o: str) -> str:
    return f"printf('%04d-%02d', CAST(floor({o} / 12) AS INTEGER), CAST({o} - floor({o} / 12) * 12 + 1 AS INTEGER))"


def _cohort_ctes(cust: str, ords: str) -> str:
    """Orders joined to signups row by row; distinct customers and sums per cell in one step each."""
    return f"""
act AS (
  SELECT o.customer_id, {_month_ord('c.signup_date')} AS cohort_ord,
         CAST({_month_ord('o.order_date')} - {_month_ord('c.signup_date')} AS INTEGER) AS month_index, o.cents
  FROM {ords} o JOIN {cust} c ON o.customer_id = c.customer_id
  WHERE o.order_date IS NOT NULL AND c.signup_date IS NOT NULL
),
sizes AS (
  SELECT {_month_ord('signup_date')} AS cohort_ord, count(DISTINCT customer_id) AS cohort_size
  FROM {cust} WHERE signup_date IS NOT NULL GROUP BY 1
),
cells AS (
  SELECT cohort_ord, month_index, count(DISTINCT customer_id) AS active_shoppers,
         CAST(sum(cents) AS BIGINT) AS spend_cents
  FROM act GROUP BY cohort_ord, month_index
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _q(body: str, *extra: str, scoped: bool = False, cust: str = "customers_v", ords: str = "orders_v",
       cohort: bool = True) -> str:
    parts = [_VIEWS] + ([_SCOPED] if scoped else []) + ([_cohort_ctes(cust, ords)] if cohort else []) + list(extra)
    return _with(*parts) + "\n" + body


def retention_matrix(scoped: bool = False) -> str:
    cust = "seg_customers" if scoped else "customers_v"
    return _q(f"""
SELECT {_label('c.cohort_ord')} AS cohort_month, s.cohort_size, c.month_index, c.active_shoppers,
       CAST({_half_up('c.active_shoppers * 10000', 's.cohort_size')} AS DOUBLE) / 100 AS retention_rate
FROM cells c JOIN sizes s ON c.cohort_ord = s.cohort_ord""", scoped=scoped, cust=cust)


def cohort_ltv(scoped: bool = False) -> str:
    cust = "seg_customers" if scoped else "customers_v"
    return _q(f"""
SELECT {_label('l.cohort_ord')} AS cohort_month, l.cohort_size, l.month_index,
       CAST({_half_up('l.cum_cents', 'l.cohort_size')} AS DOUBLE) / 100 AS average_ltv_inr
FROM ltv l""", _LTV_CELLS, scoped=scoped, cust=cust)


_LTV_CELLS = """
ltv AS (
  SELECT c.cohort_ord, c.month_index, s.cohort_size,
         CAST(sum(c.spend_cents) OVER (PARTITION BY c.cohort_ord ORDER BY c.month_index) AS BIGINT) AS cum_cents
  FROM cells c JOIN sizes s ON c.cohort_ord = s.cohort_ord
)"""

_DENSE = """
grid AS (
  SELECT co.cohort_ord, ix.month_index
  FROM (SELECT DISTINCT cohort_ord FROM cells) co CROSS JOIN (SELECT DISTINCT month_index FROM cells) ix
),
dense AS (
  SELECT g.cohort_ord, g.month_index, s.cohort_size,
         CAST(sum(coalesce(c.spend_cents, 0)) OVER (PARTITION BY g.cohort_ord ORDER BY g.month_index) AS BIGINT) AS cum_cents
  FROM grid g LEFT JOIN cells c ON c.cohort_ord = g.cohort_ord AND c.month_index = g.month_index
  JOIN sizes s ON s.cohort_ord = g.cohort_ord
),
dense_out AS (
  SELECT cohort_ord, """ + _label("cohort_ord") + """ AS cohort_month, month_index,
         CAST(cum_cents AS DOUBLE) / (cohort_size * 100) AS ltv
  FROM dense
)"""

_FIRST_INDEX = """
fi AS (
  SELECT c.cohort_ord, c.month_index, c.active_shoppers, b.first_index_shoppers,
         CAST(c.active_shoppers AS DOUBLE) / b.first_index_shoppers AS retention_fraction
  FROM cells c LEFT JOIN (
    SELECT cohort_ord, active_shoppers AS first_index_shoppers FROM cells
    WHERE month_index = (SELECT min(month_index) FROM cells)
  ) b ON b.cohort_ord = c.cohort_ord
)"""


def _purchase_gaps(ords: str) -> str:
    """Gaps between consecutive orders by LAG, then their count and mean per customer."""
    return f"""
gaps AS (
  SELECT customer_id, CAST(date_diff('day', lag(order_date) OVER w, order_date) AS BIGINT) AS gap
  FROM {ords}
  WINDOW w AS (PARTITION BY customer_id ORDER BY order_date ASC NULLS FIRST, order_id ASC NULLS FIRST)
),
stats AS (
  SELECT customer_id, count(*) AS total_repeat_orders,
         CAST({_half_up('CAST(sum(gap) AS BIGINT) * 10', 'count(*)')} AS DOUBLE) / 10 AS avg_days_between
  FROM gaps WHERE gap IS NOT NULL GROUP BY customer_id
)"""


def repeat_intervals(scoped: bool = False) -> str:
    ords = "seg_orders" if scoped else "orders_v"
    return _q("""
SELECT customer_id, total_repeat_orders, avg_days_between FROM stats
ORDER BY total_repeat_orders DESC, customer_id ASC NULLS FIRST LIMIT 20""",
              _purchase_gaps(ords), scoped=scoped, cohort=False)


_INTERVALS = """
lagged AS (
  SELECT order_id, customer_id, order_date, order_value,
         lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date ASC NULLS FIRST, order_id ASC NULLS FIRST) AS prev_order_date
  FROM orders_v WHERE customer_id IS NOT NULL AND order_date IS NOT NULL
),
intervals AS (
  SELECT *, CAST(date_diff('day', prev_order_date, order_date) AS INTEGER) AS days_between
  FROM lagged WHERE prev_order_date IS NOT NULL
)"""

_ROUND_WIDTHS = ",".join(f"({m * 10 ** k})" for k in range(0, 16) for m in (1, 2, 5))


def kpi_summary(scoped: bool = False) -> str:
    cust = "seg_customers" if scoped else "customers_v"
    ords = "seg_orders_q" if scoped else "orders_q"
    extra = [_ORDERS_Q]
    if scoped:
        extra.append("seg_orders_q AS (SELECT * FROM orders_q WHERE customer_id IN (SELECT customer_id FROM seg_customers))")
    return _q(f"""
SELECT CAST(sales_cents AS DOUBLE) / 100 AS total_sales,
       (SELECT count(DISTINCT customer_id) FROM {cust}) AS total_customers,
       total_orders,
       CASE WHEN total_orders > 0 THEN CAST(sales_cents AS DOUBLE) / (total_orders * 100) ELSE 0.0 END AS avg_order_value,
       CASE WHEN qty_n > 0 THEN CAST(qty_sum AS DOUBLE) / qty_n END AS items_per_order
FROM (
  SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) AS sales_cents, count(DISTINCT order_id) AS total_orders,
         CAST(sum(quantity) AS BIGINT) AS qty_sum, count(quantity) AS qty_n
  FROM {ords}
) a""", *extra, scoped=scoped, cohort=False)


def kpi_by_segment() -> str:
    return _q("""
SELECT p.all_segments, p.segment, CAST(coalesce(sales_cents, 0) AS DOUBLE) / 100 AS total_sales, total_customers,
       coalesce(total_orders, 0) AS total_orders,
       CASE WHEN total_orders > 0 THEN CAST(sales_cents AS DOUBLE) / (total_orders * 100) ELSE 0.0 END AS avg_order_value,
       CASE WHEN qty_n > 0 THEN CAST(qty_sum AS DOUBLE) / qty_n END AS items_per_order
FROM (
  SELECT grouping(segment) = 1 AS all_segments, segment, count(DISTINCT customer_id) AS total_customers
  FROM customers_v GROUP BY GROUPING SETS ((segment), ())
) p LEFT JOIN (
  SELECT grouping(c.segment) = 1 AS all_segments, c.segment, CAST(sum(o.cents) AS BIGINT) AS sales_cents,
         count(DISTINCT o.order_id) AS total_orders, CAST(sum(o.quantity) AS BIGINT) AS qty_sum, count(o.quantity) AS qty_n
  FROM orders_q o JOIN customers_v c ON c.customer_id = o.customer_id GROUP BY GROUPING SETS ((c.segment), ())
) o ON o.all_segments = p.all_segments AND o.segment IS NOT DISTINCT FROM p.segment""", _ORDERS_Q, cohort=False)


_FACTS = """
facts AS (
  SELECT l.l_orderkey AS order_id, o.customer_id, l.l_partkey AS product_id, o.order_date,
         CAST(l.l_quantity AS INTEGER) AS quantity, CAST(l.l_extendedprice AS DECIMAL(12,2)) AS order_value
  FROM lineitem l JOIN orders_v o ON o.order_id = l.l_orderkey
)"""

_ORDERS_Q = """
qty AS (SELECT order_id, CAST(sum(quantity) AS INTEGER) AS quantity FROM lines_v GROUP BY order_id),
orders_q AS (
  SELECT o.order_id, o.customer_id, o.order_date, q.quantity, o.order_value, o.cents
  FROM orders_v o LEFT JOIN qty q ON q.order_id = o.order_id
)"""


MONTH_COLUMNS = range(120)  # the same fixed column lists as the Spark queries
LATE_COLUMNS = range(-3, 120)


def _pivot(src: str, value: str, months: range = MONTH_COLUMNS) -> str:
    columns = ",\n  ".join(f'max(CASE WHEN month_index = {i} THEN {value} END) AS "{i}"' for i in months)
    return f"SELECT cohort_month,\n  {columns}\nFROM {src} GROUP BY cohort_month"


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_orders"] = _q("SELECT order_id, customer_id, order_date, order_value FROM orders_v", cohort=False)
    q["segment_customers"] = _q(
        "SELECT customer_id, customer_name, signup_date, segment FROM seg_customers", scoped=True, cohort=False)
    q["segment_orders"] = _q(
        "SELECT order_id, customer_id, order_date, order_value FROM seg_orders", scoped=True, cohort=False)
    q["pk_violations"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
    q["pk_violations_dense_ids"] = """
SELECT l_orderkey AS order_id, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"""
    q["fk_violations_dense_ids"] = """
SELECT 'product_id' AS fk_column, l_partkey AS key_value, count(*) AS n_rows FROM lineitem
WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_type LIKE 'S%')
GROUP BY l_partkey"""
    q["fk_violations"] = _q("""
SELECT 'customer_id' AS fk_column, customer_id AS key_value, count(*) AS n_rows FROM facts
WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)
GROUP BY customer_id
UNION ALL
SELECT 'product_id', product_id, count(*) FROM facts
WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL)
GROUP BY product_id""", _FACTS, cohort=False)
    q["fk_violations_product"] = """
SELECT 'product_id' AS fk_column, l_partkey AS key_value, count(*) AS n_rows FROM lineitem
WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
GROUP BY l_partkey"""
    q["export_fact_all"] = _q("""
SELECT order_id, customer_id, product_id, order_date, quantity, order_value,
       strftime(order_date, '%Y-%m') AS order_month
FROM facts""", _FACTS, cohort=False)
    q["export_fact"] = _q("""
SELECT order_id, customer_id, order_date, quantity, order_value FROM orders_q
WHERE customer_id IN (SELECT customer_id FROM seg_customers)""", _ORDERS_Q, scoped=True, cohort=False)
    q["csv_round_trip"] = _q("""
SELECT order_id, customer_id, product_id, order_date, quantity, CAST(order_value AS DECIMAL(10,2)) AS order_value
FROM facts""", _FACTS, cohort=False)
    q["csv_months"] = q["csv_round_trip"] + " WHERE strftime(order_date, '%Y-%m') IN ('1995-03', '1996-12')"
    q["sql_dump_customers"] = _q("SELECT customer_id, customer_name, signup_date, segment FROM customers_v", cohort=False)
    q["sql_dump_one_file"] = q["sql_dump_customers"]
    # retention
    q["cohort_sizes"] = _q(f"SELECT {_label('cohort_ord')} AS cohort_month, cohort_size FROM sizes")
    q["customer_activity"] = _q(
        f"SELECT DISTINCT customer_id, {_label('cohort_ord')} AS cohort_month, month_index FROM act")
    q["active_shoppers"] = _q(
        f"SELECT {_label('cohort_ord')} AS cohort_month, month_index, active_shoppers FROM cells")
    q["retention_matrix"] = retention_matrix()
    q["retention_matrix_segment"] = retention_matrix(scoped=True)
    q["retention_matrix_bucketed"] = q["retention_matrix"]
    q["retention_pct_first_index"] = _q(f"""
SELECT {_label('cohort_ord')} AS cohort_month, month_index, active_shoppers, first_index_shoppers, retention_fraction
FROM fi""", _FIRST_INDEX)
    q["retention_counts_wide"] = _q(_pivot(f"(SELECT {_label('cohort_ord')} AS cohort_month, month_index, active_shoppers FROM cells)", "active_shoppers"))
    q["retention_pct_wide"] = _q(_pivot(f"(SELECT {_label('cohort_ord')} AS cohort_month, month_index, retention_fraction * 100.0 AS pct FROM fi)", "pct"), _FIRST_INDEX)
    late = {"cust": "customers_late_v"}
    q["retention_pct_first_index_late"] = _q(f"""
SELECT {_label('cohort_ord')} AS cohort_month, month_index, active_shoppers, first_index_shoppers, retention_fraction
FROM fi""", _FIRST_INDEX, **late)
    q["retention_pct_wide_late"] = _q(_pivot(f"(SELECT {_label('cohort_ord')} AS cohort_month, month_index, retention_fraction * 100.0 AS pct FROM fi)", "pct", LATE_COLUMNS), _FIRST_INDEX, **late)
    q["ltv_matrix_long_late"] = _q("SELECT cohort_month, month_index, ltv FROM dense_out", _DENSE, **late)
    # LTV
    q["monthly_spend"] = _q(f"""
SELECT customer_id, {_label('cohort_ord')} AS cohort_month, month_index,
       CAST(CAST(sum(cents) AS BIGINT) AS DOUBLE) / 100 AS total_spend
FROM act GROUP BY customer_id, cohort_ord, month_index""")
    q["monthly_spend_bucketed"] = q["monthly_spend"]
    q["cohort_monthly_spend"] = _q(
        f"SELECT {_label('cohort_ord')} AS cohort_month, month_index, CAST(spend_cents AS DOUBLE) / 100 AS cohort_spend FROM cells")
    q["cohort_ltv"] = cohort_ltv()
    q["named_view_cohort_ltv"] = cohort_ltv()
    q["cohort_ltv_segment"] = cohort_ltv(scoped=True)
    q["ltv_matrix_long"] = _q("SELECT cohort_month, month_index, ltv FROM dense_out", _DENSE)
    q["ltv_matrix_wide"] = _q(_pivot("dense_out", "ltv"), _DENSE)
    q["ltv_latest_cohorts"] = _q("""
SELECT cohort_month, month_index, ltv FROM dense_out
WHERE cohort_ord IN (SELECT DISTINCT cohort_ord FROM dense_out ORDER BY cohort_ord DESC LIMIT 8)""", _DENSE)
    cac_cents = int(round(CAC_TEST * 100))
    q["cac_payback"] = _q(f"""
SELECT {_label('cohort_ord')} AS cohort_month, cohort_size,
       min(CASE WHEN cum_cents >= {cac_cents} * cohort_size THEN month_index END) AS payback_month_index,
       min(CASE WHEN cum_cents >= {cac_cents} * cohort_size THEN month_index END) IS NOT NULL AS cac_reached
FROM ltv GROUP BY cohort_ord, cohort_size""", _LTV_CELLS)
    q["cac_target_line"] = _q(f"SELECT DISTINCT month_index, CAST({CAC_TEST} AS DOUBLE) AS cac_target FROM cells")
    # purchases
    q["purchase_intervals"] = _q(
        "SELECT order_id, customer_id, order_date, order_value, prev_order_date, days_between FROM intervals",
        _INTERVALS, cohort=False)
    q["repeat_intervals"] = repeat_intervals()
    q["repeat_intervals_segment"] = repeat_intervals(scoped=True)
    q["mean_interval"] = _q(f"""
SELECT n_intervals, CAST({_half_up('gap_days * 10', 'n_intervals')} AS DOUBLE) / 10 AS mean_days_between
FROM (SELECT count(gap) AS n_intervals, CAST(sum(gap) AS BIGINT) AS gap_days FROM gaps) t
WHERE n_intervals > 0""", _purchase_gaps("(SELECT * FROM orders_v WHERE customer_id IS NOT NULL)"), cohort=False)
    q["interval_histogram"] = _q("""
SELECT CAST(floor(days_between / w) * w AS BIGINT) AS bin_start, CAST(w AS BIGINT) AS bin_width, count(*) AS n_intervals
FROM intervals, (
  SELECT min(w) AS w FROM (VALUES """ + _ROUND_WIDTHS + """) widths(w),
       (SELECT min(days_between) AS lo, max(days_between) AS hi FROM intervals) b
  WHERE floor(hi / w) - floor(lo / w) + 1 <= 50
) bw
GROUP BY 1, 2""", _INTERVALS, cohort=False)
    q["purchase_sequence"] = _q("""
SELECT order_id, customer_id, order_date, order_value,
       CAST(dense_rank() OVER (PARTITION BY customer_id ORDER BY order_date ASC NULLS FIRST, order_id ASC NULLS FIRST) AS INTEGER) AS purchase_sequence
FROM orders_v""", cohort=False)
    q["dense_rank_orders"] = _q(f"""
SELECT purchase_sequence, count(order_id) AS total_orders,
       CAST({_half_up('CAST(sum(cents) AS BIGINT)', 'count(cents)')} AS DOUBLE) / 100 AS average_order_value_inr
FROM (
  SELECT order_id, cents,
         CAST(dense_rank() OVER (PARTITION BY customer_id ORDER BY order_date ASC NULLS FIRST, order_id ASC NULLS FIRST) AS INTEGER) AS purchase_sequence
  FROM orders_v
) r WHERE purchase_sequence <= 5 GROUP BY purchase_sequence""", cohort=False)
    # sales
    q["kpi_summary"] = kpi_summary()
    q["kpi_summary_segment"] = kpi_summary(scoped=True)
    q["kpi_summary_dense_ids"] = kpi_summary()
    q["kpi_by_segment"] = q["kpi_by_segment_dense_ids"] = kpi_by_segment()
    q["monthly_sales_by_segment"] = _q(f"""
SELECT grouping(c.segment) = 1 AS all_segments, c.segment, {_label(_month_ord('order_date'))} AS order_month,
       CAST(CAST(sum(cents) AS BIGINT) AS DOUBLE) / 100 AS sales
FROM orders_v JOIN customers_v c USING (customer_id) WHERE order_date IS NOT NULL
GROUP BY GROUPING SETS ((c.segment, {_month_ord('order_date')}), ({_month_ord('order_date')}))""", cohort=False)
    q["category_sales_by_segment"] = _q("""
SELECT all_segments, segment, category, CAST(cents AS DOUBLE) / 100 AS sales,
       CAST(cents AS DOUBLE) / CAST(sum(cents) OVER (PARTITION BY all_segments, segment) AS DOUBLE) AS sales_share
FROM (
  SELECT grouping(c.segment) = 1 AS all_segments, c.segment, p.category,
         CAST(sum(CAST(round(f.order_value * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM facts f JOIN products_v p USING (product_id) JOIN customers_v c ON c.customer_id = f.customer_id
  GROUP BY GROUPING SETS ((c.segment, p.category), (p.category)))""", _FACTS, cohort=False)
    q["monthly_sales"] = _q(f"""
SELECT {_label(_month_ord('order_date'))} AS order_month, CAST(CAST(sum(cents) AS BIGINT) AS DOUBLE) / 100 AS sales
FROM orders_v WHERE order_date IS NOT NULL GROUP BY {_month_ord('order_date')}""", cohort=False)
    q["category_sales"] = _q("""
SELECT category, CAST(cents AS DOUBLE) / 100 AS sales, CAST(cents AS DOUBLE) / (SELECT sum(cents) FROM per_cat) AS sales_share
FROM per_cat""", """
per_cat AS (
  SELECT p.category, CAST(sum(l.cents) AS BIGINT) AS cents
  FROM lines_v l JOIN products_v p ON p.product_id = l.product_id
  WHERE l.product_id IS NOT NULL GROUP BY p.category
)""", cohort=False)
    q["adhoc_sql"] = _q("""
SELECT c.segment, p.category, count(*) AS order_lines, CAST(sum(f.quantity) AS BIGINT) AS items,
       max(f.order_date) AS last_day, count(DISTINCT f.customer_id) AS buyers
FROM facts f, products_v p, customers_v c
WHERE f.product_id = p.product_id AND f.customer_id = c.customer_id AND f.quantity >= 10
GROUP BY ALL""", _FACTS, cohort=False)
    return q
