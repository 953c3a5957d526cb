"""Named queries (X1), lookup by name (X3) and ad hoc SQL.

The four named analyses are DataFrame functions. Ad hoc SQL runs through
``spark.sql`` over the tables ``customers``, ``products``, ``orders`` of the
frames passed in (unscoped unless the caller scopes them) and over the named
analyses, each a view made from its operator, so that ``SELECT * FROM
cohort_ltv ORDER BY ...`` gives what the operator gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import ltv, purchases, retention

Frames = tuple[DataFrame, DataFrame, DataFrame]  # customers, products, orders

NAMED_QUERIES: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "retention_matrix": lambda c, p, o: retention.retention_matrix(c, o),
    "cohort_ltv": lambda c, p, o: ltv.cohort_ltv(c, o),
    "repeat_intervals": lambda c, p, o: purchases.repeat_intervals(o),
    "dense_rank_orders": lambda c, p, o: purchases.dense_rank_orders(o),
}


def named_query(name: str) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """The named analysis ``name``; ``KeyError`` lists the known names."""
    try:
        return NAMED_QUERIES[name]
    except KeyError:
        raise KeyError(f"unknown query {name!r}; known: {sorted(NAMED_QUERIES)}") from None


# Presentation order of each named analysis.
NAMED_ORDER: dict[str, list[str]] = {
    "retention_matrix": ["cohort_month", "month_index"],
    "cohort_ltv": ["cohort_month", "month_index"],
    "repeat_intervals": ["total_repeat_orders DESC", "customer_id ASC NULLS FIRST"],
    "dense_rank_orders": ["purchase_sequence"],
}


def run_named(name: str, customers: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """The named analysis, sorted for presentation (results are tiny)."""
    return named_query(name)(customers, products, orders).orderBy(*map(_sort, NAMED_ORDER[name]))


def _sort(spec: str) -> Column:
    name, *rest = spec.split()
    return F.desc(name) if rest[:1] == ["DESC"] else F.asc_nulls_first(name)


@contextmanager
def views(spark: SparkSession, customers: DataFrame, products: DataFrame, orders: DataFrame) -> Iterator[None]:
    """Temp views of the three tables and the named analyses, for the time of the block.

    A user's own temp view of the same name is put back afterwards. A result
    of ``spark.sql`` keeps the tables it was analysed with, so that it may be
    used after the block.
    """
    frames = {"customers": customers, "products": products, "orders": orders}
    frames |= {name: query(customers, products, orders) for name, query in NAMED_QUERIES.items()}
    temporary = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in frames if name in temporary}
    try:
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name in frames:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def adhoc_sql(
    spark: SparkSession, text: str, customers: DataFrame, products: DataFrame, orders: DataFrame
) -> DataFrame:
    """Run any Spark SQL ``text`` over the three tables and the named analyses; returns the lazy result."""
    with views(spark, customers, products, orders):
        return spark.sql(text)


def adhoc_sql_counted(
    spark: SparkSession, text: str, customers: DataFrame, products: DataFrame, orders: DataFrame
) -> tuple[DataFrame, Callable[[], int]]:
    """X2 with its row count in the same run: the lazy result, and a function that gives the number of its rows.

    The count is an observed metric of the result's first action that reads all
    rows (a write, ``collect``, ``toPandas``); the function waits for it, so call it afterwards. No second run of the statement.
    """
    seen = Observation()
    rows = adhoc_sql(spark, text, customers, products, orders).observe(seen, F.count(F.lit(1)).alias("n_rows"))
    return rows, lambda: seen.get["n_rows"]


def preset_sql(name: str) -> str:
    """Spark SQL of a named analysis over its view; ``KeyError`` lists the known names."""
    named_query(name)
    return f"SELECT * FROM {name} ORDER BY {', '.join(NAMED_ORDER[name])}"
