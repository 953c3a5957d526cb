"""Star-schema CSV export (K4), written by the executors in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.calendar import month_label, month_ordinal
from cohortlens.plans.materialize import materialize
from cohortlens.sources.schema import SCHEMAS


#: About 100 MB of the fact table's CSV.
ROWS_PER_FILE = 2_000_000


def export_rows(df: DataFrame, table: str, with_order_month: bool = False) -> DataFrame:
    """Rows to export for ``table``: the documented columns present in ``df``, in schema order.

    ``with_order_month`` adds ``order_month`` (``yyyy-MM``) to the fact table.
    """
    names = [f.name for f in SCHEMAS[table].fields if f.name in df.columns]
    out = df.select(*names)
    if with_order_month and table == "orders":
        out = out.withColumn("order_month", F.when(F.col("order_date").isNotNull(), month_label(month_ordinal("order_date"))))
    return out


def _single_line(name: str) -> Column:
    broken = F.raise_error(F.lit(f"line break in a value of {name}; write with multiline=True"))
    return F.when(F.col(name).rlike("[\\r\\n]"), broken.cast("string")).otherwise(F.col(name))


def _by_month(rows: DataFrame, rows_per_file: int) -> DataFrame:
    """``rows`` in ranges of (order_month, order_id); the input's partition splits what copies of one order would keep together.

    They are computed once and stored: the tasks that deal the ranges then hold a file split each, not a partition of whatever made the rows.
    """
    if rows_per_file < 1:
        raise ValueError("rows_per_file must be positive")
    rows = materialize(rows.withColumn("_source", F.spark_partition_id()), "export")
    ranges = max(1, -(-rows.count() // rows_per_file))
    keys = ["order_month"] + ["order_id"] * ("order_id" in rows.columns)
    return rows.repartitionByRange(ranges, *keys, "_source").sortWithinPartitions(*keys).drop("_source")


def write_csv(
    df: DataFrame,
    path: str,
    table: str,
    with_order_month: bool = False,
    partition_by_month: bool = False,
    multiline: bool = False,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Write ``df`` as a directory of CSV part files with a header row.

    A quote inside a quoted value is doubled, as common CSV writers do; read back with :func:`cohortlens.sources.readers.read_csv`.
    ``partition_by_month`` lays the fact out as ``order_month=yyyy-MM/``
    folders, so later month filters prune files; rows are dealt by ranges of
    (month, order id) of about ``rows_per_file`` rows each, so that a month has
    about its rows / ``rows_per_file`` files and at most two more, however many tasks
    write, and each file holds a range of order ids. No file has more than twice
    that many rows. The rows are stored in the shared folder meanwhile (see
    :func:`cohortlens.plans.materialize.materialize`). Orders without a date go to a folder of their own. A line break in a value fails
    the write, since such a file can't be split on reading, unless
    ``multiline`` allows it; read it back with ``multiline`` then.
    """
    rows = export_rows(df, table, with_order_month or partition_by_month)
    if not multiline:
        rows = rows.withColumns({c: _single_line(c) for c, kind in rows.dtypes if kind == "string"})
    if partition_by_month:
        rows = _by_month(rows, rows_per_file)
    writer = (
        rows.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", False)
        .option("dateFormat", "yyyy-MM-dd")
        .option("maxRecordsPerFile", 2 * rows_per_file)
    )
    if partition_by_month:
        writer = writer.partitionBy("order_month")
    writer.csv(path)


def export_star_schema(
    customers: DataFrame,
    products: DataFrame,
    orders: DataFrame,
    out_dir: str,
    segment: str | None = None,
    **kw,
) -> dict[str, str]:
    """Write ``dim_customers``, ``dim_products`` and ``fact_orders`` under ``out_dir``.

    With ``segment``, customers and their orders are narrowed to that segment
    first (products are never filtered). ``kw`` goes to :func:`write_csv` for
    the fact table (``with_order_month``, ``partition_by_month``).
    """
    from cohortlens.operators.scope import segment_scope

    customers, orders = segment_scope(customers, orders, segment)
    paths = {
        "customers": f"{out_dir.rstrip('/')}/dim_customers",
        "products": f"{out_dir.rstrip('/')}/dim_products",
        "orders": f"{out_dir.rstrip('/')}/fact_orders",
    }
    write_csv(customers, paths["customers"], "customers")
    write_csv(products, paths["products"], "products")
    write_csv(orders, paths["orders"], "orders", **kw)
    return paths


__all__ = ["export_rows", "export_star_schema", "write_csv"]
