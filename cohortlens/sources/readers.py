"""Column-projected loads of the star schema from Parquet, CSV, INSERT dumps or JDBC.

Every reader applies the fixed schema of :mod:`cohortlens.sources.schema`,
normalises date columns with ``to_date`` and selects only the schema columns,
so Catalyst prunes the scan to them and pushes later filters into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlens.sources.schema import DATE_COLUMNS, SCHEMAS


def normalize(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` to the schema of ``table``: cast, date-normalise, order columns."""
    schema = SCHEMAS[table]
    dates = set(DATE_COLUMNS.get(table, []))
    cols = []
    for field in schema.fields:
        c = F.col(field.name)
        c = F.to_date(c) if field.name in dates else c.cast(field.dataType)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def read_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    return normalize(spark.read.parquet(path), table)


def read_csv(
    spark: SparkSession, path: str, table: str, multiline: bool = False, months: list[str] | None = None
) -> DataFrame:
    """CSV with a header row, ISO dates, RFC-4180 quoting (``""`` inside quotes).

    Columns are matched by their header names, in any order; further columns
    (such as an exported ``order_month``) are ignored, missing ones fail, and
    so does a part file whose header differs from the first one's. Malformed
    rows and values fail. ``multiline`` allows line breaks inside quoted
    values; a file is then read by one task. ``months`` (``yyyy-MM``) keeps
    the rows of an export with ``order_month``; of one laid out by month
    only these months' files are read.
    """

    def reader():
        return spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST").option("multiLine", multiline)

    names = reader().csv(path).columns  # Spark reads the first header only
    strings = StructType([StructField(n, StringType()) for n in names])
    rows = reader().schema(strings).option("enforceSchema", False).csv(path)
    if months is not None:
        rows = rows.where(F.col("order_month").isin(months))
    return normalize(rows, table)


def read_jdbc(
    spark: SparkSession,
    url: str,
    dbtable: str,
    table: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Parallel JDBC read of database table ``dbtable`` as star-schema ``table``.

    With ``partition_column`` (an integer key such as ``order_id``) and its
    bounds, Spark issues ``num_partitions`` range queries in parallel instead
    of one cursor; later filters and the column list are pushed to the
    database by the JDBC source.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partitioned JDBC reads need lower/upper bound and num_partitions")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(lower_bound))
            .option("upperBound", str(upper_bound))
            .option("numPartitions", str(num_partitions))
        )
    return normalize(reader.load(), table)


def load_star_schema(
    spark: SparkSession,
    fmt: str,
    paths: dict[str, str],
    url: str | None = None,
    properties: dict[str, str] | None = None,
    partitioning: dict[str, tuple[str, int, int, int]] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(customers, products, orders)`` from one format.

    ``paths`` maps each table to a file path (``parquet``, ``csv``,
    ``sql_dump``; one dump may hold all three) or a database table name
    (``jdbc``, with ``url`` and ``properties``). ``partitioning`` maps a table
    to ``(integer column, lower, upper, partitions)`` for a parallel JDBC
    read, e.g. ``{"orders": ("order_id", 1, 10**9, 400)}``; ``orders`` must be
    in it, since a fact table through one cursor is no bulk load. Dimensions
    without an entry are read by one cursor.
    """
    from cohortlens.sources.sql_dump import read_sql_dump

    if fmt == "jdbc":
        if url is None:
            raise ValueError("jdbc needs url")
        if "orders" not in (partitioning or {}):
            raise ValueError('jdbc needs partitioning for "orders": (integer column, lower, upper, partitions)')

    def load(table: str) -> DataFrame:
        if fmt == "jdbc":
            split = (partitioning or {}).get(table, (None, None, None, None))
            return read_jdbc(spark, url, paths[table], table, properties, *split)
        return files[fmt](spark, paths[table], table)

    files = {"parquet": read_parquet, "csv": read_csv, "sql_dump": read_sql_dump}
    if fmt != "jdbc" and fmt not in files:
        raise ValueError(f"unknown format {fmt!r}")
    return load("customers"), load("products"), load("orders")
