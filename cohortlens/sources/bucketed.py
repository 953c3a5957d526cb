"""Star-schema tables bucketed by customer, so that per-customer work reads the fact without moving it.

Every cohort, LTV and interval metric groups orders by customer and joins them to customers. Tables written once
with the same number of buckets on ``customer_id`` give Spark that partitioning at the scan: the operators are the same, their
plans lose the exchange of the fact. What is left to move are cohort cells.

A bucket is read by one task, so a customer with a third of all orders makes one long scan task (its rows are combined
there and go no further); tables with such customers are better left unbucketed, where the rows are combined before
they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.sources.sinks import export_rows

BUCKET_COLUMN = "customer_id"


def write_bucketed(df: DataFrame, table: str, name: str, buckets: int, path: str | None = None) -> None:
    """Save ``df`` (``customers`` or ``orders``) as catalog table ``name`` with ``buckets`` buckets on the customer.

    Rows are dealt to the buckets before the write, so that each bucket is one file, sorted by customer, whatever the
    number of writing tasks. Tables to be joined need equal ``buckets``; choose it so that a bucket suits a task. ``path`` puts an
    external table there; else the warehouse holds it.
    """
    if BUCKET_COLUMN not in df.columns or buckets < 1:
        raise ValueError(f"bucketed tables need a {BUCKET_COLUMN} and at least one bucket")
    rows = export_rows(df, table).repartition(buckets, BUCKET_COLUMN)
    writer = rows.write.format("parquet").mode("overwrite").bucketBy(buckets, BUCKET_COLUMN).sortBy(BUCKET_COLUMN)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    """The bucketed table ``name``; Spark knows its partitioning from the catalog."""
    return spark.table(name)
