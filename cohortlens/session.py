"""SparkSession construction with settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "cohortlens",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session for local runs and tests.

    On a cluster, create the session the usual way; the operators only need
    ``spark.sql.session.timeZone=UTC`` (dates are formatted from DATE values,
    so the zone matters only for timestamp inputs) and AQE, which is on by
    default in Spark 4.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir`` (or registers one with
    ``SparkContext.setCheckpointDir``). Where neither is set, a folder in the
    session's warehouse is used, which executors share too; never a
    machine-local temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
