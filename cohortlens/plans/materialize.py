"""Write an intermediate result once as a table in the shared checkpoint folder."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlens.session import checkpoint_dir

_WRITTEN = "_cohortlens_written"  # a list of paths on the session object itself
_lock = threading.Lock()


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, which :func:`release` deletes with whatever is written there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    with _lock:
        paths = getattr(spark, _WRITTEN, None)
        if paths is None:
            setattr(spark, _WRITTEN, paths := [])
        paths.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Compute ``df`` once, store it as Parquet in the shared folder, return a reader.

    Used where one result feeds several consumers (which would otherwise
    each recompute it) or where consumers must see the very same rows. The
    lineage is cut: a lost executor costs a re-read, not a recomputation.
    The tables stay until :func:`release` (or the folder's own retention).
    """
    spark = df.sparkSession
    path = new_path(spark, tag)  # known before the write, so that a failed one is released too
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables :func:`materialize` wrote for ``spark``; returns how many.

    DataFrames that read those tables must not be used afterwards. Deletion
    goes through the Hadoop FileSystem of each path, so it works for any
    shared folder (HDFS, object stores, local). Needs a classic session
    (not Spark Connect).
    """
    with _lock:
        paths = list(getattr(spark, _WRITTEN, []))
        setattr(spark, _WRITTEN, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        jp = fs_path(p)
        jp.getFileSystem(conf).delete(jp, True)
    return len(paths)
