"""Time the headline queries on K disjoint copies of the test tables (K = 1, 4, 16, ...).

Stand-in input only: for each K, ``orders`` and ``customer`` are replicated K
times with ids remapped to disjoint ranges (``id * K + copy``), so the data
grows K-fold without adding skew, and written as several Parquet files (so
scans run in parallel) under FOLDER. Every query runs once untimed
and once timed, with the ``noop`` sink. Usage:
``python tools/scale_probe.py FOLDER [sf_dir] [K ...]``.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))


def main(argv: list[str]) -> None:
    out, *rest = argv
    sf_dir = rest[0] if rest else "/root/testdata/sf0.1"
    factors = [int(x) for x in rest[1:]] or [1, 4, 16]
    from pyspark.sql import functions as F

    from cohortlens.operators import ltv, purchases, retention
    from cohortlens.plans.materialize import release
    from cohortlens.session import build_session
    from cohortlens.sources import testdata as td

    out = out.rstrip("/")
    spark = build_session("local[8]", shuffle_partitions=16, extra={"spark.checkpoint.dir": f"{out}/tables"})
    for k in factors:
        d = f"{out}/x{k}"
        copy = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("copy")
        o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("*", copy)
        o = o.withColumn("o_orderkey", F.col("o_orderkey") * k + F.col("copy")).withColumn(
            "o_custkey", F.col("o_custkey") * k + F.col("copy")
        ).drop("copy")
        c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("*", copy)
        c = c.withColumn("c_custkey", F.col("c_custkey") * k + F.col("copy")).drop("copy")
        files = max(8, 2 * k)
        o.repartition(files).write.parquet(f"{d}/orders.parquet")
        c.repartition(max(2, k)).write.parquet(f"{d}/customer.parquet")

        customers, orders = td.customers(spark, d), td.orders(spark, d)
        runs = {
            "retention_matrix": lambda: retention.retention_matrix(customers, orders),
            "cohort_ltv": lambda: ltv.cohort_ltv(customers, orders),
            "repeat_intervals": lambda: purchases.repeat_intervals(orders),
            "dense_rank_orders": lambda: purchases.dense_rank_orders(orders),
            "purchase_intervals": lambda: purchases.purchase_intervals(orders),
        }
        times = {}
        for name, build in runs.items():
            build().write.format("noop").mode("overwrite").save()
            release(spark)
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 2)
            release(spark)
        n = orders.count()
        print(json.dumps({"copies": k, "orders": n, "seconds": times, "total": round(sum(times.values()), 2)}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
