"""Measure per-task balance of the main operators when one customer holds a third of all orders.

Builds two stand-in orders tables from the test tables and writes each as 16
Parquet files under the checkpoint folder: ``hot_customer`` (every third
order, by order id, moved to one customer) and ``hot_copies`` (every third
order replaced by a copy of one order row). Then runs the
operators with broadcast joins disabled (as for tables too large to
broadcast) and AQE on, and reads per-task record counts from Spark's event
log. For every stage with more than one task it reports
``max task records / mean task records``; 1.0 is perfectly even, and a plan
that sends the hot customer to one task shows about ``tasks / 3``.

Usage: ``python tools/skew_probe.py FOLDER [sf_dir]``; event logs and stand-in
tables go to FOLDER. A plain
``Window.partitionBy("customer_id")`` LAG is run as a contrast.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))


def _events(log_dir: str):
    import zstandard

    for f in sorted(glob.glob(f"{log_dir}/**/events_*", recursive=True) + glob.glob(f"{log_dir}/local-*")):
        with open(f, "rb") as fh:
            raw = fh.read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(raw).read()
        for line in raw.decode().splitlines():
            yield json.loads(line)


def main(argv: list[str]) -> None:
    folder, *rest = argv
    sf_dir = rest[0] if rest else "/root/testdata/sf0.1"
    log_dir = f"{folder.rstrip('/')}/events"
    os.makedirs(log_dir, exist_ok=True)
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cohortlens.operators import purchases, retention, ltv
    from cohortlens.plans.materialize import materialize
    from cohortlens.session import build_session
    from cohortlens.sources import testdata as td

    spark = build_session(
        "local[8]",
        shuffle_partitions=16,
        extra={
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": log_dir,
            "spark.checkpoint.dir": f"{folder.rstrip('/')}/tables",
            "spark.eventLog.compress": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            # keep every shuffle partition a task of its own, so balance is visible
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
    )
    customers = td.customers(spark, sf_dir)
    base = td.orders(spark, sf_dir)
    first = base.orderBy("order_id").first()
    third = F.col("order_id") % 3 == 0
    # Scenario 1: every third order moved to one customer.
    hot_customer = base.withColumn(
        "customer_id", F.when(third, F.lit(first["customer_id"])).otherwise(F.col("customer_id"))
    )
    # Scenario 2: every third order replaced by a copy of one order row.
    hot_copies = base.select(
        *[F.when(third, F.lit(first[c])).otherwise(F.col(c)).alias(c) for c in base.columns]
    )
    scenarios = {
        "hot_customer": materialize(hot_customer.repartition(16), "skewed-orders"),
        "hot_copies": materialize(hot_copies.repartition(16), "copied-orders"),
    }

    w = Window.partitionBy("customer_id").orderBy("order_date", "order_id")
    runs = {}
    for label, orders in scenarios.items():
        runs.update({
            f"{label}:retention_matrix": lambda o=orders: retention.retention_matrix(customers, o),
            f"{label}:cohort_ltv": lambda o=orders: ltv.cohort_ltv(customers, o),
            f"{label}:repeat_intervals": lambda o=orders: purchases.repeat_intervals(o),
            f"{label}:dense_rank_orders": lambda o=orders: purchases.dense_rank_orders(o),
            f"{label}:purchase_intervals": lambda o=orders: purchases.purchase_intervals(o),
            f"{label}:purchase_sequence": lambda o=orders: purchases.purchase_sequence(o),
            f"{label}:interval_histogram": lambda o=orders: purchases.interval_histogram(o),
            f"{label}:naive_window_lag": lambda o=orders: o.withColumn("prev", F.lag("order_date").over(w)),
        })
    groups = {}
    for name, build in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        groups[name] = round(time.perf_counter() - t0, 2)
    spark.stop()

    stage_group, stage_tasks = {}, {}
    for e in _events(log_dir):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for s in e["Stage IDs"]:
                stage_group[s] = g
        elif ev == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            m = e["Task Metrics"]
            recs = m.get("Input Metrics", {}).get("Records Read", 0) + m.get("Shuffle Read Metrics", {}).get(
                "Total Records Read", 0
            )
            stage_tasks.setdefault(e["Stage ID"], []).append(recs)
    if os.environ.get("SKEW_PROBE_VERBOSE"):
        for s, recs in sorted(stage_tasks.items()):
            if stage_group.get(s) in runs and len(recs) > 1:
                print("STAGE", stage_group[s], s, len(recs), sum(recs), max(recs))
    report = {}
    for s, recs in stage_tasks.items():
        g = stage_group.get(s)
        if g not in runs or len(recs) < 2 or sum(recs) < 100:
            continue
        ratio = max(recs) / (sum(recs) / len(recs))
        cur = report.get(g)
        if cur is None or ratio > cur["worst_max_over_mean"]:
            report[g] = {
                "worst_max_over_mean": round(ratio, 2),
                "tasks": len(recs),
                "max_task_share": round(max(recs) / sum(recs), 3),
                "stage_records": sum(recs),
            }
    for g in runs:
        print(json.dumps({"query": g, "sec": groups[g], **report.get(g, {})}))


if __name__ == "__main__":
    main(sys.argv[1:])
