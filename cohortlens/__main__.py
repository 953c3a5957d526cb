"""Command line: dashboard, named queries, ad hoc SQL, export and key checks over a star schema.

    python -m cohortlens dashboard --format parquet --customers C --products P --orders O \\
        [--segment Retail] [--cac 1000] --out DIR
    python -m cohortlens query retention_matrix --format csv ... --out DIR
    python -m cohortlens sql "SELECT ... FROM orders" --format parquet ... --out DIR
    python -m cohortlens export --format sql_dump --customers F --products F --orders F [--segment S] --out DIR
    python -m cohortlens check --format jdbc --url jdbc:... --property user=u \\
        --partition orders=order_id:1:1000000000:400 --customers T --products T --orders T --out DIR

``check`` writes repeated primary keys and orphan foreign keys. Each result is written by the executors as a folder of CSV part files with a
header under ``--out``. Intermediate tables go to ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cohortlens.operators import quality
from cohortlens.plans import catalog
from cohortlens.plans.dashboard import dashboard
from cohortlens.plans.materialize import release
from cohortlens.sources.readers import load_star_schema
from cohortlens.sources.schema import CAC_TARGET, PRIMARY_KEYS
from cohortlens.sources.sinks import export_star_schema


def _write(df, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cohortlens")
    ap.add_argument("command", choices=["dashboard", "query", "sql", "export", "check"])
    ap.add_argument("arg", nargs="?", help="query name (query) or SQL text (sql)")
    ap.add_argument("--format", choices=["parquet", "csv", "sql_dump", "jdbc"], default="parquet")
    ap.add_argument("--customers", required=True)
    ap.add_argument("--products", required=True)
    ap.add_argument("--orders", required=True)
    ap.add_argument("--segment", default=None)
    ap.add_argument("--cac", type=float, default=CAC_TARGET)
    ap.add_argument("--url", help="JDBC url")
    ap.add_argument("--property", action="append", default=[], metavar="KEY=VALUE", help="JDBC property")
    ap.add_argument("--partition", action="append", default=[], metavar="TABLE=COLUMN:LOWER:UPPER:N", help="parallel JDBC read")
    ap.add_argument("--out", required=True)
    a = ap.parse_args(argv)

    spark = spark or SparkSession.builder.appName("cohortlens").getOrCreate()
    paths = {"customers": a.customers, "products": a.products, "orders": a.orders}
    properties = dict(p.split("=", 1) for p in a.property)
    partitioning = {}
    for p in a.partition:
        table, spec = p.split("=", 1)
        column, lower, upper, n = spec.split(":")
        partitioning[table] = (column, int(lower), int(upper), int(n))
    customers, products, orders = load_star_schema(spark, a.format, paths, a.url, properties, partitioning)
    out = a.out.rstrip("/")
    try:
        if a.command == "dashboard":
            for name, df in dashboard(customers, products, orders, a.segment, cac=a.cac).items():
                _write(df, f"{out}/{name}")
        elif a.command == "query":
            _write(catalog.run_named(a.arg, customers, products, orders), f"{out}/{a.arg}")
        elif a.command == "export":
            export_star_schema(customers, products, orders, out, a.segment)
        elif a.command == "check":
            for table, df in (("customers", customers), ("products", products), ("orders", orders)):
                _write(quality.pk_violations(df, PRIMARY_KEYS[table]), f"{out}/repeated_{table}")
            _write(quality.fk_violations(orders, customers, products), f"{out}/orphans")
        else:
            _write(catalog.adhoc_sql(spark, a.arg, customers, products, orders), f"{out}/sql")
    finally:
        release(spark)


if __name__ == "__main__":
    main()
