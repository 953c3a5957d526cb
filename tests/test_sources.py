from __future__ import annotations

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest

from cohortlens.plans import catalog
from cohortlens.sources import readers, sinks, testdata
from cohortlens.sources.schema import CUSTOMERS, ORDERS, PRODUCTS
from cohortlens.sources.sql_dump import read_sql_dump
from tests.conftest import customers_df, orders_df, products_df, rows

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_with_quotes(spark):
    out = tempfile.mkdtemp(prefix="csv-rt-")
    c = customers_df(spark, [(1, "2024-01-03", "Retail", 'O\'Neil, "A"'), (2, None, "x; y", "plain")])
    p = products_df(spark, [(1, "Menswear")])
    o = orders_df(spark, [(10, 1, "2024-01-05", "12.50", 3, 1), (11, 2, None, None, 1, 1)])
    paths = sinks.export_star_schema(c, p, o, out)
    back_c = readers.read_csv(spark, paths["customers"], "customers")
    back_o = readers.read_csv(spark, paths["orders"], "orders")
    back_p = readers.read_csv(spark, paths["products"], "products")
    assert rows(back_c) == rows(c)
    assert rows(back_o) == rows(o)
    assert rows(back_p) == rows(p)
    assert back_c.schema == CUSTOMERS and back_o.schema == ORDERS and back_p.schema == PRODUCTS


def test_csv_partitioned_by_month(spark):
    out = tempfile.mkdtemp(prefix="csv-part-")
    o = orders_df(spark, [(10, 1, "2024-01-05", 1), (11, 1, "2024-02-05", 2)])
    sinks.write_csv(o, f"{out}/fact", "orders", partition_by_month=True)
    assert sorted(x for x in os.listdir(f"{out}/fact") if x.startswith("order_month=")) == [
        "order_month=2024-01",
        "order_month=2024-02",
    ]


def _dump(text: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="dump-"), "seed.sql")
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def test_sql_dump_ingest(spark):
    path = _dump(
        "CREATE TABLE customers (\n    customer_id INT PRIMARY KEY\n);\n\n"
        "INSERT INTO products VALUES\n(7, 'Cap (Wool)', 'Hats', 12.5);\n\n"
        "INSERT INTO customers VALUES\n"
        "(31, 'O''Neil, \"A\"', '2023-06-11', 'Retail'),\n"
        "(32, 'x; y', '2023-07-18', NULL),\n"
        "(33, 'Plain', NULL, 'Direct');\n\n"
        "INSERT INTO orders VALUES\n(900, 31, 7, '2023-06-12', 2, 25.0);\n"
    )
    assert rows(read_sql_dump(spark, path, "customers")) == [
        (31, 'O\'Neil, "A"', dt.date(2023, 6, 11), "Retail"),
        (32, "x; y", dt.date(2023, 7, 18), None),
        (33, "Plain", None, "Direct"),
    ]
    assert rows(read_sql_dump(spark, path, "products")) == [(7, "Cap (Wool)", "Hats", Decimal("12.50"))]
    assert rows(read_sql_dump(spark, path, "orders")) == [(900, 31, 7, dt.date(2023, 6, 12), 2, Decimal("25.00"))]


def _names(spark, text):
    return [r[1] for r in rows(read_sql_dump(spark, _dump(text), "products"))]


def test_sql_dump_statement_forms(spark):
    row = "'Hats', 1.0)"
    # a comment in front of the statement, and inside it
    assert _names(spark, f"-- seed; 'quoted\n/* two; */ # three\nINSERT INTO products VALUES (1, 'a', {row}, /* x */ (2, 'b', {row};") == ["a", "b"]
    # schema-qualified and quoted names, lower case, INSERT IGNORE
    assert _names(spark, f"insert ignore into `shop`.`products` values (1, 'a', {row}; INSERT INTO shop.products VALUES (2, 'b', {row};") == ["a", "b"]
    # backslash escapes
    assert _names(spark, rf"INSERT INTO products VALUES (1, 'O\'N\\', {row}, (2, 'a\nb\"c\\\'', {row};") == ["O'N\\", 'a\nb"c\\\'']
    # a semicolon and a line end inside a value
    assert _names(spark, f"INSERT INTO products VALUES (1, 'a;\nINSERT INTO products VALUES', {row}, (2, 'b', {row};\n") == ["a;\nINSERT INTO products VALUES", "b"]
    # two statements on a line, CRLF line ends, CREATE TABLE in front, another table with rows of the same types
    text = f"CREATE TABLE products (\r\n x INT);\r\nINSERT INTO products VALUES\r\n(1, 'a', {row};INSERT INTO other VALUES (9, 'z', {row};\r\nINSERT INTO products VALUES (2, 'b', {row};\r\n"
    assert _names(spark, text) == ["a", "b"]
    # a column list in another order, and with a column left out
    text = "INSERT INTO products (category, `price`, product_id, product_name) VALUES ('Hats', 3.5, 1, 'a');INSERT INTO products (product_id, product_name) VALUES (2, 'b')"
    assert rows(read_sql_dump(spark, _dump(text), "products")) == [(1, "a", "Hats", Decimal("3.50")), (2, "b", None, None)]
    # a very long value, and no statement at all
    long = "x(y'';" * 20_000
    assert _names(spark, f"INSERT INTO products VALUES (1, '{long}', {row};") == [long.replace("''", "'")]
    assert _names(spark, "-- nothing here\n") == []


def test_sql_dump_drops_nothing_in_silence(spark):
    for text, message in (
        ("INSERT INTO products VALUES (1, 'a', 'Hats', 1.0), oops (2, 'b', 'Hats', 1.0);", "not a list of rows"),
        ("INSERT INTO products SELECT * FROM other;", "not a list of rows"),
        ("INSERT INTO products VALUES (1, 'a', 'Hats');", "another number of fields"),
        ("INSERT INTO products (product_id) VALUES (1, 'a');", "another number of fields"),
    ):
        with pytest.raises(Exception, match=message):
            read_sql_dump(spark, _dump(text), "products").collect()


def test_csv_columns_are_matched_by_name(spark):
    out = tempfile.mkdtemp(prefix="csv-order-")
    with open(f"{out}/p.csv", "w") as f:
        f.write("product_id,category,extra,product_name,price\n1,Hats,9,Cap,2.50\n")
    assert rows(readers.read_csv(spark, f"{out}/p.csv", "products")) == [(1, "Cap", "Hats", Decimal("2.50"))]
    with open(f"{out}/bad.csv", "w") as f:
        f.write("product_id,category,price\n1,Hats,2.50\n")
    with pytest.raises(Exception, match="product_name"):
        readers.read_csv(spark, f"{out}/bad.csv", "products")
    with open(f"{out}/short.csv", "w") as f:
        f.write("product_id,product_name,category,price\n1,Cap\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, f"{out}/short.csv", "products").collect()


def test_every_export_reads_back(spark):
    out = tempfile.mkdtemp(prefix="csv-all-")
    o = orders_df(spark, [(10, 1, "2024-01-05", 1), (11, 1, "2024-02-05", 2), (12, None, None, None)])
    for i, options in enumerate(({}, {"with_order_month": True}, {"partition_by_month": True})):
        sinks.write_csv(o, f"{out}/{i}", "orders", **options)
        assert rows(readers.read_csv(spark, f"{out}/{i}", "orders"), *o.columns) == rows(o)
    c = customers_df(spark, [(1, "2024-01-03", "Retail", 'two\nlines, "quoted"')])
    with pytest.raises(Exception, match="line break"):
        sinks.write_csv(c, f"{out}/c", "customers")
    sinks.write_csv(c, f"{out}/c2", "customers", multiline=True)
    assert rows(readers.read_csv(spark, f"{out}/c2", "customers", multiline=True)) == rows(c)


def test_adhoc_sql_leaves_the_users_views(spark):
    c, p, o = customers_df(spark, [(1, "2024-01-03")]), products_df(spark, [(1, "Hats")]), orders_df(spark, [(10, 1, "2024-01-05", 5)])
    spark.range(3).createOrReplaceTempView("orders")
    try:
        res = catalog.adhoc_sql(spark, "SELECT max(month_index) AS m, (SELECT count(*) FROM orders) AS n FROM cohort_ltv", c, p, o)
        assert tuple(res.first()) == (0, 1)
        assert spark.table("orders").count() == 3
        assert not spark.catalog.tableExists("cohort_ltv") and not spark.catalog.tableExists("products")
    finally:
        spark.catalog.dropTempView("orders")


def test_load_star_schema_from_a_dump(spark):
    from cohortlens.sources.readers import load_star_schema

    path = _dump("INSERT INTO customers VALUES (1, 'a', '2024-01-03', 'Retail'); INSERT INTO products VALUES (2, 'Cap', 'Hats', 1); INSERT INTO orders VALUES (3, 1, 2, '2024-01-05', 1, 4.5);")
    c, p, o = load_star_schema(spark, "sql_dump", dict.fromkeys(("customers", "products", "orders"), path))
    assert rows(c) == [(1, "a", dt.date(2024, 1, 3), "Retail")] and rows(p) == [(2, "Cap", "Hats", Decimal("1.00"))]
    assert rows(o) == [(3, 1, 2, dt.date(2024, 1, 5), 1, Decimal("4.50"))]


def test_parquet_reader_projects_schema(spark):
    out = tempfile.mkdtemp(prefix="pq-")
    o = orders_df(spark, [(10, 1, "2024-01-05", 1)])
    o.withColumn("extra", o.order_id).write.mode("overwrite").parquet(out)
    back = readers.read_parquet(spark, out, "orders")
    assert back.schema == ORDERS


def test_testdata_adapter_shapes(spark):
    c = testdata.customers(spark, SF)
    o = testdata.orders(spark, SF)
    assert c.columns == ["customer_id", "customer_name", "signup_date", "segment"]
    assert o.columns == ["order_id", "customer_id", "order_date", "order_value"]
    assert dict(o.dtypes)["order_date"] == "date"


def test_named_query_lookup_and_adhoc_sql(spark):
    c = customers_df(spark, [(1, "2024-01-03")])
    p = products_df(spark, [(1, "Menswear")])
    o = orders_df(spark, [(10, 1, "2024-01-05", 5), (11, 1, "2024-02-05", 5)])
    assert rows(catalog.run_named("repeat_intervals", c, p, o)) == [(1, 1, 31.0)]
    try:
        catalog.named_query("nope")
    except KeyError as e:
        assert "retention_matrix" in str(e)
    else:
        raise AssertionError("expected KeyError")
    res = catalog.adhoc_sql(spark, "SELECT count(*) AS n FROM orders", c, p, o)
    assert res.first()["n"] == 2
    for name in catalog.NAMED_QUERIES:
        sql_rows = catalog.adhoc_sql(spark, catalog.preset_sql(name), c, p, o).count()
        assert sql_rows == catalog.run_named(name, c, p, o).count()


def test_load_star_schema_parquet_and_csv(spark):
    from cohortlens.sources.readers import load_star_schema

    out = tempfile.mkdtemp(prefix="star-")
    c = customers_df(spark, [(1, "2024-01-03")])
    p = products_df(spark, [(1, "Menswear")])
    o = orders_df(spark, [(10, 1, "2024-01-05", "3.10", 2, 1)])
    for name, df in (("customers", c), ("products", p), ("orders", o)):
        df.write.mode("overwrite").parquet(f"{out}/pq/{name}")
    paths = {t: f"{out}/pq/{t}" for t in ("customers", "products", "orders")}
    lc, lp, lo = load_star_schema(spark, "parquet", paths)
    assert (rows(lc), rows(lp), rows(lo)) == (rows(c), rows(p), rows(o))
    csv = sinks.export_star_schema(c, p, o, f"{out}/csv")
    cc, cp, co = load_star_schema(spark, "csv", csv)
    assert (rows(cc), rows(cp), rows(co)) == (rows(c), rows(p), rows(o))


def test_export_for_one_segment(spark):
    out = tempfile.mkdtemp(prefix="csv-seg-")
    c = customers_df(spark, [(1, "2024-01-03", "Retail"), (2, "2024-01-04", "Corporate")])
    p = products_df(spark, [(1, "Menswear"), (2, "Footwear")])
    o = orders_df(spark, [(10, 1, "2024-01-05", 1, 1, 1), (11, 2, "2024-01-06", 2, 1, 2)])
    paths = sinks.export_star_schema(c, p, o, out, segment="Corporate")
    assert [r.customer_id for r in readers.read_csv(spark, paths["customers"], "customers").collect()] == [2]
    assert [r.order_id for r in readers.read_csv(spark, paths["orders"], "orders").collect()] == [11]
    assert readers.read_csv(spark, paths["products"], "products").count() == 2


def test_named_analyses_produce_the_fixed_columns(spark):
    from cohortlens.sources.schema import NAMED_RESULT_COLUMNS

    c = customers_df(spark, [(1, "2024-01-03")])
    p = products_df(spark, [(1, "Menswear")])
    o = orders_df(spark, [(10, 1, "2024-01-05", 5), (11, 1, "2024-02-05", 5)])
    for name, cols in NAMED_RESULT_COLUMNS.items():
        assert catalog.run_named(name, c, p, o).columns == cols, name
        assert catalog.adhoc_sql(spark, catalog.preset_sql(name), c, p, o).columns == cols, name


def test_jdbc_argument_checks(spark):
    from cohortlens.sources.readers import load_star_schema, read_jdbc

    with pytest.raises(ValueError, match="bound"):
        read_jdbc(spark, "jdbc:none://x", "orders", "orders", partition_column="order_id")
    with pytest.raises(ValueError, match="url"):
        load_star_schema(spark, "jdbc", {"customers": "c", "products": "p", "orders": "o"})
    with pytest.raises(ValueError, match="partitioning"):
        load_star_schema(spark, "jdbc", {"customers": "c", "products": "p", "orders": "o"}, url="jdbc:none://x")
    with pytest.raises(ValueError, match="unknown format"):
        load_star_schema(spark, "xml", {"customers": "c", "products": "p", "orders": "o"})


def test_rows_laid_out_by_month_are_computed_once(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    o = orders_df(spark, [(i, 1, f"2024-{1 + i % 12:02d}-05", i) for i in range(240)])
    counted = o.mapInArrow(count, o.schema)
    sinks.write_csv(counted, str(tmp_path / "fact"), "orders", partition_by_month=True, rows_per_file=50)
    assert computed.value == 240
    assert rows(readers.read_csv(spark, str(tmp_path / "fact"), "orders")) == rows(o)


def test_partitions_of_the_facts_follow_the_lines(spark, monkeypatch):
    plain = rows(testdata.order_facts(spark, SF))
    monkeypatch.setattr(testdata, "LINES_PER_PARTITION", 500)
    facts = testdata.order_facts(spark, SF)
    lines = testdata.lineitem(spark, SF).count()
    written = facts._jdf.queryExecution().toString()
    assert "hashpartitioning(order_id#" in written and f", {-(-lines // 500)})" in written
    assert rows(facts) == plain
