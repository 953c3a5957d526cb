"""One seed script in many tasks: any cut of its text gives the same rows."""

from __future__ import annotations

import datetime as dt
import os
import random
import tempfile

import pytest

from cohortlens.sources import sql_dump
from cohortlens.sources.sql_dump import Statement, dump_rows, read_sql_dump, scan
from tests.conftest import rows

HARD = ["'", "''", ";", ")", "(", ",", "\n", "\r\n", "\\", "/*", "*/", "--", "#", '"', "`", "é", "VALUES", "INSERT INTO customers VALUES (1,", " ", "x"]


def _literal(r: random.Random, value: str) -> str:
    out = value.replace("\\", "\\\\")
    out = out.replace("'", "''") if r.random() < 0.5 else out.replace("'", "\\'")
    return f"'{out}'"


def random_dump(seed: int) -> tuple[str, list[tuple]]:
    """A script with hard values, comments and statements of other tables, and the customers in it."""
    r = random.Random(seed)
    out, want, n = [], [], 0
    value = lambda: "".join(r.choice(HARD) for _ in range(r.randint(0, 12)))
    gap = lambda: r.choice(["", " ", "\n", "\r\n", "/* a); ' \" ` */", "-- it's; (\n", "# `x\n", "/*\n*/\n"])
    for _ in range(r.randint(1, 25)):
        kind = r.random()
        if kind < 0.25:
            out.append(f"CREATE TABLE customers (a INT, b VARCHAR(9) DEFAULT {_literal(r, value())}){gap()};")
        elif kind < 0.4:
            out.append(f"INSERT INTO orders VALUES (1, {_literal(r, value())}),{gap()}(2, 3);")
        else:
            listed = r.random() < 0.4
            head = r.choice(["INSERT INTO customers", "insert ignore into `shop`.`customers`", "INSERT  INTO\n\"customers\""])
            tuples = []
            for _ in range(r.choice([0, 1, 2, 30]) if not listed else r.randint(1, 4)):
                n += 1
                name, segment = value(), value()
                want.append((n, name, dt.date(2024, 1, 1 + n % 28), segment if not listed else None))
                day = f"'2024-01-{1 + n % 28:02d}'"
                fields = [day, str(n), _literal(r, name)] if listed else [str(n), _literal(r, name), day, _literal(r, segment)]
                tuples.append(f"({', '.join(fields)})")
            columns = f"{gap()}(signup_date, `customer_id`, customer_name)" if listed else ""
            out.append(f"{head}{columns}{gap() or ' '}VALUES{gap()}" + f"{gap()},{gap()}".join(tuples) + gap() + ";")
        out.append(gap())
    return "".join(out), want


def _write(text: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="dump-"), "seed.sql")
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


@pytest.fixture
def split_bytes(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(n: int) -> None:
        for k in old:
            spark.conf.set(k, str(n))

    yield set_to
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(6))
def test_any_split_size_gives_the_same_rows(spark, split_bytes, seed):
    text, want = random_dump(seed)
    path = _write(text)
    for size in (40, 333, 1 << 20):
        split_bytes(size)
        assert rows(read_sql_dump(spark, path, "customers")) == sorted(want), size


def test_one_statement_over_many_tasks(spark, split_bytes):
    n = 5_000
    path = _write("INSERT INTO customers VALUES\n" + ",\n".join(f"({i}, 'it''s; ({i}', '2024-01-02', 'Retail')" for i in range(n)) + ";\n")
    split_bytes(8_192)
    got = dump_rows(spark, path, "customers")
    per_task = [r["count"] for r in got.groupBy(sql_dump.F.spark_partition_id()).count().collect()]
    assert len(per_task) > 20 and sum(per_task) == n and max(per_task) < n / 10
    assert read_sql_dump(spark, path, "customers").where("customer_name = concat(\"it's; (\", customer_id)").count() == n


def test_several_files_and_empty_ones(spark, split_bytes):
    folder = tempfile.mkdtemp(prefix="dump-")
    want = []
    for i in range(4):
        text, found = random_dump(50 + i)
        with open(f"{folder}/{i}.sql", "w", newline="") as f:
            f.write(text)
        want += found
    open(f"{folder}/none.sql", "w").close()
    split_bytes(200)
    assert rows(read_sql_dump(spark, folder, "customers")) == sorted(want)


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("INSERT INTO customers VALUES (1, 'a", "ends inside"),
        ("/* INSERT INTO customers VALUES (1, 'a', NULL, 'x');", "ends inside"),
        ("INSERT INTO customers (customer_id)", "not a list of rows"),
        ("INSERT INTO customers VALUES (1, 'a', NULL, 'x') ON DUPLICATE KEY UPDATE segment = 'y';", "not a list of rows"),
        ("INSERT INTO customers VALUES (1, concat('a', 'b'), NULL, 'x');", "not a list of rows"),
    ],
)
def test_broken_scripts_fail_at_any_split_size(spark, split_bytes, text, message):
    for size in (16, 1 << 20):
        split_bytes(size)
        with pytest.raises(Exception, match=message):
            read_sql_dump(spark, _write("-- c\n" * 20 + text.replace(" ", "\n")), "customers").collect()


def test_transition_tables_compose():
    r = random.Random(3)
    for _ in range(300):
        lines = ["".join(r.choice(HARD) for _ in range(r.randint(0, 6))).replace("\n", "") + "\n" for _ in range(6)]
        for state in range(5):
            now = state
            for line in lines:
                now = scan(line, now)[1]
            assert now == scan("".join(lines), state)[1]


def test_statement_phases():
    s = Statement("customers")
    assert s.feed("CREATE TABLE customers (a INT)") is None and s.phase == "other"
    assert s.feed(";") is None and s.phase == "head"
    assert s.feed("\nINSERT INTO customers (customer_id, segment)") is None and s.phase == "head"
    assert s.feed(" VALUES (1, 'x')") == "(1, 'x')" and s.text == "(customer_id, segment)"
    assert s.feed(", /* ) */ (2, 'y)')") == "(2, 'y)')" and s.feed(" ;") is None and s.phase == "head"
