from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import half_up_div, money_cents, month_index, month_label, month_ordinal
from tests.conftest import d


@pytest.mark.parametrize(
    "event, start, expected",
    [
        ("2024-02-01", "2024-01-30", 1),  # first order in the month after signup
        ("2024-02-01", "2023-11-20", 3),  # year crossing
        ("2024-02-01", "2024-01-31", 1),  # calendar, not elapsed, months
        ("2024-02-25", "2024-03-10", -1),  # order before signup
        ("2024-01-31", "2024-01-01", 0),
    ],
)
def test_month_index(spark, event, start, expected):
    df = spark.createDataFrame([(d(event), d(start))], "e date, s date")
    assert df.select(month_index("e", "s")).first()[0] == expected


def test_month_label_roundtrip(spark):
    df = spark.createDataFrame([(d("2024-01-15"),), (d("1999-12-31"),), (d("0999-03-01"),)], "x date")
    got = [r[0] for r in df.select(month_label(month_ordinal("x"))).collect()]
    assert got == ["2024-01", "1999-12", "0999-03"]


@pytest.mark.parametrize(
    "num, den, expected",
    [(1, 2, 1), (3, 2, 2), (5, 2, 3), (-1, 2, -1), (-3, 2, -2), (1, 3, 0), (2, 3, 1), (7, 7, 1), (0, 5, 0)],
)
def test_half_up_div(spark, num, den, expected):
    df = spark.createDataFrame([(num, den)], "n long, m long")
    assert df.select(half_up_div(F.col("n"), F.col("m"))).first()[0] == expected


def test_half_up_div_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1, 0)], "n long, m long")
    assert df.select(half_up_div(F.col("n"), F.col("m"))).first()[0] is None


def test_money_cents_decimal_and_double(spark):
    df = spark.createDataFrame([(Decimal("12.34"), 0.1 + 0.2)], "a decimal(10,2), b double")
    r = df.select(
        money_cents(F.col("a"), df.schema["a"].dataType), money_cents(F.col("b"), df.schema["b"].dataType)
    ).first()
    assert tuple(r) == (1234, 30)


def test_money_cents_rounds_long_decimals(spark):
    from decimal import Decimal

    from cohortlens.functions import money_cents

    df = spark.createDataFrame([(Decimal("1.999"),), (Decimal("-0.006"),), (Decimal("0.005"),), (Decimal("2.494"),), (None,)], "v decimal(10,3)")
    assert [r[0] for r in df.select(money_cents(df.v, df.schema["v"].dataType)).collect()] == [200, -1, 1, 249, None]
