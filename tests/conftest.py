from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)

from cohortlens.session import build_session  # noqa: E402
from cohortlens.sources.schema import CUSTOMERS, ORDERS, PRODUCTS  # noqa: E402


EVENT_LOG_DIR = tempfile.mkdtemp(prefix="cohortlens-test-events-")


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "local[4]",
        shuffle_partitions=8,
        extra={
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": EVENT_LOG_DIR,
            "spark.eventLog.compress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="cohortlens-test-shared-"),
        },
    )
    yield s
    s.stop()


def d(text: str | None) -> dt.date | None:
    return None if text is None else dt.date.fromisoformat(text)


def customers_df(spark, rows):
    """rows: (customer_id, signup 'YYYY-MM-DD' or None, segment[, name])."""
    data = [
        (r[0], r[3] if len(r) > 3 else f"c{r[0]}", d(r[1]), r[2] if len(r) > 2 else "Retail")
        for r in rows
    ]
    return spark.createDataFrame(data, CUSTOMERS)


def orders_df(spark, rows):
    """rows: (order_id, customer_id, 'YYYY-MM-DD' or None, value[, quantity[, product_id]])."""
    data = []
    for r in rows:
        qty = r[4] if len(r) > 4 else 1
        pid = r[5] if len(r) > 5 else 1
        val = None if r[3] is None else Decimal(str(r[3]))
        data.append((r[0], r[1], pid, d(r[2]), qty, val))
    return spark.createDataFrame(data, ORDERS)


def products_df(spark, rows):
    """rows: (product_id, category[, price])."""
    data = [(r[0], f"p{r[0]}", r[1], Decimal(str(r[2] if len(r) > 2 else 10))) for r in rows]
    return spark.createDataFrame(data, PRODUCTS)


def rows(df, *cols):
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
