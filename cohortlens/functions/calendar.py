"""Calendar arithmetic of the cohort model.

Cohorts are calendar months. A month is carried through shuffles as an
integer ordinal (``year * 12 + month - 1``) and only turned into its
``yyyy-MM`` label at the end, so grouping keys stay fixed-width ints.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_ordinal(d: Column | str) -> Column:
    """Calendar month of a date/timestamp as ``year*12 + month - 1`` (int)."""
    day = F.to_date(_col(d))
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def month_label(ordinal: Column | str) -> Column:
    """``yyyy-MM`` label of a month ordinal (sorts chronologically)."""
    o = _col(ordinal)
    year = F.floor(o / 12).cast("int")
    month = (o - year * 12 + 1).cast("int")
    return F.format_string("%04d-%02d", year, month)


def month_index(event_date: Column | str, start_date: Column | str) -> Column:
    """Calendar (not elapsed) months from ``start_date`` to ``event_date``.

    ``(year(e) - year(s)) * 12 + (month(e) - month(s))``: 2024-01-31 to
    2024-02-01 is 1; an event before the start gives a negative index.
    """
    return month_ordinal(event_date) - month_ordinal(start_date)


def day_gap(later: Column | str, earlier: Column | str) -> Column:
    """Whole days between two dates, time of day ignored (SQL DATEDIFF)."""
    return F.datediff(F.to_date(_col(later)), F.to_date(_col(earlier)))
