"""Column helpers (JVM-side expressions only, no UDFs)."""

from cohortlens.functions.calendar import (
    day_gap,
    month_index,
    month_label,
    month_ordinal,
)
from cohortlens.functions.numeric import half_up_div, money_cents

__all__ = [
    "day_gap",
    "half_up_div",
    "money_cents",
    "month_index",
    "month_label",
    "month_ordinal",
]
