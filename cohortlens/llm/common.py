"""Column expressions and helpers shared by the corpus operators."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.plans.materialize import materialize

__all__ = ["ALNUM_SPLIT", "SPACE_CHARS", "SPACE_SPLIT", "ascii_lower", "materialize", "slices", "text_or_empty", "words_of"]

# Fixed patterns of the contracts: separators of the two word kinds.
ALNUM_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing, so A-Z are word characters
SPACE_SPLIT = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def text_or_empty(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that on pure ASCII text and is much cheaper than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words_of(text: Column, separators: str) -> Column:
    """Array of the words between ``separators`` (no empty strings; empty array for a text without words)."""
    return F.array_remove(F.split(text, separators, -1), "")


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive parts of at most ``max_bytes`` in ``column`` (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def empty_as(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)
