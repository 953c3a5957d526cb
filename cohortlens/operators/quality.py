"""Key integrity checks the database would enforce and Spark does not (Q1, Q2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _block(column: str) -> Column:
    return F.bitmap_bucket_number(F.col(column)).alias("block")


def _ids(column: str) -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position(F.col(column))).alias("ids")


def _in_blocks(df: DataFrame, column: str, blocks: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id lies in one of ``blocks``; as few are suspect, Spark measures and broadcasts them."""
    return df.withColumn("_block", _block(column)).join(blocks.select(F.col("block").alias("_block")), "_block", "left_semi").drop("_block")


def _check_dense(df: DataFrame, column: str) -> None:
    kind = df.schema[column].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"dense_ids needs an integer key, {column} is {kind}")


def pk_violations(df: DataFrame, keys: Sequence[str], dense_ids: bool = False) -> DataFrame:
    """Q1: key values occurring more than once: ``*keys, n_rows``.

    A grouped count, combined map-side, so a heavily repeated key is one row
    per task before the shuffle.

    ``dense_ids`` is for one integer key that is numbered densely: a first
    pass gathers each block of 32,768 ids as a bitmap with its number of rows (4 KB a block and
    task); only the rows of blocks with more rows than ids, and those without an id, are moved and
    counted. A unique key is checked without moving any row.
    """
    suspects = df
    if dense_ids:
        (key,) = keys
        _check_dense(df, key)
        blocks = df.where(F.col(key).isNotNull()).groupBy(_block(key)).agg(F.count(F.lit(1)).alias("n"), _ids(key))
        blocks = blocks.where(F.col("n") > F.bitmap_count("ids"))
        only = df.select(key)
        suspects = _in_blocks(only, key, blocks).unionByName(only.where(F.col(key).isNull()))
    return (
        suspects.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def orphan_keys(
    fact: DataFrame, fk: str, dim: DataFrame, pk: str, name: str | None = None, dense_ids: bool = False
) -> DataFrame:
    """Non-null ``fact.fk`` values absent from ``dim.pk``: ``fk_column, key_value, n_rows``.

    Fact rows are counted per key value first (map-side combine), then
    anti-joined with the distinct dimension keys (a key repeated in the
    dimension is one row per task before the shuffle).

    ``dense_ids`` is for integer keys that are numbered densely: bitmaps of
    both sides, one a block of 32,768 ids and task, tell the blocks in which the fact has ids that the
    dimension lacks; only the rows and keys of those are counted and joined.
    """
    known = fact.where(F.col(fk).isNotNull())
    if dense_ids:
        _check_dense(fact, fk)
        _check_dense(dim, pk)
        used = known.groupBy(_block(fk)).agg(_ids(fk)).withColumn("of_dim", F.lit(False))
        there = dim.where(F.col(pk).isNotNull()).groupBy(_block(pk)).agg(_ids(pk)).withColumn("of_dim", F.lit(True))
        both = used.unionByName(there).groupBy("block").agg(
            F.bitmap_or_agg("ids").alias("ids"), F.max(F.when(F.col("of_dim"), F.col("ids"))).alias("dim_ids")
        )
        blocks = both.where(F.bitmap_count("ids") > F.coalesce(F.bitmap_count("dim_ids"), F.lit(0)))
        known, dim = _in_blocks(known.select(fk), fk, blocks), _in_blocks(dim.select(pk), pk, blocks)
    counts = known.groupBy(F.col(fk).alias("key_value")).agg(F.count(F.lit(1)).alias("n_rows"))
    keys = dim.select(F.col(pk).alias("key_value")).distinct()
    return counts.join(keys, "key_value", "left_anti").select(
        F.lit(name or fk).alias("fk_column"), "key_value", "n_rows"
    )


def fk_violations(
    orders: DataFrame, customers: DataFrame, products: DataFrame | None = None
) -> DataFrame:
    """Q2: orphan ``orders.customer_id`` (and ``orders.product_id`` if products given)."""
    out = orphan_keys(orders, "customer_id", customers, "customer_id")
    if products is not None:
        out = out.unionByName(orphan_keys(orders, "product_id", products, "product_id"))
    return out
