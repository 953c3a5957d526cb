"""Filter interaction audit: what each filter of a cascade removes, in every order of the filters.

Method: a document is the set of filters it fails, one of 2^k masks. As a
matrix, masks x filters, a failed filter is 0 and a passed one infinite; an
order of the filters is the row of its inverse permutation, the step at which
each filter stands. The min-plus product of the two gives, for every mask and
order, the step that removes the mask's documents: the least position among the
filters they fail. Removal steps scatter the masks' weights (documents, good
ones, toxic ones) to (order, step), and all other counts follow: kept by running
sums, redundant failures as a filter's failures less what it removed itself.

In Spark, documents become (part, mask) with pre-aggregated weights before
anything else, at most 2^k rows a part; the matrices (2^k x k! at most, k <= 7) are made once
a task, and a part's report is made from its 2^k weights. No text leaves the
scan: duplicates are found by the SHA-256 of the text, and every exchange moves
documents pre-aggregated by (id, text, mask, part), so that one text, part or
id that holds most of the table is combined before it is moved.

Defined cases: a null text is the empty text, a null part the empty string; a
null id is neither smaller nor larger than any other, so its row is no duplicate
and makes none; rows of one id with one text are no duplicates of each other;
an id without a label is neither good nor toxic, one with several labels is
good (toxic) if any says so; other columns are not read; an empty table has no
parts, so no rows.
"""

from __future__ import annotations

import functools
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACE_SPLIT, text_or_empty, words_of

FILTERS = "ABCDE"
DUPLICATE = "E"
MAX_FILTERS = 7
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Fixed values of the filters.
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = "[#$%&*|]"

MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filter -> whether a text, given with its words, fails it; the duplicate filter needs the table."""
    n, upper = F.size(words), F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT_PERCENT * n.cast("long"),
        "C": 100 * upper.cast("long") > MAX_UPPER_PERCENT * F.char_length(text).cast("long"),
        "D": F.regexp_like(text, F.lit(SYMBOLS)),
    }


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): weights of each part's documents by the filters they fail (bit i: filter i)."""
    t = docs.select(
        F.col(id_col).alias("doc"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_or_empty(text_col).alias("t"),
    )
    failed = text_failures(F.col("t"), words_of(F.col("t"), SPACE_SPLIT))
    bits = [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failed.items()]
    copies = (
        t.select("doc", "part", F.unhex(F.sha2("t", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
        .groupBy("doc", "digest", "mask", "part")
        .agg(F.count("*").alias("n"))
    )
    known = labels.groupBy(F.col("doc_id").alias("doc")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic"),
    )
    rows = copies.join(known, "doc", "left").select(
        "doc", "digest", "mask", "part", "n",
        (F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
    )
    named = F.col("doc").isNotNull()
    weights = ["n", "good", "toxic"]
    # Per text and part: the rows of its smallest id, all rows, and those without an id.
    groups = rows.groupBy("digest", "mask", "part").agg(
        F.min(F.when(named, F.struct("doc", *weights))).alias("first"),
        *[F.sum(w).alias(w) for w in weights],
        *[F.sum(F.when(named, 0).otherwise(F.col(w))).alias(f"{w}_unnamed") for w in weights],
    )
    least = F.min("first.doc").over(Window.partitionBy("digest"))
    first = groups.withColumn("is_first", F.coalesce(F.col("first.doc") == least, F.lit(False)))
    original = {w: F.col(f"{w}_unnamed") + F.when(F.col("is_first"), F.col(f"first.{w}")).otherwise(0) for w in weights}
    duplicate = 1 << FILTERS.index(DUPLICATE)
    sides = F.array(
        F.struct(F.col("mask"), *[original[w].alias(w) for w in weights]),
        F.struct((F.col("mask") + duplicate).alias("mask"), *[(F.col(w) - original[w]).alias(w) for w in weights]),
    )
    each = first.select("part", F.explode(sides).alias("x")).select("part", "x.*").where("n > 0")
    return each.groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in weights])


@functools.cache
def removal_steps(k: int) -> tuple[np.ndarray, np.ndarray]:
    """The orders of ``k`` filters (k! x k filters, lexicographic) and the step, 1 to k, that removes each mask in each order
    (2^k x k!; k + 1: never)."""
    orders = np.array(list(permutations(range(k))), np.int64).reshape(math.factorial(k), k)
    position = np.argsort(orders, axis=1) + 1
    never = k + 1
    failed = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    masks = np.where(failed == 1, 0, never)
    steps = np.full((1 << k, len(orders)), never, np.int64)
    for f in range(k):  # min-plus product, one filter at a time
        np.minimum(steps, masks[:, f, None] + position[None, :, f], out=steps)
    return orders, steps


def part_report(weights: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The measures of one part by (order, step), from its ``weights`` (3 x 2^k: documents, good, toxic)."""
    orders, steps = removal_steps(k)
    rank, at = np.arange(len(orders)), np.arange(k)
    gone = np.zeros((3, len(orders), k + 2), np.int64)
    for w, out in zip(weights, gone, strict=True):
        np.add.at(out, (np.broadcast_to(rank, steps.shape), steps), np.broadcast_to(w[:, None], steps.shape))
    removed, good, toxic = gone[:, :, 1 : k + 1]
    n = weights[0]
    fails = np.array([n[(np.arange(1 << k) >> f) & 1 == 1].sum() for f in range(k)])
    shapley = np.zeros(k, np.int64)
    np.add.at(shapley, orders, removed)
    return {
        "filter": orders,
        "step": np.broadcast_to(at + 1, orders.shape),
        "kept": n.sum() - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": fails[orders] - removed,
        "unique_fails": n[1 << orders],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": shapley[orders],
    }


def interactions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, measures): k! x k rows a part, from (part, mask, n, good, toxic) with one row a mask.

    ``filters``: one letter a filter, bit i of the mask is filter i.
    """
    k = len(filters)
    if not 1 <= k <= MAX_FILTERS or len(set(filters)) < k:
        raise ValueError(f"1 to {MAX_FILTERS} different filters")

    def run(batches):
        names = np.array(list(filters))
        for batch in batches:
            for row in batch.to_pylist():
                weights = np.zeros((3, 1 << k), np.int64)
                for x in row["weights"]:
                    weights[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                found = part_report(weights, k)
                orders = ["".join(o) for o in names[found["filter"]]]
                cols = [pa.array([row["part"]] * (len(orders) * k)), pa.array(np.repeat(orders, k))]
                cols += [pa.array(found["step"].ravel().astype(np.int32)), *(pa.array(found[m].ravel()) for m in MEASURES)]
                yield pa.RecordBatch.from_arrays(cols, ["part", "filter_order", "step", *MEASURES])

    packed = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("weights"))  # 2^k at most
    measures = ", ".join(f"{m} bigint" for m in MEASURES)
    return packed.mapInArrow(run, f"part string, filter_order string, step int, {measures}")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The interactions of the five text filters over ``docs``, by part."""
    return interactions(document_masks(docs, labels, id_col, text_col, part_col))
