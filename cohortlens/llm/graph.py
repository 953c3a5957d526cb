"""Connected components of a link table, by rounds of star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize

MAX_ROUNDS = 60


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link.

    ``links``: (a, b) node pairs in any order, repeats allowed. Alternating
    large-star and small-star rounds: each round links a node's neighbours to
    the smallest of them, which keeps the table at or under its first size
    while its depth shrinks logarithmically. A hub's minimum is pre-aggregated
    before the shuffle and its join can be split. Each round is written to the
    shared folder, so that a lost executor costs a re-read; the driver sees
    two numbers a round.
    """
    edges = materialize(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        tag,
    )
    before = None
    for _ in range(MAX_ROUNDS):
        edges = _star(edges, large=True, tag=tag)
        edges = _star(edges, large=False, tag=tag)
        # Stable when a round leaves the same edge set.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not stable after {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _star(edges: DataFrame, large: bool, tag: str) -> DataFrame:
    """One star operation on (u > v) edges: neighbours of ``u`` are linked to the least of ``u`` and them."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialize(
        near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}-least"
    )
    linked = near.join(least.hint("merge"), "u")  # no broadcast: it grows with the links
    if large:  # larger neighbours move to the minimum
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours and the node itself move to the minimum
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return materialize(out.where(F.col("u") != F.col("v")).distinct(), tag)
