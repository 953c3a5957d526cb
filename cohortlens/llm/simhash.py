"""SimHash near-duplicates: 64-bit fingerprints, linked at a small bit distance.

Method, segment-popcount embedding: a fingerprint is cut into 32 segments of
two bits and mapped to the segments' bit counts, a point in {0, 1, 2}^32. The
Manhattan distance of two points never exceeds the bit distance of their
fingerprints, so a range join of the points on a grid finds every link:

* With distance at most ``d``, points cut into ``blocks`` coordinate blocks
  agree in at least ``blocks - d`` of them, so two linked fingerprints share a
  grid cell, the coordinates of one choice of ``blocks - d`` blocks. The number
  of blocks goes by the number of points: more of them make more cells a point
  and fewer chance meetings, whose number would grow with the square of the
  points at a fixed number of blocks.
* Points of a cell are compared by Manhattan distance first and by exact bit
  distance then.
* A cell of more than ``cell_limit`` points is never paired off: each of its
  points emits the fingerprints within ``d / 2`` bits of itself, and points
  that meet in one are linked to the smallest there. All of them are within
  ``d`` bits of each other, and any two points within ``d`` bits meet, so the
  components are exact while the work stays in proportion to the points.

Equal fingerprints are one point throughout. Fingerprint: A-Z lower-cased,
words ``[^\\x20\\x09-\\x0D]+``, ``shingle``-word shingles with repeats joined by
a space (fewer words: the whole sequence), XXH64 of each (seed 42); a bit is
set if it is in over half of them. No words: fingerprint zero.

Defined cases: null or empty text: fingerprint zero, linked like any other;
null id: the row gets a fingerprint but is in no component (null) and is never
removed; rows repeating an id: one component; empty table: empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize
from cohortlens.llm.graph import components

SHINGLE = 4
MAX_BITS = 4
LEAST_BLOCKS, MOST_BLOCKS = 8, 16
CELL_LIMIT = 64  # at least 2
SEED = 42
_LOW_BITS = 0x5555555555555555
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    k = min(shingle, len(words))
    starts, ends = start[: len(words) - k + 1], end[k - 1 :]
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):  # bounded memory for very long texts
        at = zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in at], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp): fp as a signed bigint, one row per row of ``docs``."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, "<u8").view("<i8"))], ["doc", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, f"doc {kind}, fp bigint")


def embedding(fp: Column) -> Column:
    """The 32 segment bit counts in unary (0 = 00, 1 = 01, 2 = 11): Manhattan distance = bits that differ."""
    high, low = F.shiftrightunsigned(fp, 1), F.lit(_LOW_BITS)
    return fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def _masks(blocks: int, equal: int) -> list[int]:
    """One 64-bit mask for each choice of ``equal`` of the ``blocks`` coordinate blocks, as signed integers."""
    cuts = [2 * (32 * i // blocks) for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(block, equal)]


def blocks_for(points: int, max_bits: int = MAX_BITS) -> int:
    """The number of blocks with the least work for so many points.

    Work a point: its cells, and in each the random points that share it. Two
    random fingerprints agree in a coordinate with probability 1/16 + 1/4 + 1/16.
    """

    def work(blocks: int) -> float:
        return comb(blocks, max_bits) * (1 + points * 0.375 ** (32 * (blocks - max_bits) / blocks))

    return min(range(max(LEAST_BLOCKS, max_bits + 1), max(MOST_BLOCKS, max_bits + 1) + 1), key=work)


def _flips(bits: int) -> list[int]:
    """Every 64-bit pattern of at most ``bits`` ones, as signed integers."""
    return [int(np.uint64(sum(1 << b for b in c)).astype(np.int64)) for n in range(bits + 1) for c in combinations(range(64), n)]


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(a, b) pairs of different fingerprints whose components are those of all pairs within ``max_bits`` bits.

    ``fps``: distinct fingerprints in column fp. ``blocks``: None goes by their number.
    """
    blocks = blocks_for(fps.count(), max_bits) if blocks is None else blocks
    if not 0 <= max_bits < blocks <= 32 or max_bits % 2:
        raise ValueError("max_bits must be even, blocks over max_bits and at most 32")
    masks = _masks(blocks, blocks - max_bits)
    # A few bytes a point become many cells: dealt out first, as the points lie in few files.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = fps.repartition(parts, "fp").select("fp", embedding(F.col("fp")).alias("p"))
    cells = points.select(
        "fp", "p", F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), F.col("p").bitwiseAND(F.lit(m)).alias("at")) for i, m in enumerate(masks)])).alias("c")
    ).select("fp", "p", F.xxhash64("c.grid", "c.at").alias("cell"))  # equal hashes of two cells only add comparisons
    cells = materialize(cells.select("fp", "cell"), "simhash-cells")
    counted = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    shared = materialize(counted.where(F.col("n") > 1), "simhash-shared")
    # Cells of two, by far the most, are pairs already. The merge join keeps one plan at every size.
    held = materialize(cells.join(shared.where(F.col("n") > 2).select("cell", "n").hint("merge"), "cell"), "simhash-held")

    sparse = held.where(F.col("n") <= cell_limit)
    x, y = sparse.select("cell", F.col("fp").alias("a")), sparse.select("cell", F.col("fp").alias("b"))
    pairs = x.join(y.hint("merge"), "cell").where(F.col("a") < F.col("b")).select("a", "b")
    near = (
        pairs.unionByName(shared.where(F.col("n") == 2).select("a", "b"))
        .where(F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b")))) <= max_bits)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )
    # Dense cells: meet in the middle. Flips are grouped in the task before they are shuffled.
    flips = F.array(*[F.lit(m) for m in _flips(max_bits // 2)])
    dense = held.where(F.col("n") > cell_limit).select("fp").distinct()
    met = dense.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("meet"))
    centre = met.groupBy("meet").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1)
    star = met.join(centre.hint("merge"), "meet").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b"))
    return near.unionByName(star).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    blocks: int | None = None,
    cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """(doc, fp, component): per row its signed fingerprint and the smallest id reachable by links.

    The joins are merge joins: their tables grow with the documents, and the
    size of a compressed file would pass some of them off as small.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    points = materialize(
        fps.where(F.col("doc").isNotNull()).groupBy("fp").agg(F.min("doc").alias("first")), "simhash-points"
    )
    comp = components(links(points.select("fp"), max_bits, blocks, cell_limit), "simhash-components")
    in_class = points.join(comp.hint("merge"), points["fp"] == comp["node"], "left").select(
        points["fp"], "first", F.coalesce("component", points["fp"]).alias("component")
    )
    in_class = materialize(in_class, "simhash-classes")
    least = in_class.groupBy("component").agg(F.min("first").alias("least"))
    of_fp = materialize(in_class.join(least.hint("merge"), "component").select(F.col("fp").alias("point"), "least"), "simhash-least")
    joined = fps.join(of_fp.hint("merge"), fps["fp"] == of_fp["point"], "left")
    return joined.select("doc", "fp", F.when(F.col("doc").isNotNull(), F.col("least")).alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` without the near copies of an earlier document: of each component the smallest id stays.

    Rows repeating the staying id all stay; rows with a null id stay.
    """
    copies = near_duplicates(docs, id_col, text_col, **parameters).where(F.col("component") < F.col("doc"))
    d, c = docs.alias("d"), copies.select(F.col("doc").alias("copy")).distinct().alias("c")
    return d.join(c, F.col(f"d.`{id_col}`") == F.col("c.copy"), "left_anti")
