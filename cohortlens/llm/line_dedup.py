"""Line dedup: drop lines found in many documents, keeping them in one.

Method: explode each document's normalised lines, hash them, count the
distinct documents per hash, drop lines at or over the threshold everywhere
but in the keeping document, and reassemble the rest by position. Built-in
functions only.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with
A-Z lower-cased; keys shorter than ``min_chars`` code points never count.

Defined cases: a null or empty text is one empty line (and stays as it is); a
null id counts as no document and its lines all stay; rows that repeat an id
count as one document, and lose the same keys; an empty table gives an empty
result; extra columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACE_CHARS, ascii_lower, materialize, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3


def _key_hashes(text: Column, min_chars: int) -> Column:
    """Per line, in order: a 128-bit key hash, or null for a line too short to count."""

    def one(line: Column) -> Column:
        k = F.btrim(line, F.lit(SPACE_CHARS))
        return F.when(
            F.char_length(k) >= min_chars,
            F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")),
        )

    return F.transform(F.split(ascii_lower(text), "\n", -1), one)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, th, lost): per document id and text (its xxhash64) the positions of the lines it loses.

    The keys, 36 bytes a line, are written once; a key held by every document
    is pre-aggregated before its shuffle and its join can be split, since both
    join sides are plain tables.
    """
    text = text_or_empty(text_col)
    held = materialize(
        docs.where(F.col(id_col).isNotNull())
        # Hashed before the explode: beside it, the text would be hashed again for each of its lines.
        .select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), _key_hashes(text, min_chars).alias("ks"))
        .select("doc", "th", F.posexplode("ks").alias("at", "k"))
        .where(F.col("k").isNotNull())
        .select("doc", "th", "at", "k.a", "k.b"),
        "line-keys",
    )
    frequent = materialize(
        held.groupBy("a", "b")
        .agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("a", "b", "keeper"),
        "line-frequent",
    )
    return held.join(frequent, ["a", "b"]).where(F.col("doc") < F.col("keeper")).groupBy("doc", "th").agg(F.collect_set("at").alias("lost"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    counts: bool = False,
) -> DataFrame:
    """``docs`` with ``text_col`` rid of repeated lines; ``counts`` adds n_lines and n_dropped.

    Rows, other columns and texts without a dropped line are unchanged.
    """
    drop = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    d, k = docs.alias("d"), drop.alias("k")
    text, lost = F.col(f"d.`{text_col}`"), F.col("k.lost")
    joined = d.join(k, (F.col(f"d.`{id_col}`") == F.col("k.doc")) & (F.xxhash64(text_or_empty(text)) == F.col("k.th")), "left")
    lines = F.split(text_or_empty(text), "\n", -1)
    # The positions left, in order: a set difference, linear in the lines. The array around the lines binds
    # them to a variable, so that they are split once.
    kept = F.transform(
        F.array(lines),
        lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), lost), lambda i: F.get(ls, i)),
    )[0]
    staged = joined.select(
        F.struct("d.*").alias("d"),
        F.when(lost.isNotNull(), kept).alias("kept"),
    )
    text = F.col(f"d.`{text_col}`")
    out = [
        (F.when(F.col("kept").isNull(), text).otherwise(F.array_join("kept", "\n")).alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c))
        for c in docs.columns
    ]
    if counts:
        n = F.size(F.split(text_or_empty(text), "\n", -1)).cast("long")
        out += [
            n.alias("n_lines"),
            F.when(F.col("kept").isNull(), F.lit(0).cast("long")).otherwise(n - F.size("kept")).alias("n_dropped"),
        ]
    return staged.select(*out)
