"""Benchmark decontamination: find benchmark word windows in documents, remove documents or spans.

Method: the distinct hashes of the benchmark's normalised n-grams are broadcast
(their number is checked first; a larger set is joined by a shuffle), every
document's token windows are scanned against them, hits are joined with the
n-grams and verified word by word, and the hit documents or word spans are
removed. Items come in after the scan from a plain table of (item set, item).
Built-in functions only.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is
``n`` consecutive words of an item; an item of fewer words, but not none, is
one window.

Defined cases: a null or empty text has no words and no hit; a null id is a
document of its own per text; rows repeating both id and text get the same
result each; an item without words gives no window, an empty benchmark gives
no hit; an item with a null id hits like any other, without a name in ``items``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ALNUM_SPLIT, ascii_lower, empty_as, materialize, text_or_empty, words_of

WINDOW = 10
#: The hashes are broadcast up to this many windows (8 bytes each, less than 100 in the hash table); beyond, Spark joins by shuffle.
BROADCAST_WINDOWS = 500_000


def _words(text_col: str) -> Column:
    return words_of(ascii_lower(text_or_empty(text_col)), ALNUM_SPLIT)


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, hash, gram, item): each distinct window once for each item holding it."""
    return (
        benchmark.select(F.col(item_col).alias("item"), _words(text_col).alias("w"))
        .where(F.size("w") > 0)
        .withColumn("size", F.least(F.size("w"), F.lit(n)))
        .select("item", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
        .select("size", F.slice("w", F.col("at"), F.col("size")).alias("gram"), "item")
        .select("size", F.xxhash64("gram").alias("hash"), "gram", "item")
        .distinct()
    )


def _item_set() -> Column:
    """Key of the set of a group's distinct items: their number and 128 bits of their hashes."""
    named = F.col("item").isNotNull()
    hashes = [F.coalesce(F.bit_xor(F.when(named, F.xxhash64(F.lit(seed), "item"))), F.lit(0).cast("long")) for seed in (1, 2)]
    return F.struct(F.count("item").alias("n"), hashes[0].alias("a"), hashes[1].alias("b"))


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(doc, text_hash, spans, items): one row per document text with a hit.

    ``spans``: sorted (start, end) word ranges of the occurrences, end
    exclusive; ``items``: distinct item ids, nulls left out. Only occurrences
    are shuffled.
    """
    pairs = materialize(benchmark_windows(benchmark, n, item_col), "bench-pairs")
    window = ["size", "hash", "gram"]
    grams = materialize(pairs.groupBy(*window).agg(_item_set().alias("set")), "bench-grams")
    # Windows of the same items share a set, whose items stand in the table once.
    sets = materialize(pairs.where(F.col("item").isNotNull()).join(grams, window).select("set", "item").distinct(), "bench-sets")
    sizes = {r["size"]: r["count"] for r in grams.groupBy("size").count().collect()}  # at most n rows
    if not sizes:
        item_type = benchmark.schema[item_col].dataType.simpleString()
        id_type = docs.schema[id_col].dataType.simpleString()
        return empty_as(docs, f"doc {id_type}, text_hash bigint, spans array<struct<s:int,e:int>>, items array<{item_type}>")
    small = sum(sizes.values()) <= broadcast_windows
    words = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), _words(text_col).alias("w")
    )
    found = None
    for size in sorted(sizes):
        at = words.where(F.size("w") >= size).select(
            "doc", "text_hash", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (size - 1))).alias("at")
        )
        h = grams.where(F.col("size") == size).select("hash").distinct()
        here = F.slice("w", F.col("at"), F.lit(size))
        # The scan is against the hashes; the words are compared for equal hashes only.
        scan = at.select("doc", "text_hash", "at", F.xxhash64(here).alias("hash"), here.alias("here"))
        occ = scan.join(F.broadcast(h) if small else h, "hash").select("doc", "text_hash", "at", F.lit(size).alias("size"), "hash", "here")
        found = occ if found is None else found.unionByName(occ)
    found = found.join(grams, ["size", "hash"]).where(F.col("here") == F.col("gram"))
    found = materialize(
        found.groupBy("doc", "text_hash").agg(
            F.array_sort(F.collect_set(F.struct((F.col("at") - 1).alias("s"), (F.col("at") + F.col("size") - 1).alias("e")))).alias("spans"),
            F.collect_set("set").alias("sets"),
        ),
        "bench-spans",
    )
    items = found.select("doc", "text_hash", F.explode("sets").alias("set")).join(sets, "set")
    items = items.groupBy("doc", "text_hash").agg(F.collect_set("item").alias("items"))
    d, i = found.alias("d"), items.alias("i")
    on = F.col("d.doc").eqNullSafe(F.col("i.doc")) & (F.col("d.text_hash") == F.col("i.text_hash"))
    named = F.coalesce("i.items", F.array().cast(items.schema["items"].dataType))
    return d.join(i, on, "left").select("d.doc", "d.text_hash", "d.spans", named.alias("items"))


def covered_words(spans: Column) -> Column:
    """Words inside any of the sorted spans, each counted once."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], x["e"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )


def report(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(doc, n_words, n_hit, items) for every row of ``docs``; ``items`` is empty where nothing hit."""
    found = materialize(hits(docs, benchmark, n, id_col, text_col, item_col), "bench-hits").select(
        F.col("doc").alias("hit_doc"), F.col("text_hash").alias("hit_hash"), "items", covered_words(F.col("spans")).alias("n_hit")
    )
    base = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_or_empty(text_col)).alias("text_hash"),
        F.size(words_of(text_or_empty(text_col), ALNUM_SPLIT)).cast("long").alias("n_words"),
    )
    on = base["doc"].eqNullSafe(found["hit_doc"]) & (base["text_hash"] == found["hit_hash"])
    return base.join(found, on, "left").select(
        "doc",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    remove: str = "documents",
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit word spans cut out of their texts.

    With ``remove="spans"`` a cut text is its remaining words in their
    original case, joined by single spaces; other texts are unchanged.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = materialize(hits(docs, benchmark, n, id_col, text_col, item_col), "bench-hits")
    d, h = docs.alias("d"), found.alias("h")
    text = F.col(f"d.`{text_col}`")
    on = F.col(f"d.`{id_col}`").eqNullSafe(F.col("h.doc")) & (F.xxhash64(text_or_empty(text)) == F.col("h.text_hash"))
    if remove == "documents":
        return d.join(h, on, "left_anti")
    w = words_of(text_or_empty(text), ALNUM_SPLIT)
    hit_at = F.flatten(F.transform(F.col("h.spans"), lambda x: F.sequence(x["s"], x["e"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(w) - 1), hit_at)
    cut = F.array_join(F.transform(stay, lambda i: F.get(w, i)), " ")
    return d.join(h, on, "left").select(
        *[
            (F.when(F.col("h.doc").isNull() & F.col("h.text_hash").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c))
            for c in docs.columns
        ]
    )
