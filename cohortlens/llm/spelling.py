"""Spelling variants: words one edit apart, found by an index of variable-length grams.

Method:

1. *Gram dictionary.* All substrings of ``QMIN`` to ``QMAX`` characters of the marked words ``^word$`` are counted;
   those in more than ``rare`` places are the frequent ones, and the dictionary is pruned to them: a gram grows
   only while it is frequent.
2. *Decomposition.* A word of L letters is cut at m - 1 places. Each cut gives two grams of variable length, one that
   ends there, grown to the left, and one that begins there, grown to the right, until it is rare or meets the mark:
   2(m - 1) grams, each with its place from the word's start or end.
3. *Affected-gram bound.* A gram depends on the letters on its side of the cut alone. An edit inside piece i
   can affect the left grams of the cuts behind it and the right grams of the cuts up to it, no others: m - 1 at most
   (:func:`affected`). A word one edit away shares the other m - 1.
4. *List merging.* For each place of the edit the lists of the grams that stay must all hold the partner. Their merge
   is one equality join on the hash of these m - 1 grams, their places and the shorter word's length, in which a word
   stands for itself and, one letter longer, as a partner.
5. *Verification* by edit distance. A pair is taken in the piece where its words first differ, so exactly once.

A list holds words that agree in all grams outside one piece, so no group of frequent grams is ever paired with
itself, and a short or long, rare or frequent word takes the same way.

Size of what is broadcast: ``rare`` is raised to the number of places over ``MAX_GRAMS``, so that at most
``(QMAX - QMIN + 1) * MAX_GRAMS`` grams of at most ``QMAX`` characters are frequent at any size of the
corpus (1.5 MB of text). It changes how long grams grow, not the result.

Words are counted with map-side combination, so a word that is a third of all costs no more than another. Results that
several steps read are written to the shared folder.

Defined cases: a null or empty text has no words; a null id counts as an empty string in the altered runs' hash; repeated
rows count as often as they stand; ties of the largest n go to the least word in code-point order; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ascii_lower, materialize, text_or_empty

# Fixed values of the query.
RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS = 5
MIN_COUNT = 3
ALTERED = 97
FORM_TIMES = 2

QMIN, QMAX = 2, 6
RARE = 32
MAX_GRAMS = 50_000
PIECES = 4
COUNT_AT_ONCE = 400_000
MAX_ROUNDS = 40


def altered(run: Column, doc: Column) -> Column:
    """The run without one character, where the checksum of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % ALTERED == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``MIN_CHARS`` code points and ``MIN_COUNT`` occurrences."""
    t = docs.select(F.col(id_col).alias("doc"), ascii_lower(text_or_empty(text_col)).alias("t"))
    runs = t.select("doc", F.explode(F.regexp_extract_all("t", F.lit(RUN), F.lit(0))).alias("run")).where(F.char_length("run") >= MIN_CHARS)
    words = runs.select(altered(F.col("run"), F.col("doc")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.col("n") >= MIN_COUNT) & (F.char_length("word") >= MIN_CHARS))


def frequent_grams(words: DataFrame, rare: int = RARE) -> list[str]:
    """The pruned dictionary: grams of the marked words in more than ``rare`` places (or more, see the module)."""

    def count(batches):
        found: Counter[str] = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["gram", "places"])
            found.clear()
            return out

        for b in batches:
            for w in b.column(0).to_pylist():
                w = f"^{w}$"
                for q in range(QMIN, QMAX + 1):
                    found.update([w[i : i + q] for i in range(len(w) - q + 1)])
                if len(found) > COUNT_AT_ONCE:
                    yield rows()
        yield rows()

    places = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    grams = words.select("word").mapInArrow(count, "gram string, places bigint")
    counts = grams.groupBy("gram").agg(F.sum("places").alias("places"))
    return [r["gram"] for r in counts.where(F.col("places") > max(rare, places // MAX_GRAMS)).select("gram").collect()]


def cuts(length: int) -> list[int]:
    """Letters before each cut of a word, ascending."""
    pieces = min(PIECES, length)
    return [length * i // pieces for i in range(1, pieces)]


def affected(n_cuts: int, piece: int) -> tuple[list[int], list[int]]:
    """Cuts whose left (right) gram an edit in ``piece`` may change; of 2 * ``n_cuts`` grams ``n_cuts`` in all."""
    return list(range(piece, n_cuts)), list(range(piece))


def left_gram(word: str, to: int, frequent: frozenset[str]) -> str:
    """The gram of marked ``word`` that ends with its letter number ``to``."""
    start = to - 1
    while start > 0 and word[start : to + 1] in frequent:
        start -= 1
    return word[start : to + 1]


def right_gram(word: str, letters: int, frequent: frozenset[str]) -> str:
    """The gram of marked ``word`` that begins with the first of its last ``letters`` letters."""
    start = len(word) - 1 - letters
    end = start + QMIN
    while end < len(word) and word[start:end] in frequent:
        end += 1
    return word[start:end]


def merge_keys(word: str, length: int, frequent: frozenset[str]) -> list[int]:
    """Per piece of a shorter word of ``length`` letters the hash of the grams that an edit in that piece leaves."""
    marked, at = f"^{word}$", cuts(length)
    left = [left_gram(marked, c, frequent) for c in at]
    right = [right_gram(marked, length - c, frequent) for c in at]
    out = []
    for piece in range(len(at) + 1):
        gone_left, gone_right = affected(len(at), piece)
        stay = [g for i, g in enumerate(left) if i not in gone_left] + [g for i, g in enumerate(right) if i not in gone_right]
        h = xxhash.xxh64_intdigest(f"{length} {piece} {' '.join(stay)}".encode())
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def gram_lists(words: DataFrame, frequent: list[str]) -> DataFrame:
    """(key, longer, word, n, since, until): the lists' entries. A word stands in its own lists, and as the longer partner in
    those of words one letter shorter. ``since`` and ``until`` are the letters before the piece and its end (null: the last)."""
    shared = words.sparkSession.sparkContext.broadcast(frozenset(frequent))

    def run(batches):
        grams = shared.value
        for b in batches:
            rows, key, longer, since, until = [], [], [], [], []
            for i, w in enumerate(b.column(0).to_pylist()):
                for length in (len(w), len(w) - 1):
                    if length < MIN_CHARS:
                        continue
                    found, at = merge_keys(w, length, grams), cuts(length)
                    key += found
                    rows += [i] * len(found)
                    longer += [length < len(w)] * len(found)
                    since += [0, *at]
                    until += [*at, None]
            at = pa.array(rows, pa.int32())
            cols = [pa.array(key, pa.int64()), pa.array(longer, pa.bool_()), b.column(0).take(at), b.column(1).take(at)]
            cols += [pa.array(since, pa.int32()), pa.array(until, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "longer", "word", "n", "since", "until"])

    schema = "key bigint, longer boolean, word string, n bigint, since int, until int"
    return words.select("word", "n").mapInArrow(run, schema)


def near_pairs(words: DataFrame, rare: int = RARE) -> DataFrame:
    """(word, n, near, near_n): each pair of words one edit apart once, the shorter word (of two equally long ones the lesser) first."""
    lists = materialize(gram_lists(words, frequent_grams(words, rare)), "gram-lists")
    a = lists.where(~F.col("longer")).select("key", "word", "n", "since", "until")
    b = lists.select("key", "longer", F.col("word").alias("near"), F.col("n").alias("near_n"))

    def same(letters: str) -> Column:
        return F.substring("word", F.lit(1), F.col(letters)) == F.substring("near", F.lit(1), F.col(letters))

    found = a.hint("merge").join(b.hint("merge"), "key").where(F.col("longer") | (F.col("word") < F.col("near")))
    found = found.where(same("since") & (F.col("until").isNull() | ~same("until")))
    return found.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of ``forms`` (word, form; no nulls, no circles) lead, by doubling the steps taken."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("then"))
        at = materialize(
            at.join(further, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "roots"
        )
        if not at.where("moved").take(1):
            return at.select("word", "root")
        at = at.select("word", "root")
    raise RuntimeError(f"forms not followed to their ends after {MAX_ROUNDS} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word.

    A word's form is its near word of largest n, if that is at least
    ``FORM_TIMES`` its own; its root is where forms lead in the end.
    """
    words = materialize(word_counts(docs, id_col, text_col), "words")
    pairs = near_pairs(words, rare)
    both = F.array(
        F.struct(F.col("word"), F.col("near"), F.col("near_n")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    best = pairs.select(F.explode(both).alias("x")).select("x.*")
    best = best.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("best"))
    taken = -F.col("best.o") >= FORM_TIMES * F.col("n")
    found = materialize(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best.near")).alias("form"),
            F.when(taken, -F.col("best.o")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
