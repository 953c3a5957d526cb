"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs the votes.

Method: each rule looks at a few text statistics and votes good (1), bad (-1)
or abstains (0). Votes are taken as independent given the hidden quality;
expectation-maximisation estimates the share of good documents and, for every
rule, how often its votes are bad on good and on bad documents, from the counts
of vote patterns. The posterior probability of good quality replaces
all-must-pass filtering: a bad vote counts by its rule's estimated accuracy, so
that the good votes of the others can outvote one of an inaccurate rule. The
model is estimated on the documents it decides on, those that pass the base
rule. Built-in functions only; the
estimation runs on the table of vote patterns, at most 3^rules rows whatever
the input, and the driver sees one row of sums a round.

Statistics per text (words ``[^\\x20\\x09-\\x0D]+``): n_words; word_chars, their
code points; n_symbols, characters of ``[#*$%&|<>]``; n_dup_lines, lines with
a word that equal an earlier line; n_repeat_words, words inside 3-word windows
that the text holds twice or more. Windows are compared by their 64-bit
hash: sorted by its upper bits next to their position, then those with an
equal neighbour by the whole of it.

Defined cases: a null or empty text has no words and fails the base rule; an
empty table gives an empty result; repeated rows and ids are judged row by
row; extra columns, whatever their names, pass through ``filter_quality``.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACE_SPLIT, materialize, text_or_empty, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
ROUNDS = 40
KEEP_AT = 0.5
#: Prior belief that a rule's bad vote is right, and its weight against what the other rules' votes say of it. At weight 1
#: a rule whose bad votes go with no other rule's ends at less than half of them right.
BELIEF, BELIEF_WEIGHT = 0.9, 1.0
#: Added to each count, so that no probability is 0.
SMOOTHING = 0.1


def _window_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _sorted_windows(words: Column, n: Column) -> tuple[Column, Column]:
    """Sorted 3-word windows of ``words`` (``n`` > 3 elements) and the mask of their position bits.

    Hashes are packed with their positions into one long, so that a plain
    sort of longs brings equal windows together. The positions take bits of
    the hashes: equal neighbours are candidates, to be told apart by whole hashes.
    """
    bits = F.length(F.bin(n))  # positions 0..n-1 fit
    place = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    packed = F.sort_array(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: _window_hash(words, i).bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("long")))
    )
    return packed, place


def _apart(col: Column, place: Column) -> Column:
    return col.bitwiseAND(F.bitwise_not(place))


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and the statistics n_words .. n_repeat_words, n_upper, n_letters, n_bangs, n_lines."""
    keep = docs.columns if keep is None else keep
    text = text_or_empty(text_col)
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.struct(F.lit(0).alias("_")).alias("row"), text.alias("t"))
    t = t.select("row", "t", words_of(F.col("t"), SPACE_SPLIT).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = sum((F.char_length("t") - F.char_length(F.replace(F.col("t"), F.lit(s), F.lit(""))) for s in SYMBOLS), F.lit(0))
    t = t.select(
        "row",
        "w",
        F.size("w").alias("n"),
        F.char_length(F.array_join("w", "")).alias("word_chars"),
        symbols.alias("n_symbols"),
        lines.alias("lines"),
        F.regexp_count("t", F.lit("[A-Z]{2}")).alias("n_upper"),
        (F.char_length("t") - F.char_length(F.replace(F.col("t"), F.lit("!"), F.lit("")))).alias("n_bangs"),
    )
    n = F.col("n")
    packed, place = _sorted_windows(F.col("w"), n)
    counts = ["row", "n", "word_chars", "n_symbols", "n_upper", "n_bangs", "n_lines", "n_dup_lines", "n_distinct"]
    t = t.withColumns(
        {
            "n_lines": F.size("lines"),
            "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
            "n_distinct": F.size(F.array_distinct("w")),
            "p": F.when(n > 3, packed),
            "place": F.when(n > 3, place),
        }
    ).select(*counts, "w", "p", "place")
    p, place = F.col("p"), F.col("place")
    # A window is repeated if its neighbour in hash order has the same hash: first by the bits beside the position ...
    near = F.filter(
        p,
        lambda x, i: F.coalesce(_apart(x, place) == _apart(F.get(p, i - 1), place), F.lit(False))
        | F.coalesce(_apart(x, place) == _apart(F.get(p, i + 1), place), F.lit(False)),
    )
    t = t.select(*counts, "w", F.transform(near, lambda x: x.bitwiseAND(place).cast("int")).alias("near"))
    # ... then, among those, by all bits.
    whole = F.transform("near", lambda i: F.struct(_window_hash(F.col("w"), i).alias("h"), i.cast("long").alias("i")))
    t = t.select(*counts, F.sort_array(whole).alias("q"))
    q = F.col("q")
    twice = F.filter(
        q,
        lambda x, i: F.coalesce(x["h"] == F.get(q, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(q, i + 1)["h"], F.lit(False)),
    )
    t = t.select(*counts, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    at = F.col("at")
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    out = [F.col("row").getField(c).alias(c) for c in keep]
    return t.select(
        *out,
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.col("n_upper").cast("long").alias("n_upper"),
        F.col("n_bangs").cast("long").alias("n_bangs"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_distinct").cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Name -> graded vote over the statistics' columns: bad beyond one threshold, good within another, abstaining between."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / n
    variety = F.col("n_distinct") / n
    capitals = 2 * F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 80),
        "word_size": _vote((mean < 3) | (mean > 7), (mean >= 4) & (mean <= 6.5)),
        # The share of different words falls with the length of any text.
        "variety": _vote((variety < 0.3) & (n <= 2000), variety > 0.5),
        "symbols": _vote(F.col("n_symbols") / n > 0.1, F.col("n_symbols") / n <= 0.01),
        "repeats": _vote(F.col("n_repeat_words") / n > 0.3, F.col("n_repeat_words") / n <= 0.1),
        "lines": _vote(F.col("n_dup_lines") / lines > 0.3, F.col("n_dup_lines") / lines <= 0.1),
        "capitals": _vote(capitals > 0.2, capitals <= 0.05),
        "exclamations": _vote(F.col("n_bangs") / n > 0.1, F.col("n_bangs") / n <= 0.02),
    }


def _posterior(model: dict, names: list[str]) -> Column:
    """P(good | votes): each vote cast counts by its class-conditional probabilities; an abstention says nothing."""
    score = F.lit(log(model["prior"] / (1 - model["prior"])))
    for r in names:
        ratio = {v: log(model["good"][r][v] / model["bad"][r][v]) for v in (-1, 1)}
        score = score + F.when(F.col(r) == -1, F.lit(ratio[-1])).when(F.col(r) == 1, F.lit(ratio[1])).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def _estimate(sums: dict, names: list[str]) -> dict:
    """The model from a round's sums: ``docs``, ``good``, and per rule the bad and good votes of either class."""
    total, n_good = sums["docs"] or 0, sums["good"] or 0.0
    model = {"prior": (n_good + SMOOTHING) / (total + 2 * SMOOTHING), "good": {}, "bad": {}}
    for i, r in enumerate(names):
        votes = {(c, v): sums[f"s_{c}_{i}_{v + 1}"] or 0.0 for c in ("good", "bad") for v in (-1, 1)}
        cast_bad = votes["good", -1] + votes["bad", -1]
        for c, belief in (("good", 1 - BELIEF), ("bad", BELIEF)):
            bad = (votes[c, -1] + BELIEF_WEIGHT * belief * cast_bad) / (1 + BELIEF_WEIGHT) + SMOOTHING
            good = votes[c, 1] + SMOOTHING
            model[c][r] = {-1: bad / (bad + good), 1: good / (bad + good)}
    return model


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict:
    """The label model {prior, good, bad}: the share of good documents, and per class and rule the probabilities of a bad
    and a good vote among those cast, by EM over vote patterns.

    Round one starts from the share of good votes among a document's votes.
    Of each rule's bad votes, a part in proportion to ``BELIEF_WEIGHT`` is
    taken as right in ``BELIEF`` of the cases; nothing else is assumed. An
    empty table gives an uninformative model.
    """
    patterns = materialize(votes.groupBy(*names).agg(F.count("*").alias("docs")), "vote-patterns").coalesce(1)
    n_bad, n_good = (sum(((F.col(r) == v).cast("double") for r in names), F.lit(0.0)) for v in (-1, 1))
    good, model = (n_good + 1) / (n_good + n_bad + 2), None
    d, g = F.col("docs"), F.col("good")
    sums = [
        F.sum(d * w * (F.col(r) == v).cast("double")).alias(f"s_{c}_{i}_{v + 1}")
        for i, r in enumerate(names)
        for v in (-1, 1)
        for c, w in (("good", g), ("bad", 1 - g))
    ]
    for _ in range(rounds):
        row = patterns.withColumn("good", good).agg(F.sum(d).alias("docs"), F.sum(d * g).alias("good"), *sums).first().asDict()
        new = _estimate(row, names)
        moved = 1.0 if model is None else max(abs(new[c][r][v] - model[c][r][v]) for c in ("good", "bad") for r in names for v in (-1, 1))
        model, good = new, _posterior(new, names)
        if moved < 1e-4 or not row["docs"]:
            break
    return model


def judge(
    docs: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    keep_at: float = KEEP_AT,
    rounds: int = ROUNDS,
    votes: dict[str, Column] | None = None,
) -> DataFrame:
    """``keep`` columns, the statistics, base_failed, p_good, n_bad_votes and kept (false if base_failed, else p_good >= keep_at).

    ``votes`` are the rules, name -> vote over the statistics' columns (default: ``rules()``). Statistics and votes are
    written once (about 100 bytes a document) and read by the estimation and the verdict.
    """
    named = {f"vote_{k}": v for k, v in (rules() if votes is None else votes).items()}
    keep = docs.columns if keep is None else keep
    # Stored under positional names, so that a column named like a statistic can't clash.
    inner = docs.select(*[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)], text_or_empty(text_col).alias("text_"))
    s = statistics(inner, "text_", [f"keep_{i}" for i in range(len(keep))])
    s = materialize(s.withColumns({**named, "base_failed": base_failed()}), "quality-votes")
    model = fit(s.where(~F.col("base_failed")), list(named), rounds)
    n_bad = sum(((F.col(r) == -1).cast("long") for r in named), F.lit(0).cast("long"))
    s = s.withColumns({"p_good": _posterior(model, list(named)), "n_bad_votes": n_bad})
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return s.select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
        *stats,
        "base_failed",
        "p_good",
        "n_bad_votes",
        (~F.col("base_failed") & (F.col("p_good") >= keep_at)).alias("kept"),
    )


def filter_quality(docs: DataFrame, text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` without the rows judged bad.

    The rows are written once beside their votes, so that no text is shuffled and each row bears its own verdict.
    """
    columns = docs.columns
    renamed = docs.toDF(*[f"column_{i}" for i in range(len(columns))])  # no clash with the verdict's columns
    judged = judge(renamed, f"column_{columns.index(text_col)}", **parameters)
    return judged.where("kept").select(*[F.col(c).alias(n) for c, n in zip(renamed.columns, columns, strict=True)])
