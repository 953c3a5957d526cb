"""Personal data: exact rules for a few kinds, and identifiers found by bootstrapped contexts.

Method: rule matches are the seed entities. The words around every mention (a
seed; any other token with a digit or an at sign, of any length; the longest
runs of such words, with or without words of capitals, joined by one blank or
hyphen; an address spelt with "at" and "dot") are its lexical patterns. Spark scores the graph of patterns and instances in rounds: a
pattern's confidence for a kind is the score of that kind among its distinct
instances, an instance's score comes from the patterns it stands in, seeds
keep score 1. Instances of high score count as support in the next round, so
that every round reaches contexts around found instances. Patterns of high
confidence and support then mark their other mentions, instances of high score
all theirs: identifiers that no rule knows. Whatever they are, they get the kind
``identifier``; seeds keep theirs.

A rule need not know all of its kind. Where only a share of a kind's members
are seeds, a pattern is expected to stand around many more mentions than seeds,
and each of the others speaks against it by that share only.

The texts are read once; what is kept of them, spans and mentions of texts
that have any, is written to the shared folder. The graph holds hashes only,
its tables are pre-aggregated before each shuffle, and a frequent pattern's
join can be split.

Defined cases: a null or empty text has no spans; rows repeating id and text
get the same spans each; a null id is like any other value; an empty table
gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, text_or_empty

# Fixed order of the contract's kinds; kinds of the method follow.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
IDENTIFIER = "identifier"
ROUNDS = 3
#: A pattern marks new mentions from this confidence on, if it stands around so many different seeds or found
#: instances; an instance is found from the same score on.
MIN_CONFIDENCE = 0.8
MIN_SUPPORT = 5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"\S+")
#: A word with a digit, or one of capital letters.
_GROUP = re.compile(r"(?<![^\W_])(?:[A-Z]++(?![^\W_])|[^\W0-9_]*+[0-9][^\W_]*+)")
_SPELT = re.compile(r"(?<!\S)\S+[\x20][(\[]?at[)\]]?[\x20][\w-]+(?:[\x20][(\[]?dot[)\]]?[\x20][\w-]+)+", re.I)
_DOT = re.compile(r"[\x20(\[]dot[)\]\x20]", re.I)
_CONTEXT = re.compile(r"\w+|[^\w\s]")
_CONTEXT_CHARS = 80


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from the at signs outwards, so that a long word costs no repeated scans."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules' matches, by kind in their order, then by start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _patterns(text: str, a: int, b: int) -> list[str]:
    """The mention's lexical patterns: two tokens before it; one before and one behind it. Digits count as one class."""
    before = [re.sub("[0-9]", "0", x.lower()) for x in _CONTEXT.findall(text[max(0, a - _CONTEXT_CHARS) : a])]
    behind = _CONTEXT.search(text, b, b + _CONTEXT_CHARS)
    right = re.sub("[0-9]", "0", behind[0].lower()) if behind else "$"
    left = before[-2:] or ["^"]
    return [f"{' '.join(left)} _", f"{left[-1]} _ {right}"]


def _runs(text: str) -> list[tuple[int, int]]:
    """Longest runs of groups joined by one blank or hyphen: of groups with a digit; with the capitals between, one beside and all around them."""
    found: list[tuple[int, int]] = []
    chain: list[tuple[int, int, bool]] = []

    def close() -> None:
        digits: list[tuple[int, int]] = []
        for a, b, digit in [*chain, (0, 0, False)]:
            if digit:
                digits.append((a, b))
                continue
            if len(digits) > 1:
                found.append((digits[0][0], digits[-1][1]))
            digits = []
        at = [i for i, (_, _, digit) in enumerate(chain) if digit]
        if at and len(chain) > 1:
            near = max(0, at[0] - 1), min(len(chain), at[-1] + 2) - 1
            found.extend((chain[i][0], chain[j][1]) for i, j in ((at[0], at[-1]), near, (0, len(chain) - 1)))

    for m in _GROUP.finditer(text):
        a, b = m.span()
        if chain and not (a == chain[-1][1] + 1 and text[a - 1] in " -"):
            close()
            chain = []
        chain.append((a, b, bool(_DIGIT.search(m[0]))))
    close()
    return found


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


def mentions(text: str, spans: list[tuple[str, int, int]], secret_seeds: int = 1) -> list[dict]:
    """Seeds (of the strings of the ``secret`` rule one in ``secret_seeds``, by their hash), other tokens with a digit or an at sign, runs of groups, addresses in words: place, kind (null if not a seed), instance and pattern hashes."""
    spelt = _DOT.search(text)
    digit = _DIGIT.search(text)
    if not spans and not digit and "@" not in text and not spelt:
        return []
    seeds = spans + [(SECRET, *m.span()) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[0]) and _hash(m[0]) % secret_seeds == 0]
    taken = sorted((a, b) for _, a, b in seeds)
    other = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        if not ("@" in token or _DIGIT.search(token)):
            continue
        a, b = m.span()
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            other.append((a, b))
    if digit:
        # Seeds end a run.
        at = 0
        for a, b in [*taken, (len(text), len(text))]:
            if at < a:
                other += [(at + x, at + y) for x, y in _runs(text[at:a])]
            at = max(at, b)
    if spelt:
        other += [m.span() for m in _SPELT.finditer(text)]
    places = [(kind, a, b) for kind, a, b in seeds]
    i = 0
    for a, b in sorted(set(other)):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            places.append((None, a, b))
    return [
        {"kind": kind, "s": a, "e": b, "inst": _hash(text[a:b].lower()), "pats": [_hash(p) for p in dict.fromkeys(_patterns(text, a, b))]}
        for kind, a, b in places
    ]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))
_MENTIONS = pa.list_(
    pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("inst", pa.int64()), ("pats", pa.list_(pa.int64()))])
)


def _read(batches, secret_seeds: int):
    for b in batches:
        spans, found = [], []
        for t in b.column(2).to_pylist():
            s = rule_spans(t)
            spans.append([dict(zip(("kind", "s", "e"), x, strict=True)) for x in s])
            found.append(mentions(t, s, secret_seeds))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _SPANS), pa.array(found, _MENTIONS)], ["doc", "th", "base", "mentions"])


def bootstrap(
    mention: DataFrame,
    rounds: int = ROUNDS,
    min_confidence: float = MIN_CONFIDENCE,
    min_support: int = MIN_SUPPORT,
    seed_share: dict[str, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(pat, kind, confidence, support) and (inst, kind, score) from the mentions (kind, inst, pat), by rounds over their graph.

    ``seed_share``: the share of a kind's members that its rule makes seeds (1 where not named).
    """
    kinds = (*KINDS, SECRET)
    edges = materialize(mention.groupBy("pat", "inst").agg(F.max("kind").alias("kind")), "pii-edges")
    seeds = materialize(edges.where(F.col("kind").isNotNull()).select("inst", "kind", F.lit(1.0).alias("score"), F.lit(True).alias("seed")).distinct(), "pii-seeds")
    # A pattern around fewer instances than the support can never reach it, in no round.
    size = edges.groupBy("pat").agg(F.count("*").alias("n"), F.count("kind").alias("n_seeds")).where(F.col("n") >= min_support)
    size = materialize(size, "pii-size")
    share = F.lit(1.0)
    for k, v in (seed_share or {}).items():
        share = F.when(F.col("kind") == k, F.lit(v)).otherwise(share)
    edges = materialize(edges.select("pat", "inst").join(size.select("pat"), "pat"), "pii-graph")
    free = materialize(edges.join(seeds.select("inst"), "inst", "left_anti"), "pii-free")
    scores = seeds
    for _ in range(rounds):
        # Support: seeds, and instances that an earlier round found.
        total = edges.join(scores, "inst").groupBy("pat", "kind")
        total = total.agg(
            F.sum("score").alias("score"), F.count_if(F.col("score") >= min_confidence).alias("support"), F.count_if("seed").alias("own_seeds")
        )
        # Against a pattern speak other kinds' seeds and, by the seeds' share, what no round has found (of found ones, the rest
        # of their score). One instance without a score is added, so that few instances never make a sure pattern.
        unknown = F.col("n") - F.col("n_seeds") - (F.col("score") - F.col("own_seeds"))
        against = F.col("n_seeds") - F.col("own_seeds") + share * unknown + 1
        confidence = materialize(
            total.join(size, "pat").select("pat", "kind", (F.col("score") / (F.col("score") + against)).alias("confidence"), "support"), "pii-confidence"
        )
        supported = confidence.groupBy("pat").agg(
            *[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("confidence"))), F.lit(0.0)).alias(k) for k in kinds], F.sum("support").alias("support")
        )
        # An instance that mostly stands in supported patterns of low confidence, as common numbers do, is scored down.
        reached = (
            free.join(supported.where(F.col("support") >= min_support), "pat")
            .groupBy("inst")
            .agg(
                F.array(
                    *[
                        F.struct(F.lit(k).alias("kind"), ((1 - F.exp(F.sum(F.log(1 - F.col(k))))) * F.least(F.lit(1.0), 2 * F.avg(k))).alias("score"))
                        for k in kinds
                    ]
                ).alias("found")
            )
            .select("inst", F.inline("found"), F.lit(False).alias("seed"))
        )
        scores = materialize(seeds.unionByName(reached.where(F.col("score") >= 0.5)), "pii-scores")
    return confidence, scores


def find(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    min_confidence: float = MIN_CONFIDENCE,
    min_support: int = MIN_SUPPORT,
    secret_seeds: int = 1,
) -> DataFrame:
    """(doc, base, added) per row of ``docs``: arrays of (kind, s, e), the rules' spans and those the method adds.

    Added are the seeds of the ``secret`` rule (one in ``secret_seeds`` of its
    strings; the others are left to the patterns) and the mentions marked by
    patterns, of kind ``identifier``; neither touches a base span.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    schema = (
        f"doc {kind}, th bigint, base array<struct<kind:string,s:bigint,e:bigint>>, "
        "mentions array<struct<kind:string,s:bigint,e:bigint,inst:bigint,pats:array<bigint>>>"
    )
    read = materialize(
        docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(
            lambda batches: _read(batches, secret_seeds), schema
        ),
        "pii-read",
    )
    places = read.select("doc", "th", F.explode("mentions").alias("m")).select("doc", "th", "m.kind", "m.s", "m.e", "m.inst", F.explode("m.pats").alias("pat"))
    confidence, scores = bootstrap(places.select("kind", "inst", "pat"), rounds, min_confidence, min_support, {SECRET: 1 / secret_seeds})
    confident = confidence.where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)).select("pat").distinct()
    confident = materialize(confident, "pii-confident")
    accepted = materialize(scores.where(F.col("score") >= min_confidence).select("inst").distinct(), "pii-accepted")
    free = places.where(F.col("kind").isNull())
    marked = free.join(confident, "pat").unionByName(free.join(accepted, "inst")).select("doc", "th", F.lit(IDENTIFIER).alias("kind"), "s", "e")
    secret = read.select("doc", "th", F.explode(F.filter("mentions", lambda m: m["kind"] == SECRET)).alias("m")).select("doc", "th", "m.kind", "m.s", "m.e")
    added = (
        marked.unionByName(secret)
        .groupBy("doc", "th", "s", "e")
        .agg(F.max("kind").alias("kind"))  # a seed keeps its own
        # A span inside a longer one is left to that one.
        .withColumn("to", F.max("e").over(Window.partitionBy("doc", "th").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.col("to").isNull() | (F.col("e") > F.col("to")))
        .groupBy("doc", "th")
        .agg(F.collect_set(F.struct("kind", "s", "e")).alias("added"))
    )
    r, a = read.alias("r"), materialize(added, "pii-added").alias("a")
    on = F.col("r.doc").eqNullSafe(F.col("a.doc")) & (F.col("r.th") == F.col("a.th"))
    none = F.array().cast("array<struct<kind:string,s:bigint,e:bigint>>")
    return r.join(a, on, "left").select("r.doc", "r.base", F.coalesce("a.added", none).alias("added"))
