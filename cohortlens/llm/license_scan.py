"""License scan: short license notices found with a bounded number of edits.

Method: a text is put in word form (A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one space). A notice that may
have ``k`` edits is split into ``k + 1`` pieces; by the pigeonhole principle
one piece at least stands unchanged in every match, so an Aho-Corasick pass
over all pieces locates the candidates. Each candidate's surroundings are
verified by the regex library's bounded-error matching, which reports the span
and its edits. Each candidate is searched in a window of its own, so that notices
that stand side by side are all found; of overlapping alignments of a notice the
one of least edits counts. Exact phrases are looked up as consecutive words
besides.

Tasks work row by row on whole texts; nothing is shuffled.

Defined cases: a null or empty text has no words, no hits and score 0; ids of
any type, null and repeated ones included, pass through row by row; an empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The contract's exact phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices searched with edits, in word form, and their labels.
NOTICES = [
    ("all rights reserved", "reserved"),
    ("licensed under the apache license", "apache"),
    ("licensed under the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("creative commons attribution", "cc-by"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("released into the public domain", "public-domain"),
]
#: Edits allowed in a notice: one for so many of its characters.
CHARS_PER_EDIT = 10

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive pieces (offset, piece) of about equal length."""
    cut = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str]], chars_per_edit: int):
        self.phrases = [(f" {p} ", label) for p, label in phrases.items()]
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, label) in enumerate(notices):
            k = len(notice) // chars_per_edit
            match = regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}")
            self.notices.append((notice, label, k, match))
            for offset, piece in pieces(notice, k):
                seeds.setdefault(piece, []).append((n, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int]]]:
        """Number of words, exact hits (label, first word), fuzzy hits (label, first word, end word, edits)."""
        words = (text or b"").translate(_WORD_BYTES).split()
        if not words:
            return 0, [], []
        line = f" {b' '.join(words).decode('utf-8', 'replace')} "
        exact = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                exact.append((label, line.count(" ", 0, at)))
                at = line.find(phrase, at + 1)
        return len(words), exact, self.fuzzy(line)

    def fuzzy(self, line: str) -> list[tuple[str, int, int, int]]:
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (size, uses) in self.seeds.iter(line):
            for n, offset in uses:
                notice, _, k, _ = self.notices[n]
                a = max(0, end + 1 - size - offset - k)
                b = min(len(line), end + 1 - size - offset + len(notice) + k)
                windows.setdefault(n, set()).add((a, b))
        found = []
        for n, near in windows.items():
            _, label, _, match = self.notices[n]
            hits = set()
            ranges = list(near)
            while ranges:  # the best match of a window, then what is left on its two sides
                a, b = ranges.pop()
                m = match.search(line, a, b)
                if m:
                    hits.add((sum(m.fuzzy_counts), m.start(), m.end()))
                    ranges += [(a, m.start()), (m.end(), b)]
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(hits):  # of overlapping alignments the best
                i = bisect_left(taken, (a, b))
                if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                    taken.insert(i, (a, b))
                    first = line.count(" ", 0, a + (line[a] == " ")) - 1
                    inside = line[a:b].strip()
                    found.append((label, max(0, first), max(0, first) + inside.count(" ") + 1, edits))
        return sorted(set(found))


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    chars_per_edit: int = CHARS_PER_EDIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, n_words, exact, fuzzy, score) per row of ``docs``.

    ``exact``: (label, first word) of every place of a phrase; ``fuzzy``:
    (label, first word, end word, edits) of every bounded-error match of a
    notice; ``score``: 1 for an exact hit, else 1 / (1 + the least edits of a
    match), 0 without a hit.
    """

    def run(batches):
        scanner = Scanner(phrases, notices, chars_per_edit)
        for b in batches:
            got = [scanner.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([n for n, _, _ in got], pa.int64()),
                    pa.array([[{"label": x, "word": i} for x, i in e] for _, e, _ in got], _EXACT),
                    pa.array([[dict(zip(("label", "word", "to", "edits"), x, strict=True)) for x in f] for _, _, f in got], _FUZZY),
                ],
                ["doc", "n_words", "exact", "fuzzy"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc {kind}, n_words bigint, exact array<struct<label:string,word:bigint>>, "
        "fuzzy array<struct<label:string,word:bigint,to:bigint,edits:bigint>>"
    )
    out = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, schema)
    best = F.array_min(F.transform("fuzzy", lambda x: x["edits"]))
    score = F.when(F.size("exact") > 0, 1.0).when(F.size("fuzzy") > 0, F.lit(1.0) / (1 + best)).otherwise(0.0)
    return out.withColumn("score", score)


_EXACT = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_FUZZY = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("to", pa.int64()), ("edits", pa.int64())]))
