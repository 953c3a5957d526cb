"""Spelling variants: the whole query against plain Python, the parts of the method, defined cases."""

from __future__ import annotations

import random

import pytest

from cohortlens.llm import queries as Q
from cohortlens.llm import spelling as S
from tests.llm import brute as B
from tests.llm.conftest import EDGE, SF

COLUMNS = ["form", "root", "n", "n_near", "form_n"]


def result(df):
    rows = [r.asDict() for r in df.collect()]
    out = {r["word"]: {c: r[c] for c in COLUMNS} for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_on_the_whole_table(spark, sf_docs):
    words = B.spelling_words([(r["doc_id"], r["text"]) for r in sf_docs.collect()])
    got = result(Q.QUERIES["op11_spelling"](spark, SF))
    assert got == B.spelling(words) and any(r["form"] for r in got.values())


def _vocabulary(seed: int, letters: str, n: int) -> dict[str, int]:
    r = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(r.choice(letters) for _ in range(r.choice((5, 5, 6, 7, 9, 14))))
        for _ in range(3):  # variants by edits at any place, ends included
            out[w] = r.randint(3, 400)
            i = r.randint(0, len(w))
            w = r.choice((w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]))
            w = w if len(w) >= 5 else w + "aaaaa"
    return out


@pytest.mark.parametrize(("seed", "letters", "rare"), [(1, "ab", 0), (2, "abc", 3), (3, "aé", 10), (4, "abcdefgh", 1), (5, "ab", 10**9)])
def test_near_pairs_are_all_found_once_at_any_pruning(spark, seed, letters, rare):
    words = _vocabulary(seed, letters, 900)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    got = [(r["word"], r["near"], r["n"], r["near_n"]) for r in S.near_pairs(df, rare).collect()]
    listed = sorted(words)
    expected = {frozenset((a, b)) for i, a in enumerate(listed) for b in listed[:i] if abs(len(a) - len(b)) < 2 and B.one_edit(a, b)}
    assert len(got) == len(expected) and {frozenset(p[:2]) for p in got} == expected
    assert all(words[a] == n and words[b] == m for a, b, n, m in got)


def test_grams_grow_while_frequent_and_depend_on_their_side_alone():
    frequent = frozenset(["an", "ana", "na", "nan", "ba", "^b", "^ba", "na$"])
    assert S.right_gram("^banana$", 6, frequent) == "ban" and S.right_gram("^banana$", 5, frequent) == "anan"
    assert S.right_gram("^banana$", 2, frequent) == "na$"  # grows to the mark
    assert S.left_gram("^banana$", 2, frequent) == "^ba" and S.left_gram("^banana$", 4, frequent) == "bana"
    assert S.right_gram("^cabanana$", 5, frequent) == S.right_gram("^banana$", 5, frequent)


def test_an_edit_leaves_the_grams_that_the_bound_says():
    r = random.Random(7)
    for _ in range(500):
        w = "".join(r.choice("abc") for _ in range(r.randint(5, 20)))
        frequent = frozenset("".join(r.choice("abc^$") for _ in range(r.randint(2, 6))) for _ in range(200))
        i, c = r.randint(0, len(w)), r.choice("abc")
        cuts = S.cuts(len(w))
        assert len(cuts) == S.PIECES - 1 and cuts == sorted(set(cuts)) and 0 < cuts[0] and cuts[-1] < len(w)
        for other in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :] if i < len(w) else w):
            if other != w and B.one_edit(w, other):
                first = next((k for k, (a, b) in enumerate(zip(w, other, strict=False)) if a != b), len(w))
                piece = sum(x <= first for x in cuts)
                assert S.merge_keys(w, len(w), frequent)[piece] == S.merge_keys(other, len(w), frequent)[piece]
        for piece in range(len(cuts) + 1):
            left, right = S.affected(len(cuts), piece)
            assert len(left) + len(right) == len(cuts)  # of twice as many grams


def test_the_dictionary_is_pruned_and_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(f"pre{i:04d}".translate({48 + k: 97 + k for k in range(10)}), 3) for i in range(500)], "word string, n bigint")
    grams = S.frequent_grams(df, 100)
    assert {"^p", "^pre", "re", "rea"} <= set(grams) and all(len(g) <= S.QMAX for g in grams) and "apr" not in grams
    monkeypatch.setattr(S, "MAX_GRAMS", 10)  # more than a tenth of all places
    assert len(S.frequent_grams(df, 1)) <= 10 * (S.QMAX - S.QMIN + 1)


def test_forms_and_roots(spark, frame):
    n = {"color": 3, "colour": 6, "colours": 12, "colourss": 24, "dolor": 6, "house": 5, "mouse": 5, "lonely": 9}
    docs = frame([(i, " ".join(w for w, k in n.items() for _ in range(k))) for i in (1,)])
    words = B.spelling_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = result(S.variants(docs))
    assert got == B.spelling(words)
    assert got["color"]["root"] == "colourss" and got["color"]["form"] == "colour"  # a tie with dolor goes to the lesser word
    assert got["house"] == {"form": None, "root": "house", "n": 5, "n_near": 1, "form_n": None} and got["lonely"]["n_near"] == 0


def test_long_chains_of_forms(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(37)]
    ends = S.roots(spark.createDataFrame(chain, "word string, form string"))
    assert {(r["word"], r["root"]) for r in ends.collect()} == {(w, "w037") for w, _ in chain}
    assert S.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_edge_rows(frame):
    rows = EDGE + [(9, "ÀÉçwörd ÀÉçwörd àéçwörd STRASSE strasse straße xStraßex" * 3), (None, "Étude étude ETUDE " * 9), (10, "ab×÷cd " * 5)]
    long = "ab" * 1_500
    rows += [(i, f"{long}a and {long} {long}c") for i in range(40, 44)]
    assert result(S.variants(frame(rows))) == B.spelling(B.spelling_words(rows))
    assert S.variants(frame([])).count() == 0 and S.variants(frame([(1, "once")])).count() == 0
