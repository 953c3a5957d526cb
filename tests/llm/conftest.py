from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"

#: Extra columns under names that the operators use inside.
EXTRA = "keys string, kept string, d string, doc string, w string, t string, th string, n string, at string, `row` string, p string, items string, hash string, component string, h string, k string"


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with null and clashing extra columns."""

    def make(rows, extra: bool = True):
        names = [x.strip().split()[0].strip("`") for x in EXTRA.split(",")] if extra else []
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + (f", {EXTRA}" if extra else "")
        data = [(i, t, None, "s", None, *(["x"] * len(names))) for i, t in rows]
        return spark.createDataFrame(data, schema)

    return make


#: Nulls, empty and blank texts, repeated rows and ids, ties, a long text, odd characters.
EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n \n"),
    (4, "one two three four five"),
    (4, "one two three four five"),
    (5, "one two three four five"),
    (5, "another text under the same id"),
    (None, "a null id with a text of its own"),
    (None, None),
    (6, "ÀÉ Straße x y \U0001f600 <|endoftext|> 'll we've   \n\n tabs\tand\x1fcontrols"),
    (7, "word " * 20_000),
    (8, "=" * 3_000 + "a" * 3_001),
    (-9, "negative id"),
]
