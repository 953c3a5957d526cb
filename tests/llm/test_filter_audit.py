"""Filter interaction audit: against a plain simulation of all orders, and against SQL by the registered oracle."""

from __future__ import annotations

import numpy as np
import pytest

from cohortlens.llm import filter_audit as A
from cohortlens.llm import queries as Q
from tests.llm import brute as B
from tests.llm.conftest import EDGE, SF
from tests.oracle_check import compare, duck


def result(df):
    rows = [r.asDict() for r in df.collect()]
    out = {(r.pop("part"), r.pop("filter_order"), r.pop("step")): r for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_on_the_whole_table(spark, sf_docs):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in sf_docs.collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert result(Q.QUERIES["op13_filter_audit"](spark, SF)) == B.filter_audit(docs, labels)


def test_query_equals_its_sql(spark):
    r = compare(spark, "op13_filter_audit", SF, duck(SF))
    assert r["rows_match"] and r["cols_match"] and r["types_match"], r


def _docs(spark, rows, extra="digest string, mask string, n string, part string, t string, good string, `first` string"):
    names = [x.split()[0] for x in extra.split(", ")]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], f"doc_id bigint, text string, lang string, {extra}")


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(d, t, ("en", None, "", "de")[i % 4]) for i, (d, t) in enumerate(EDGE)]
    rows += [(50, long, "en"), (51, long, "de"), (50, long, "en"), (50, long, "fr"), (52, long, None), (None, long, "en"), (None, long, "en")]
    rows += [(53, long + " LOUD WORDS $" + "X" * 80, "en"), (54, long + " #", "en"), (55, "UP " * 300, "xx"), (56, long + " unlabelled", "en")]
    labels = [(50, 1, 0), (50, 0, 1), (51, 1, None), (52, None, 1), (53, 0, 1), (53, 0, 1), (None, 1, 1), (7, 1, 1), (99, 1, 1), (4, 2, 2)]
    docs = _docs(spark, rows).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = result(A.audit(docs, marks))
    assert got == B.filter_audit(rows, labels) and {k[0] for k in got} == {"", "en", "de", "fr", "xx"}
    assert A.audit(docs.limit(0), marks).count() == 0
    assert result(A.audit(docs, marks.limit(0))) == B.filter_audit(rows, [])


def test_removal_steps_are_the_least_position_of_a_failed_filter():
    for k in (1, 3, 5):
        orders, steps = A.removal_steps(k)
        assert steps.shape == (2**k, len(orders)) and len({tuple(o) for o in orders}) == len(orders)
        for m in range(2**k):
            for o, order in enumerate(orders):
                failed = [i + 1 for i, f in enumerate(order) if m >> f & 1]
                assert steps[m, o] == min(failed, default=k + 1)


def test_measures_fit_together():
    r = np.random.default_rng(3)
    weights = r.integers(0, 50, (3, 32))
    found = A.part_report(weights, 5)
    total = weights[0].sum()
    assert (found["kept"][:, -1] == weights[0, 0]).all() and (found["removed"].sum(axis=1) == total - weights[0, 0]).all()
    # Each filter's failures are removed by it or redundant, and its removals over all orders share out all removals.
    fails = found["removed"] + found["redundant"]
    for f in range(5):
        assert len(set(fails[found["filter"] == f])) == 1
    assert found["shapley"][0].sum() == 120 * (total - weights[0, 0])
    assert (found["good_lost"].sum(axis=1) == weights[1, 1:].sum()).all()


def test_other_filters(spark):
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 0, 2), ("p", 3, 2, 1, 1)], "part string, mask int, n bigint, good bigint, toxic bigint")
    got = result(A.interactions(masks, "XY"))
    assert len(got) == 4
    assert got["p", "YX", 1] == dict(kept=8, removed=2, redundant=0, unique_fails=0, good_lost=1, toxic_lost=1, shapley=2)
    assert got["p", "XY", 2] == dict(kept=5, removed=0, redundant=2, unique_fails=0, good_lost=0, toxic_lost=0, shapley=2)
    with pytest.raises(ValueError, match="filters"):
        A.interactions(masks, "ABCDEFGH")
