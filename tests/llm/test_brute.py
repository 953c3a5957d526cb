"""Each query over a whole small table against the plain-Python statement of its contract."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from cohortlens.llm import queries as Q
from tests.llm import brute as B
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def rows(sf_docs):
    return [(r["doc_id"], r["text"]) for r in sf_docs.select("doc_id", "text").collect()]


def run(spark, name):
    return {r["doc_id"]: r.asDict() for r in Q.QUERIES[name](spark, SF).collect()}


def same(got, expected, columns):
    assert got.keys() == expected.keys()
    for d, e in expected.items():
        assert {c: got[d][c] for c in columns} == {c: e[c] for c in columns}, d


def test_license_scan(spark, rows):
    got = run(spark, "op1_license_scan")
    same(got, {d: B.licenses_base(t) for d, t in rows}, ["n_words", "n_base", "first_word", "last_word", "base_labels"])
    for r in got.values():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_quality_rules(spark, rows):
    got = run(spark, "op2_quality_rules")
    same(got, {d: B.quality_stats(t) for d, t in rows}, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert {d for d, r in got.items() if r["kept"]} == B.quality_kept(rows)
    assert not any(r["kept"] and r["base_failed"] for r in got.values())


def test_packed_ids(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, at = {}, 0
    for d, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        expected[d] = dict(start=at, n_tokens=len(ids), ids_crc32=B.crc_of(ids))
        at += len(ids)
    same(run(spark, "op3_bitpack"), expected, ["start", "n_tokens", "ids_crc32"])


def test_bpe(spark, rows):
    import public_tokenizers
    import tiktoken

    from cohortlens.llm.bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        expected[d] = dict(
            n_tokens=len(ids), ids_sha256=B.sha(np.array(ids, "<u4").tobytes()), decoded_sha256=hashlib.sha256((t or "").encode()).hexdigest()
        )
    same(run(spark, "op4_bpe"), expected, ["n_tokens", "ids_sha256", "decoded_sha256"])


def test_suffix_dedup(spark, rows):
    got = run(spark, "op5_suffix_dedup")
    same(got, B.suffix_repeats(rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert all(r["has_repeat"] == (r["n_removed"] > 0) for r in got.values())


def test_pii(spark, rows):
    got = run(spark, "op6_pii")
    expected = {d: B.pii_base(t) for d, t in rows}
    same(got, expected, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    for d, e in expected.items():
        assert set(filter(None, e["base"].split(","))) <= set(got[d]["spans"].split(","))


def test_html(spark):
    """On pages whose main text is their article element: its blocks, by a plain split of the markup."""
    import re
    from html import unescape

    got = {r["page_id"]: r for r in Q.QUERIES["op7_html_extract"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        text = "\n".join(x for x in blocks if x)
        assert got[p["page_id"]]["text"] == text and got[p["page_id"]]["n_chars"] == len(text)


def test_line_dedup(spark, rows):
    same(run(spark, "op8_line_dedup"), B.line_dedup(rows), ["n_lines", "n_dropped", "kept_sha256"])


def test_decontamination(spark, rows):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    same(run(spark, "op9_decontamination"), B.decontam(rows, bench), ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def test_simhash(spark, rows):
    fps = {d: B.simhash_fp(t) for d, t in rows}
    comp = B.components(fps)
    same(run(spark, "op10_simhash"), {d: dict(fingerprint=f"{f:016x}", component_id=comp[d]) for d, f in fps.items()}, ["fingerprint", "component_id"])


@pytest.mark.parametrize("name", ["op8_line_dedup", "op9_decontamination"])
def test_oracle_sql(spark, name):
    from tests.oracle_check import compare

    result = compare(spark, name, SF)
    assert result["cols_match"] and result["rows_match"], result


def test_pipeline(spark, rows):
    """The stages one after another, each against its brute-force version on what its predecessor kept."""
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from cohortlens.llm.bpe import read_ranks

    result = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = B.quality_kept(rows)
    docs = [(d, t) for d, t in rows if d in kept]
    lines = B.line_dedup(docs)
    docs = [(d, lines[d]["kept"]) for d, _ in docs]
    comp = B.components({d: B.simhash_fp(t) for d, t in docs})
    docs = [(d, t) for d, t in docs if comp[d] == d]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = B.decontam(docs, bench)
    docs = {d: t for d, t in docs if not dirty[d]["contaminated"]}
    assert result.keys() == docs.keys()
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, t in docs.items():
        ids = enc.encode_ordinary(t)
        assert result[d]["n_tokens"] == len(ids) and result[d]["ids_sha256"] == B.sha(np.array(ids, "<u4").tobytes())
        assert result[d]["decoded_sha256"] == B.sha(t.encode())
