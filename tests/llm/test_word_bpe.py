"""BPE with word ends against the tokenizers library; the parts of the method; defined cases."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from cohortlens.llm import queries as Q
from cohortlens.llm import word_bpe as W
from tests.llm import brute as B
from tests.llm.conftest import EDGE, SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def test_query_on_the_whole_table(spark, sf_docs, library):
    got = {r["doc_id"]: r for r in Q.QUERIES["op12_word_bpe"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in sf_docs.collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert tuple(got[d])[1:] == (len(ids), B.sha(np.array(ids, "<u4").tobytes()), hashlib.sha256(decoded).hexdigest()), d


PARTS = "a b e t h in the ing aa aaa zz !! ... - é İ K Å Σ αΣ 'S 'll ' 1 23 \U0001f600 ̈ é 中文 ‍ = </w> < ha ß ẞ Ⱥ ǅ".split(" ")
PARTS += [" ", "\n\t", "\x85", "\x1c", "\xa0", "　", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|"]


def _random_texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, 40))) for _ in range(n)]


def same(tok, library, texts):
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        got = tok.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t[:100]
        assert tok.decode(got).decode() == library.decode(ids, skip_special_tokens=False), t[:100]


def test_odd_texts(library):
    same(W.tokenizer(PATH), library, _random_texts(1, 4_000))


def test_repeated_and_long_words(library):
    r = random.Random(2)
    texts = [c * n for c in ("a", "!", "ha", "ab", "=") for n in range(1, 80)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)), "x" * 200_000, "lol" * 60_000]
    same(W.tokenizer(PATH), library, texts)


def test_long_odd_texts_are_cut_at_blanks(library, monkeypatch):
    monkeypatch.setattr(W, "ODD_CHARS", 64)
    monkeypatch.setattr(W, "WORDS_AT_ONCE", 5)
    tok = W.Tokenizer(PATH)
    same(tok, library, [" ".join(_random_texts(s, 5)) + " 中" for s in range(20)] + ["中" * 500 + " é ̈x"])


def test_small_caches_give_the_same(library, monkeypatch):
    monkeypatch.setattr(W, "CACHE_WORDS", 3)
    monkeypatch.setattr(W, "PAIRS", 2)
    monkeypatch.setattr(W, "CACHE_CHARS", 4)
    monkeypatch.setattr(W, "IDS_AT_ONCE", 3)
    same(W.Tokenizer(PATH), library, _random_texts(3, 100))


def _toy(tmp_path, merges: list[tuple[str, str]], suffix: str | None, name: str = "toy.json") -> str:
    chars = list(W.byte_alphabet())
    names = chars + [c + suffix for c in chars if suffix] + ["".join(m) for m in merges]
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["added_tokens"] = []
    spec["model"] |= {"vocab": {t: i for i, t in enumerate(names)}, "merges": [list(m) for m in merges], "end_of_word_suffix": suffix}
    path = tmp_path / name
    path.write_text(json.dumps(spec), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("seed", range(25))
def test_random_merge_tables(tmp_path, seed):
    """Tables with unreachable tokens, ties and overlapping runs."""
    r = random.Random(seed)
    suffix = "</w>" if seed % 3 else None
    inner, last, merges = ["a", "b", "c"], [x + (suffix or "") for x in "abc"], []
    for _ in range(r.randint(3, 40)):
        m = (r.choice(inner), r.choice(inner + last))
        if "".join(m) not in {*inner, *last}:
            merges.append(m)
            (last if suffix and m[1] in last else inner).append("".join(m))
    path = _toy(tmp_path, merges, suffix)
    lib, tok = Library.from_file(path), W.Tokenizer(path)
    same(tok, lib, ["".join(r.choice("abc") for _ in range(r.randint(1, 24))) for _ in range(400)] + ["a" * n for n in range(1, 40)])


def test_files_that_the_method_cannot_take(tmp_path):
    with pytest.raises(ValueError, match="merge 0"):
        W.Tokenizer(_toy(tmp_path, [("ab", "c"), ("a", "b")], None))
    with pytest.raises(ValueError, match="twice"):
        W.Tokenizer(_toy(tmp_path, [("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "c")], None))
    with pytest.raises(ValueError, match="plain BPE"):
        W.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_longest_matches_and_pairs():
    tok = W.tokenizer(PATH).words
    name = {a: t for t, a in tok.merges.atoms.items()}
    word = "thething"
    atoms = word[:-1] + chr(256 + ord("g"))
    for i, t in enumerate(tok.longest(atoms)):
        best = max((atoms[i:j] for j in range(i + 1, len(atoms) + 1) if atoms[i:j] in name), key=len)
        assert tok.merges.atoms[t] == best
    th, e_end, the_end = name["th"], name[chr(256 + ord("e"))], name["th" + chr(256 + ord("e"))]
    assert not tok.compatible(th, e_end) and tok.merges.made[th, e_end] == tok.merges.rank[the_end]


def test_edge_rows(frame, library):
    rows = EDGE + [(11, "<|endoftext|><|startoftext|> x"), (12, "The the THE"), (12, "The the THE")]
    got = sorted(((r["doc"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in W.encode(frame(rows), PATH).collect()), key=repr)
    expected = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((d, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected, key=repr)
    encoded = W.encode(frame(rows), PATH, with_text=False)
    assert encoded.columns == ["doc", "n_tokens", "ids"]
    assert sorted((repr(r["doc"]), r["decoded"]) for r in W.decode(encoded, PATH).collect()) == sorted((repr(d), t) for d, _, _, t in got)
    assert W.encode(frame([]), PATH).count() == 0 and W.decode(encoded.limit(0), PATH).count() == 0


def test_decoding_nulls_and_unknown_ids(spark):
    rows = [(1, None), (2, b""), (3, np.array([320, 999_999, 320], "<u4").tobytes())]
    got = {r["doc"]: r["decoded"] for r in W.decode(spark.createDataFrame(rows, "doc int, ids binary"), PATH).collect()}
    name = Library.from_file(PATH).id_to_token(320)
    assert got == {1: "", 2: "", 3: f"{name} {name}"}
