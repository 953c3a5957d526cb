"""BPE with word ends: a backtracking encoder over Aho-Corasick longest matches, and decoding by an offset table.

Method: a word is encoded by walking over it with the longest vocabulary token
at each place; two tokens may stand side by side only if the merges of their
joined text give exactly these two. Where the longest token does not fit the
one before, the next shorter prefix token is tried, and where none fits, the
last token is taken back and its end is marked dead. A text has one sequence of
pairwise compatible tokens, and it is what the merges in order of rank give, so
the walk is exact; as every place is marked dead at most once, its time is
linear in the word's length.

* Longest matches: one Aho-Corasick automaton of the *reversed* tokens reads
  the word backwards; the first match it reports at a place is the longest
  token that starts there.
* Compatibility: a table of token pairs, filled on demand from the merge tree
  (the pieces along the two tokens' common border, in order of their ranks).
* Decoding: all token strings stand in one buffer; a table of offsets gives each
  id's slice, and numpy gathers the slices of many ids at once.

Requirements on the file, checked on load (ValueError otherwise): a BPE model
without dropout, prefix, unknown token or byte fallback, byte-level
pre-tokenizer, no post-processor and no decoder, plain added tokens, every token
made by one merge, and no merge before the merges that make its parts.

Truncation and padding of the file are not used. Added tokens' strings in a
text get the added token's id, as in the library's plain ``encode``.

Memory of a worker: one Arrow batch, the texts and results of ``BATCH_BYTES`` of
it (of one text, if that is longer), ``WORDS_AT_ONCE`` words of a text, at most
``CACHE_WORDS`` cached words of up to ``CACHE_CHARS`` characters and
``PAIRS`` pairs. Of a text with characters beyond U+024F, ``ODD_CHARS`` at a time go
through the library's normalizer (cut before a blank, where no composition and
no word can cross; a longer run without a blank goes as a whole).

Defined cases: a null or empty text has no ids and decodes to the empty text;
ids of any type, null and repeated ones included, pass through row by row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import slices
from cohortlens.llm.narrow import ODD, narrow

BATCH_BYTES = 1 << 22
WORDS_AT_ONCE = 200_000
CACHE_WORDS = 300_000
CACHE_CHARS = 40
PAIRS = 500_000
ODD_CHARS = 1 << 18
IDS_AT_ONCE = 1 << 17

NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for a byte in byte-level vocabularies -> the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The merge tree: per token its parts and rank, its atoms, and which tokens may stand side by side.

    An atom is a byte inside a word (character 0 to 255 here) or a word's last byte (256 more).
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.left, self.right, self.rank, self.atoms, self.made = {}, {}, {}, {}, {}
        for c, b in byte_alphabet().items():
            for name, atom in {c: chr(b), c + suffix: chr(256 * bool(suffix) + b)}.items():
                if name in vocab:
                    self.atoms[vocab[name]], self.rank[vocab[name]] = atom, -1
        if len(self.atoms) != (512 if suffix else 256):
            raise ValueError("the vocabulary lacks bytes")
        for rank, (a, b) in enumerate(merges):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if t in self.rank or x not in self.rank or y not in self.rank:
                raise ValueError(f"merge {rank} makes a token twice or uses parts that no earlier merge makes")
            self.left[t], self.right[t], self.rank[t] = x, y, rank
            self.atoms[t], self.made[x, y] = self.atoms[x] + self.atoms[y], rank
        # A token whose own text merges to something else never occurs.
        self.alive = set()
        for t in self.rank:  # parts come before what they make
            x, y = self.left.get(t), self.right.get(t)
            if x is None or (x in self.alive and y in self.alive and self.fit(x, y, self.rank[t])):
                self.alive.add(t)

    def fit(self, x: int, y: int, before: int = NEVER) -> bool:
        """Whether the merges of rank under ``before``, on the text of ``x`` and ``y``, leave these two tokens.

        Only the pieces at the border matter: the right ends inside ``x`` and the
        left ends inside ``y``. A piece lasts until its parent is made. A merge
        across the border happens if both pieces last until its rank; of merges of
        one rank the leftmost comes first, so it beats the parent of the right
        piece and loses against the parent of the left one.
        """
        ends, begins = self._border(x, self.right, before), self._border(y, self.left, before)
        i, j = len(ends) - 1, len(begins) - 1
        while True:
            (a, last_a), (b, last_b) = ends[i], begins[j]
            across = self.made.get((a, b), NEVER)
            if across < last_a and across <= last_b and across < before:
                return False
            if i == 0 and j == 0:
                return True
            if j == 0 or (i and last_a <= last_b):
                i -= 1
            else:
                j -= 1

    def _border(self, token: int, side: dict[int, int], before: int) -> list[tuple[int, int]]:
        out = [(token, before)]
        while (part := side.get(token)) is not None:
            out.append((part, self.rank[token]))
            token = part
        return out


class WordEncoder:
    """Encodes words by backtracking over longest matches; keeps a bounded cache of words and of pairs."""

    def __init__(self, merges: Merges):
        self.merges = merges
        size = max(merges.atoms) + 1
        token_of = {merges.atoms[t]: t for t in merges.alive}
        self.length, self.shorter = [0] * size, [-1] * size
        self.automaton = ahocorasick.Automaton()
        for atoms, t in token_of.items():
            self.length[t] = len(atoms)
            self.shorter[t] = next((token_of[atoms[:n]] for n in range(len(atoms) - 1, 0, -1) if atoms[:n] in token_of), -1)
            self.automaton.add_word(atoms[::-1], t)
        self.automaton.make_automaton()
        self.marked = 256 * any(ord(a[-1]) > 255 for a in token_of)
        self.size = size
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def compatible(self, x: int, y: int) -> bool:
        key = x * self.size + y
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            fits = self.pairs[key] = self.merges.fit(x, y)
        return fits

    def longest(self, atoms: str) -> array:
        """The longest token that starts at each place."""
        at = array("i", bytes(4 * len(atoms)))
        last, before = len(atoms) - 1, -1
        for end, token in self.automaton.iter(atoms[::-1]):
            if end != before:
                at[last - end] = token
                before = end
        return at

    def encode(self, word: str) -> array:
        text = word.encode().decode("latin-1")
        text = text[:-1] + chr(ord(text[-1]) + self.marked)
        longest, length, shorter = self.longest(text), self.length, self.shorter
        dead, out, at, n = set(), array("I"), 0, len(text)
        token = longest[0]
        while at < n:
            end = at + length[token]
            if end not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: no encoding passes this place
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def ids(self, words: list[str]) -> bytes:
        """The words' ids in a row, little-endian unsigned 32-bit."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, extra = self.cache, {}
        for w in set(words).difference(cache):
            (cache if len(w) <= CACHE_CHARS else extra)[w] = np.asarray(self.encode(w), "<u4").tobytes()
        return b"".join([cache[w] if w in cache else extra[w] for w in words] if extra else map(cache.__getitem__, words))


class Tokenizer:
    """A tokenizer file: its words, their ids, and the way back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens") or []
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError(f"not a plain BPE model without post-processor and decoder: {odd or model.get('type')}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that are normalized, stripped or whole words only")
        if "ByteLevel" not in json.dumps(spec.get("pre_tokenizer")):
            raise ValueError("no byte-level pre-tokenizer")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = WordEncoder(Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or ""))
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        names = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(names)})") if names else None
        self.split = self._split_of(spec)
        self.path, self.bytes_of = path, {ord(c): chr(b) for c, b in byte_alphabet().items()}
        # Every token's string and the blank behind it, by id.
        by_id = {i: s for s, i in model["vocab"].items()} | {t["id"]: t["content"] for t in added}
        pieces = [(by_id[i] + " ").encode() if i in by_id else b"" for i in range(max(by_id) + 1)]
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    @staticmethod
    def _split_of(spec: dict) -> re.Pattern | None:
        """The word pattern for plain texts; none if the file's steps are others than lower-casing and one pattern."""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        kinds = [s["type"] for s in steps]
        blanks = all(s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps if s["type"] == "Replace")
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        if kinds != ["NFC", "Replace", "Lowercase"] or not blanks or not plain or parts[1]["add_prefix_space"] or parts[1]["use_regex"]:
            return None
        return narrow(parts[0]["pattern"]["Regex"])

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.path)

    def words_of(self, text: str) -> Iterator[str]:
        low = text.lower()
        if self.split and not ODD.search(text) and not ODD.search(low):
            yield from (self.split.findall(low) if len(low) < 1_000_000 else (m[0] for m in self.split.finditer(low)))
            return
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= ODD_CHARS else text.rfind(" ", at + 1, at + ODD_CHARS)
            if end < 0:
                end = text.find(" ", at + 1)
            end = len(text) if end < 0 else end
            normal = self.library.normalizer.normalize_str(text[at:end]) if self.library.normalizer else text[at:end]
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                yield piece.translate(self.bytes_of).encode("latin-1").decode()
            at = end

    def encode(self, text: str) -> bytes:
        out = bytearray()
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.added:
                out += self.added[piece]
                continue
            found = self.words_of(piece)
            while words := list(islice(found, WORDS_AT_ONCE)):
                out += self.words.ids(words)
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings with a blank between each two, as the library joins them where a file has no decoder."""
        wanted = np.frombuffer(ids, "<u4").astype(np.int64)
        wanted = wanted[wanted < len(self.offsets) - 1]
        out = []
        for at in range(0, len(wanted), IDS_AT_ONCE):
            part = wanted[at : at + IDS_AT_ONCE]
            begin = self.offsets[part]
            size = self.offsets[part + 1] - begin
            shift = np.repeat(begin - (np.cumsum(size) - size), size)
            out.append(self.buffer[np.arange(len(shift)) + shift].tobytes())
        return b"".join(out)[:-1]


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for all tasks of a worker process."""
    return Tokenizer(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc, n_tokens, ids, decoded): per row its ids as little-endian unsigned 32-bit integers, and their decoded text.

    ``path`` is the tokenizer file's path on every executor.
    """

    def run(batches):
        tok = tokenizer(path)
        for b in batches:
            for part in slices(b, 1, BATCH_BYTES):
                ids = [tok.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if with_text:
                    cols.append(pa.array(map(tok.decode, ids), pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc", "n_tokens", "ids", "decoded"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n_tokens bigint, ids binary" + ", decoded string" * with_text
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc", ids_col: str = "ids") -> DataFrame:
    """(doc, decoded) from ids as :func:`encode` gives them; null ids decode to the empty text, unknown ones to nothing."""

    def run(batches):
        tok = tokenizer(path)
        for b in batches:
            for part in slices(b, 1, BATCH_BYTES):
                texts = [tok.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc {kind}, decoded string")
