"""Token ids of documents in fixed-width bit-packed shard files.

Method: every id is stored in the minimum number of bits that holds the
vocabulary. Ids are packed in blocks of ``BLOCK`` with the blocks' byte offsets
in the header, so that a block, or any range of ids, is unpacked by vectorised
numpy without reading the rest.

Documents are dealt to shards by ranges of the id column (quantiles, so that
shards are alike in size), sorted in each task, encoded, and written as files
of about ``SHARD_IDS`` ids; the manifest of the files that finished tasks wrote
gives each file's place in the whole. Files go to the shared folder, through
its own filesystem, and get their names when complete; a file left by a lost
task is in no manifest.

File: 8 bytes magic, then little-endian unsigned 64-bit numbers: bits,
documents, ids, block length, then per document its id (signed) and its end in
ids, then the blocks' byte offsets from the first, then the packed ids, lowest
bit first.

Defined cases: a null or empty text is one end id; a null document id comes
first; rows that repeat an id stay next to each other, in order of their
texts' hashes; an empty table gives no files and an empty result. Ids of
documents are integers. An added token's string in a text gives that token's
id, as in the library's plain ``encode``.
"""

from __future__ import annotations

import functools
import itertools
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, text_or_empty
from cohortlens.llm.narrow import ODD, narrow
from cohortlens.plans.materialize import new_path

MAGIC = b"IDPACK01"
BLOCK = 1 << 16
SHARD_IDS = 1 << 21
CACHE_WORDS = 1_200_000
KEEP_CHARS = 8
GROUP_CHARS = 1 << 20
NULL_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned) in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def shard_bytes(docs: list[int], ends: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = np.array([bits, len(docs), len(ids), BLOCK], "<u8").tobytes()
    return b"".join([MAGIC, head, np.array(docs, "<i8").tobytes(), ends.astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """A shard file's contents; ``ids(a, b)`` unpacks only the blocks that hold ids a to b."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a packed id file")
        self.bits, n, self.n_ids, self.block = np.frombuffer(data, "<u8", 4, 8).tolist()
        at = 40
        self.docs = np.frombuffer(data, "<i8", n, at)
        self.ends = np.frombuffer(data, "<u8", n, at + 8 * n)
        at += 16 * n
        self.n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", self.n_blocks + 1, at).tolist()
        self.at, self.data = at + 8 * (self.n_blocks + 1), data

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.empty(0, "<u4")
        first, last = a // self.block, (b - 1) // self.block
        parts = [
            unpack(self.data[self.at + self.offsets[i] : self.at + self.offsets[i + 1]], self.bits, min(self.block, self.n_ids - i * self.block))
            for i in range(first, last + 1)
        ]
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]


class TextEncoder:
    """Encodes texts with the tokenizers library, once for each distinct word of a task where words are independent.

    Words that are a space and letters are encoded many at a time as one
    text, which the tokenizer's pattern cuts into the same words: each begins
    at a token that begins with the space.
    """

    def __init__(self, path: str, pattern: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(space)]] = True
        self.bits = bits_for(self.tokenizer.get_vocab_size())
        # Texts that hold an added token's string go through the library whole, as it gives the token's id.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern, self.odd = narrow(pattern), re.compile("|".join([ODD.pattern, *added]))
        self.cache_words, self.cache = cache_words, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids per text. Words of several texts are learnt together, up to ``GROUP_CHARS`` of text."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= GROUP_CHARS):
                group.append(texts[at])
                size += len(texts[at])
                at += 1
            out += self._long(group[0]) if size > GROUP_CHARS else self._group(group)
        return out

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        words = [None if self.odd.search(t) else self.pattern.findall(t) for t in texts]
        self._learn(set().union(*(w for w in words if w)))
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
            if w is None
            else np.frombuffer(b"".join(map(self.cache.__getitem__, w)), "<u4")
            for t, w in zip(texts, words, strict=True)
        ]

    def _long(self, text: str) -> list[np.ndarray]:
        """One long text, some of its words at a time."""
        if self.odd.search(text):
            return self._group([text])
        found, parts = (m[0] for m in self.pattern.finditer(text)), []
        while words := list(itertools.islice(found, self.cache_words // 4)):
            self._learn(set(words))
            parts.append(b"".join(map(self.cache.__getitem__, words)))
        return [np.frombuffer(b"".join(parts), "<u4")]

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > self.cache_words:
            # Short words are the frequent ones; the others go, and all of them if that is not enough.
            self.cache = {w: x for w, x in self.cache.items() if len(w) <= KEEP_CHARS}
            if len(self.cache) + len(words) > self.cache_words // 2:
                self.cache = {}
            new = words.difference(self.cache)
        plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * np.flatnonzero(self.begins[ids])).tolist()
            data = ids.tobytes()
            self.cache.update(zip(plain, map(data.__getitem__, map(slice, cut, [*cut[1:], len(data)])), strict=True))
        rest = list(new.difference(plain))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()


@functools.lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for all tasks of a worker process, which find its bounded cache filled."""
    return TextEncoder(path, pattern)


def _spread(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """(doc, text) rows dealt to ``shards`` tasks by ranges of the id, sorted by id in each task."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    share = [i / shards for i in range(1, shards)]
    cuts = rows.agg(F.percentile_approx("doc", F.array(*[F.lit(x) for x in share]), 10_000)).first()[0] if share else None
    below = sorted(set(cuts or []))
    part = F.lit(0)
    if below:  # number of cuts under the id, by bisection in a literal array
        at = F.array(*[F.lit(c) for c in below])
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(below).bit_length()))])
        part = F.aggregate(
            steps, F.lit(0), lambda n, step: n + F.when(F.coalesce(F.get(at, n + step - 1) < F.col("doc"), F.lit(False)), step).otherwise(0)
        )
    ranged = rows.withColumn("part", part).repartitionById(len(below) + 1, "part")
    return ranged.sortWithinPartitions(F.col("doc").asc_nulls_first(), F.xxhash64("text"))


def write(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    shard_ids: int = SHARD_IDS,
    folder: str | None = None,
) -> DataFrame:
    """Write the shard files; returns the manifest (path, n_docs, n_ids, first): ``first`` is the ids in all files before.

    ``folder`` (default: a new one in the shared folder) gets the files;
    ``shards`` defaults to the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or new_path(spark, "ids")

    def run(batches):
        encoder = _encoder(tokenizer_path, pattern)
        store, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        ids: list[np.ndarray] = []
        held: list[int] = []
        n, seq = 0, 0

        def put():
            name = f"{uuid.uuid4().hex}.ids"
            ends = np.cumsum([len(x) for x in ids])
            with store.open_output_stream(f"{root}/{name}.part") as f:
                f.write(shard_bytes(held, ends, np.concatenate(ids), encoder.bits))
            store.move(f"{root}/{name}.part", f"{root}/{name}")  # a task lost before leaves no file that readers take
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (name, part, seq, len(held), int(ends[-1]))], ["name", "part", "seq", "n_docs", "n_ids"]
            )

        part, end = 0, np.uint32(end_id)
        for b in batches:
            for at in range(0, b.num_rows, 200):  # few rows at a time as Python objects
                docs, texts, parts = (c.to_pylist() for c in b.slice(at, 200).columns)
                part = parts[0]  # one part a task
                for doc, x in zip(docs, encoder.encode(texts), strict=True):
                    if n >= shard_ids:
                        yield put()
                        ids, held, n, seq = [], [], 0, seq + 1
                    ids.append(np.append(x, end).astype("<u4"))
                    held.append(NULL_ID if doc is None else doc)
                    n += len(ids[-1])
        if held:
            yield put()

    # The manifest is a row per file, so its running sum over all files is small work.
    written = materialize(
        _spread(docs, id_col, text_col, shards)
        .select("doc", "text", F.col("part").cast("long"))
        .mapInArrow(run, "name string, part bigint, seq bigint, n_docs bigint, n_ids bigint"),
        "ids-manifest",
    )
    before = F.sum("n_ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    return written.select(
        F.concat(F.lit(folder + "/"), "name").alias("path"), "name", "n_docs", "n_ids", F.coalesce(before, F.lit(0).cast("long")).alias("first")
    )


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc, start, n_tokens, ids) per document of the manifest's files; ids little-endian unsigned 32-bit."""
    return _read(spark, manifest, "ids binary", lambda x: x.tobytes(), pa.binary())


def read_digest(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc, start, n_tokens, crc32) per document, from the files' unpacked ids."""
    return _read(spark, manifest, "crc32 bigint", lambda x: zlib.crc32(x.tobytes()), pa.int64())


def _read(spark: SparkSession, manifest: DataFrame, column: str, value, kind: pa.DataType) -> DataFrame:
    manifest = materialize(manifest, "ids-files")
    one = manifest.first()  # any file names the folder
    if one is None:
        return spark.createDataFrame([], f"doc bigint, start bigint, n_tokens bigint, {column}")

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(data.as_py())
                ends = s.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                for i in range(0, len(ends), 2000):
                    base = int(starts[i])
                    ids = s.ids(base, int(ends[min(i + 2000, len(ends)) - 1]))
                    spans = zip((starts[i : i + 2000] - base).tolist(), (ends[i : i + 2000] - base).tolist(), strict=True)
                    docs = s.docs[i : i + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path.rsplit("/", 1)[-1]] * len(docs)),
                            pa.array(docs, mask=docs == NULL_ID),
                            pa.array(starts[i : i + 2000]),
                            pa.array(ends[i : i + 2000] - starts[i : i + 2000]),
                            pa.array([value(ids[x:y]) for x, y in spans], kind),
                        ],
                        ["name", "doc", "at", "n_tokens", column.split()[0]],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(one["path"].rsplit("/", 1)[0])
    rows = files.select("path", "content").mapInArrow(run, f"name string, doc bigint, at bigint, n_tokens bigint, {column}")
    return rows.join(manifest.select("name", "first"), "name").select(
        "doc", (F.col("first") + F.col("at")).alias("start"), "n_tokens", column.split()[0]
    )
