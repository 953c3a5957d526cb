"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

Method: each task cuts its texts into words by the tokenizer's pattern and
keeps the words it has not met yet. They enter a DuckDB recursive query as
token-position rows (one per byte at first); every step joins neighbouring
rows with the merge table and contracts each word's leftmost pair of minimum
rank, until no word has a pair left. The final rows in order give a word's ids
and, through the vocabulary table, its decoded bytes; a document is its words'
ids and bytes in order.

A step contracts every (non-overlapping) occurrence of the word's minimum pair
at once where that provably gives the same ids: no token that the new one
could form has a lower rank. Other pairs contract one at a time.

A word over ``WINDOW`` bytes enters the query as windows that overlap by half,
each contracted as a word of its own, so that the work stays in proportion to
the word. Two windows are joined at a token that both hold at the same place.
That is exact: contraction chooses by rank and place alone, so between two
boundaries that no contraction crosses it runs as it would on that part alone.
Hence neighbours in the ids of any text are the ids of their own bytes; and
where all neighbours of a row of tokens are, the row is the ids of its bytes,
since a first contraction across a boundary would also take place in the bytes
of the two tokens beside it. Windows without such a token become one longer
window, up to the whole word: long periods of tokens that a shift repeats.

Memory of a worker: one Arrow batch, the texts and results of ``BATCH_BYTES`` of it
(of one text, if that is longer), ``WORDS_AT_ONCE`` words, the windows of long
words (some ten bytes for each of theirs), and a cache of at most ``CACHE_WORDS``
distinct words; when full, only short words stay. DuckDB writes nothing to disk.

Defined cases: a null or empty text has no ids; ids of any type, null and
repeated ones included, pass through row by row; an empty table gives an empty
result. Text is ordinary text: strings of special tokens get no special id.
"""

from __future__ import annotations

import base64
import functools
from array import array
from dataclasses import dataclass
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import slices
from cohortlens.llm.narrow import ODD, narrow

WORDS_AT_ONCE = 500_000
CACHE_WORDS = 500_000
KEEP_CHARS = 8
QUERY_BYTES = 1 << 17
FREED = "4MB"  # what DuckDB may keep of a query's freed memory
WINDOW = 128  # even
BATCH_BYTES = 1 << 21

_STEPS = """
WITH RECURSIVE step(w, pos, nxt, tok, done) AS (
  SELECT w, pos, pos + 1, tok, false FROM bytes_in
  UNION ALL
  (WITH live AS (SELECT w, pos, nxt, tok FROM step WHERE NOT done),
   pairs AS (
     SELECT a.w, a.pos, b.pos AS other, b.nxt AS after, m.rank, m.safe, a.tok = b.tok AS twin
     FROM live a JOIN live b ON a.w = b.w AND b.pos = a.nxt JOIN merges m ON m.l = a.tok AND m.r = b.tok),
   best AS (SELECT w, min(rank) AS rank FROM pairs GROUP BY w),
   least AS (SELECT p.* FROM pairs p JOIN best b ON b.w = p.w AND b.rank = p.rank),
   leftmost AS (SELECT w, min(pos) AS pos FROM least GROUP BY w),
   -- a token run such as aaaa has overlapping pairs: every second one of a run counts
   run AS (SELECT *, CASE WHEN lag(other) OVER (PARTITION BY w ORDER BY pos) = pos THEN 0 ELSE 1 END AS fresh
           FROM least WHERE safe AND twin),
   numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY w ORDER BY pos) AS g FROM run),
   counted AS (SELECT *, row_number() OVER (PARTITION BY w, g ORDER BY pos) AS n FROM numbered),
   pick AS (
     SELECT w, pos, other, after, rank FROM least WHERE safe AND NOT twin
     UNION ALL SELECT w, pos, other, after, rank FROM counted WHERE n % 2 = 1
     UNION ALL SELECT l.w, l.pos, l.other, l.after, l.rank FROM least l JOIN leftmost f ON f.w = l.w AND f.pos = l.pos WHERE NOT l.safe),
   -- a contracted pair's second row goes, its first becomes the new token; a word without a pair is done
   change AS (SELECT w, pos, after, rank FROM pick UNION ALL SELECT w, other, NULL, NULL FROM pick)
   SELECT s.w, s.pos, coalesce(c.after, s.nxt), coalesce(c.rank, s.tok), b.w IS NULL
   FROM live s LEFT JOIN best b ON b.w = s.w LEFT JOIN change c ON c.w = s.w AND c.pos = s.pos
   WHERE c.w IS NULL OR c.rank IS NOT NULL)
)
SELECT s.w, s.tok, v.token
FROM step s JOIN vocab v ON v.id = s.tok
WHERE s.done
ORDER BY s.w, s.pos
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass(slots=True)
class _Window:
    """Bytes ``start`` to ``end`` of a word; of its tokens, ``first`` to ``last`` (exclusive) are the word's."""

    word: int
    start: int
    end: int
    ids: bytes | None = None
    decoded: bytes = b""
    first: int = 0
    last: int = 0


class WordEncoder:
    """The merge and vocabulary tables in an in-memory DuckDB, and a bounded cache of encoded words."""

    def __init__(self, ranks: dict[bytes, int], cache_words: int = CACHE_WORDS):
        left, right, rank = array("i"), array("i"), array("i")
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        left, right, rank = (np.frombuffer(x, np.int32) for x in (left, right, rank))
        # Safe: no merge that takes the new token as a part has a lower rank than its own.
        least = np.full(max(ranks.values(), default=0) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "allocator_flush_threshold": FREED, "allocator_bulk_deallocation_flush_threshold": FREED})
        self.db.register("m", pa.table({"l": left, "r": right, "rank": rank, "safe": least[rank] >= rank}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.register("v", pa.table({"id": pa.array(ranks.values(), pa.int32()), "token": pa.array(ranks, pa.binary())}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.db.unregister("m")
        self.db.unregister("v")
        self.length = np.zeros(len(least), np.int64)
        for token, r in ranks.items():
            self.length[r] = len(token)
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache_words = cache_words
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Encode and decode the words that the cache lacks."""
        new = list(words.difference(self.ids))
        if len(self.ids) + len(new) > self.cache_words:
            # Short words are the frequent ones; the others go, and all of them if that is not enough.
            stay = [w for w in self.ids if len(w) <= KEEP_CHARS]
            if len(stay) + len(words) > self.cache_words // 2:
                stay = []
            self.ids, self.decoded = ({w: x[w] for w in stay} for x in (self.ids, self.decoded))
            new = list(words.difference(self.ids))
        ids, decoded = self._words([w.encode() for w in new])
        self.ids.update(zip(new, ids, strict=True))
        self.decoded.update(zip(new, decoded, strict=True))

    def _words(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Per word its ids and decoded bytes, long words by windows."""
        long = [i for i, w in enumerate(words) if len(w) > WINDOW]
        if not long:
            return self._queries(words)
        ids, decoded = [b""] * len(words), [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= WINDOW]
        for at, parts in ((short, self._queries([words[i] for i in short])), (long, self._long_words([words[i] for i in long]))):
            for i, ids[i], decoded[i] in zip(at, *parts, strict=True):
                pass
        return ids, decoded

    def _long_words(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        windows = [_Window(i, a, min(a + WINDOW, len(w))) for i, w in enumerate(words) for a in range(0, max(len(w) - WINDOW // 2, 1), WINDOW // 2)]
        while new := [x for x in windows if x.ids is None]:
            ids, decoded = self._queries([words[x.word][x.start : x.end] for x in new])
            for x, x.ids, x.decoded in zip(new, ids, decoded, strict=True):
                pass
            windows = self._meet(windows)
        ids, decoded = [bytearray() for _ in words], [bytearray() for _ in words]
        for x in windows:
            ids[x.word] += x.ids[4 * x.first : 4 * x.last]
            a, b = self._ends(x)[[x.first, x.last]] - x.start
            decoded[x.word] += x.decoded[a:b]
        return list(map(bytes, ids)), list(map(bytes, decoded))

    def _ends(self, x: _Window) -> np.ndarray:
        """Where the window starts and each of its tokens ends, in bytes of the word."""
        return np.concatenate([[0], self.length[np.frombuffer(x.ids, "<u4")].cumsum()]) + x.start

    def _meet(self, windows: list[_Window]) -> list[_Window]:
        """The windows, each cut at tokens that it shares with its neighbours; those without one are put together."""
        out: list[_Window] = []
        for x in windows:
            x.first, x.last = 0, len(x.ids) // 4
            left = out[-1] if out else None
            if left is None or left.word != x.word:
                out.append(x)
                continue
            if left.ids is not None:
                a, b = self._ends(left), self._ends(x)
                at, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                # A shared token: its start and its end stand side by side in both.
                same = np.flatnonzero((np.diff(i) == 1) & (np.diff(j) == 1))
                if len(same):
                    left.last, x.first = int(i[same[0] + 1]), int(j[same[0] + 1])
                    out.append(x)
                    continue
            out[-1] = _Window(x.word, left.start, x.end)
        return out

    def _queries(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        ids, decoded = [], []
        begin = 0
        while begin < len(words):
            end, size = begin, 0
            while end < len(words) and (end == begin or size + len(words[end]) <= QUERY_BYTES):
                size += len(words[end])
                end += 1
            part = self._query(words[begin:end])
            ids += part[0]
            decoded += part[1]
            begin = end
        return ids, decoded

    def _query(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        rows = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), length), "pos": pos.astype(np.int32), "tok": self.byte_rank[flat]})
        self.db.register("bytes_in", rows)
        out = self.db.sql(_STEPS).to_arrow_table().combine_chunks()
        self.db.unregister("bytes_in")
        ends = np.bincount(np.asarray(out.column("w")), minlength=len(words)).cumsum()
        ids = np.asarray(out.column("tok")).astype("<u4").tobytes()
        tokens = out.column("token").to_pylist()
        pairs = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        return [ids[4 * a : 4 * b] for a, b in pairs], [b"".join(tokens[a:b]) for a, b in pairs]


@functools.lru_cache(maxsize=1)
def _encoder(ranks_path: str, cache_words: int) -> WordEncoder:
    """One encoder for all tasks of a worker process, which find its bounded cache filled."""
    return WordEncoder(read_ranks(ranks_path), cache_words)


def encode_texts(texts: list[str | None], encoder: WordEncoder, pattern: str) -> tuple[list[bytes], list[bytes]]:
    """Per text its ids (little-endian unsigned 32-bit) and its decoded bytes."""
    general, narrowed, odd = regex.compile(pattern), narrow(pattern), ODD
    ids, decoded = [bytearray() for _ in texts], [bytearray() for _ in texts]
    waiting: list[tuple[int, list[str]]] = []
    met: dict[str, str] = {}  # one string for all places of a word
    n = 0

    def flush() -> None:
        encoder.learn(set(met))
        for i, words in waiting:
            ids[i] += b"".join(map(encoder.ids.__getitem__, words))
            decoded[i] += b"".join(map(encoder.decoded.__getitem__, words))
        waiting.clear()
        met.clear()

    for i, t in enumerate(texts):
        if t is None:
            continue
        split = general if odd.search(t) else narrowed
        found = iter(split.findall(t)) if len(t) < 1_000_000 else (m[0] for m in split.finditer(t))
        while words := [met.setdefault(w, w) for w in islice(found, WORDS_AT_ONCE)]:
            waiting.append((i, words))
            n += len(words)
            if n >= WORDS_AT_ONCE:
                flush()
                n = 0
    flush()
    return [bytes(x) for x in ids], [bytes(x) for x in decoded]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc, n_tokens, ids, decoded): per row of ``docs`` its ids as little-endian unsigned 32-bit integers, and their bytes.

    ``ranks_path`` is the ranks file's path on every executor. Idle workers
    keep their cache, of ``cache_words`` words, for a minute or so.
    """

    def run(batches):
        encoder = _encoder(ranks_path, cache_words)
        for b in batches:
            for part in slices(b, 1, BATCH_BYTES):
                ids, decoded = encode_texts(part.column(1).to_pylist(), encoder, pattern)
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = ["doc", "n_tokens", "ids"]
                if decode:
                    cols, names = [*cols, pa.array(decoded, pa.binary())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n_tokens bigint, ids binary" + ", decoded binary" * decode
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
