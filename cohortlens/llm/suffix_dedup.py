"""Remove every byte inside a long string that also stands somewhere else, by merged Burrows-Wheeler transforms.

A byte goes if a ``length``-byte string covering it starts at two places or
more, in one text or in several; strings are judged on the input and never
cross documents.

Method:

1. Split the work exactly. Every ``length``-byte window has an anchor, its
   ``GRAM``-byte substring of least hash (the first of several); equal windows
   have equal anchors at the same offset. Consecutive starts that share an
   anchor, and the half of the possible offsets, make a run. All windows of one
   anchor and half hold the same ``length / 2`` bytes and more around the
   anchor; their digest is the run's key. Windows of different keys differ, so
   each key is a problem of its own. Keys met once are unique; runs whose whole
   strings are equal (128-bit digest) are collapsed.
2. Where a key has different strings, their shards get Burrows-Wheeler
   transforms (:class:`ShardBwt`), which are merged by refining the interleave
   of their rows (:func:`repeated_rows`): the classes of rows with a common
   prefix of ``h`` bytes give those of ``2 h`` bytes by following the
   transforms' own row mapping ``h`` steps. Every shard's rows are in order
   already, so each refinement is a merge of sorted runs and no suffix is
   sorted again. Classes are the intervals of common prefix ``h`` and more;
   those of two rows or more at ``length`` are the repeated strings.
3. Repeated starts go back to their documents, and their bytes are cut.

No key is collected unbounded: up to ``WHOLE_STRINGS`` different strings of a
key meet as they are; up to ``BLOCK_STRINGS`` they are cut into blocks of
``BLOCK_STARTS`` starts, dealt by the key and the bytes common to all windows
of the block, and equal pieces are collapsed; beyond, each window is a piece,
which needs no more than its count.

Defined cases: null or empty text: no bytes, nothing removed; texts shorter
than ``length`` stay whole; a repeated row is another place, so its long
strings go; a null id is like any other value; empty table: empty result. The
bytes left may not be valid UTF-8, since a repeat may start inside a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, slices, text_or_empty

LENGTH = 400
GRAM = 32
SEGMENT = 1 << 18  # text at once; its hashes and places take about 60 times as much
WHOLE_STRINGS = 100
BLOCK_STRINGS = 5_000
BLOCK_STARTS = 32
PIECES = 1 << 14  # given out at once; a text's pieces take many times the text
BUCKET_BYTES = 1 << 19  # strings merged at once; their steps take over 100 times as much
SHARD_BYTES = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed 64-bit hash of the ``size`` bytes (a power of two) from every place."""
    h, k, base = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    with np.errstate(over="ignore"):
        while k < size:
            h = h[:-k] * base + h[k:]
            base, k = base * base, 2 * k
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        h *= _MIX
    return h ^ (h >> np.uint64(32))


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, from running minima of blocks of ``w`` in both directions."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(buffer: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of the texts laid end to end in ``buffer``: text number, first and last start, anchor place, half (0: nearer the anchor)."""
    data = np.frombuffer(buffer, np.uint8)
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    half_size = _half(length)
    h = gram_hashes(data, GRAM)
    # High half of the hash before the place: the least is the least hash, the first of equals.
    place = window_minimum((h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    place = (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(place))
    text = np.searchsorted(ends, start, side="right")
    inside = start + length <= np.asarray(ends)[text]
    start, place, text = start[inside], place[inside], text[inside]
    if not len(start):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    half = (place - start) >= half_size
    fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (half[1:] != half[:-1])]))
    last = np.concatenate([fresh[1:], [len(start)]]) - 1
    return text[fresh], start[fresh], start[last], place[fresh], half[fresh].astype(np.int64)


def _half(length: int) -> int:
    """Number of offsets in the nearer half of the ``length - GRAM + 1`` places an anchor can have in a window."""
    return (length - GRAM + 2) // 2


def _digest(b: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _find_runs(batches, length: int):
    """(doc, th, s, e, o, key, ra, rb) rows: starts s..e share the anchor ``o`` bytes after s; ra, rb digest their bytes."""
    near = _half(length)
    for b in (some for whole in batches for some in slices(whole, 2, 4 * SEGMENT)):
        texts = b.column(2).to_pylist()
        parts: list[tuple[int, int, bytes]] = []  # row, offset, bytes; long texts in overlapping segments
        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t) - length + 1), SEGMENT):
                if len(t) - at >= length:
                    parts.append((i, at, t[at : at + SEGMENT + length - 1]))
        while parts:
            some, size = [], 0
            while parts and size < SEGMENT:
                some.append(parts.pop())
                size += len(some[-1][2])
            buffer = b"".join(x[2] for x in some)
            ends = np.cumsum([len(x[2]) for x in some])
            text, s, e, place, half = runs(buffer, ends, length)
            if not len(text):
                continue
            # Bytes common to all windows of the half: from its nearest start to its farthest start's end.
            common = np.where(half == 0, place, place - near), np.where(half == 0, place - near + 1 + length, place + GRAM)
            key = [
                xxhash.xxh3_64_intdigest(buffer[a:b], seed) - (1 << 63)
                for a, b, seed in zip(common[0].tolist(), common[1].tolist(), half.tolist(), strict=True)
            ]
            digest = [_digest(buffer[x:y]) for x, y in zip(s.tolist(), (e + length).tolist(), strict=True)]
            row = np.array([x[0] for x in some])[text]
            move = np.array([x[1] for x in some])[text] - (ends - np.array([len(x[2]) for x in some]))[text]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(row)),
                    b.column(1).take(pa.array(row)),
                    pa.array(s + move),
                    pa.array(e + move),
                    pa.array((place - s).astype(np.int32)),
                    pa.array(key, pa.int64()),
                    pa.array([x for x, _ in digest], pa.int64()),
                    pa.array([x for _, x in digest], pa.int64()),
                ],
                ["doc", "th", "s", "e", "o", "key", "ra", "rb"],
            )


class ShardBwt:
    """The Burrows-Wheeler transform of several byte strings, each with an end mark of its own.

    ``bwt``: symbols (byte + 1; end mark 0) before the sorted suffixes;
    ``string`` and ``offset``: where the suffixes start. ``follow(h)``: for
    each row the row of the suffix ``h`` symbols on, from the transform alone.
    """

    def __init__(self, strings: list[bytes]):
        size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        text = np.zeros(int(size.sum()), np.uint16)
        end = np.cumsum(size) - 1
        marks = np.zeros(len(text), bool)
        marks[end] = True
        text[~marks] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
        order = self._suffix_order(text, marks)
        self.string = np.repeat(np.arange(len(strings)), size)[order]
        self.offset = order - (end - size + 1)[self.string]
        before = np.where(self.offset == 0, end[self.string], order - 1)
        self.bwt = text[before]
        self._steps = {1: np.argsort(self.bwt, kind="stable").astype(np.int32)}
        self.first = self.bwt[self._steps[1]]

    @staticmethod
    def _suffix_order(text: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Sorted suffixes by doubling from seven symbols; the end marks make all suffixes different."""
        n, h = len(text), 7
        padded = np.concatenate([text, np.zeros(h, np.uint16)]).astype(np.int64)
        key = np.zeros(n, np.int64)
        for i in range(h):
            key = key * 257 + padded[i : n + i]
        # Beyond an end mark nothing counts: suffixes that reach one so soon are told apart by its place.
        mark_at = np.minimum.accumulate(np.where(marks, np.arange(n), n)[::-1])[::-1]
        away = mark_at - np.arange(n)
        soon = away < h
        key[soon] -= key[soon] % (257 ** (h - away[soon]))
        tail = np.where(soon, mark_at, 0)
        order = np.lexsort((tail, key))
        k, t = key[order], tail[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
        rank = np.empty(n, np.int64)  # place of the first suffix that is equal so far
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        at = np.arange(n)  # places in the order that are not settled
        while True:
            alone = fresh & np.concatenate([fresh[1:], [True]])
            at = at[~alone]
            if not len(at):
                return order
            some = order[at]
            key = rank[some] * (n + 1) + np.where(some + h < n, rank[np.minimum(some + h, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            some, key = some[by], key[by]
            order[at] = some
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            rank[some] = np.maximum.accumulate(np.where(fresh, at, 0))
            h *= 2

    def follow(self, h: int) -> np.ndarray:
        if h not in self._steps:
            a = 1 << (h.bit_length() - 1)
            self._steps[h] = self.follow(h - a)[self.follow(a)] if a < h else self.follow(a // 2)[self.follow(a // 2)]
        return self._steps[h]


def repeated_rows(shards: list[ShardBwt], length: int) -> list[np.ndarray]:
    """Per shard, which rows' suffixes share their first ``length`` symbols with another row of any shard."""
    sizes = np.cumsum([0, *(len(s.bwt) for s in shards)])

    def merged(keys: list[np.ndarray]) -> np.ndarray:
        """Interleave the shards' rows, each in order already: classes of equal keys, numbered in key order."""
        key = np.concatenate(keys)
        interleave = np.argsort(key, kind="stable")  # a merge of sorted runs
        k = key[interleave]
        cls = np.empty(len(k), np.int64)
        cls[interleave] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        return cls

    # Common prefix 1: end marks differ from each other, and stand before all bytes.
    first = []
    for i, s in enumerate(shards):
        f = s.first.astype(np.int64) + sizes[-1]
        f[s.first == 0] = np.arange(sizes[i], sizes[i] + np.count_nonzero(s.first == 0))
        first.append(f)
    cls, h = merged(first), 1
    while h < length:
        step = min(h, length - h)
        span = len(cls) + 1
        keys = []
        for i, s in enumerate(shards):
            own = cls[sizes[i] : sizes[i + 1]]
            keys.append(own * span + own[s.follow(step)])
        cls, h = merged(keys), h + step
    several = np.bincount(cls)[cls] > 1
    return [several[sizes[i] : sizes[i + 1]] for i in range(len(shards))]


def repeated_starts(strings: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> list[list[tuple[int, int]]]:
    """Per string the (first, last) ranges of starts whose ``length`` bytes stand at two places of the strings or more."""
    shards, members = [], []
    at = 0
    while at < len(strings):
        some, size = [], 0
        while at < len(strings) and (not some or size + len(strings[at]) <= shard_bytes):
            some.append(at)
            size += len(strings[at])
            at += 1
        members.append(np.array(some))
        shards.append(ShardBwt([strings[i] for i in some]))
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    if not shards:
        return out
    for shard, member, flag in zip(shards, members, repeated_rows(shards, length), strict=True):
        string, offset = member[shard.string[flag]], shard.offset[flag]
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        if not len(string):
            continue
        fresh = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)]))
        last = np.concatenate([fresh[1:], [len(string)]]) - 1
        for i, a, b in zip(string[fresh].tolist(), offset[fresh].tolist(), offset[last].tolist(), strict=True):
            out[i].append((a, b))
    return out


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _merge_buckets(batches, length: int):
    """(rk, pa, pb, n, string) rows, sorted by rk -> (rk, pa, pb, ranges); whole keys are gathered up to about the bucket size."""

    def solve(rows):
        found = repeated_starts([r[4] for r in rows], length)
        ranges = [
            [{"a": 0, "b": len(r[4]) - length}] if r[3] > 1 else [{"a": a, "b": b} for a, b in f] for r, f in zip(rows, found, strict=True)
        ]
        kept = [(r, x) for r, x in zip(rows, ranges, strict=True) if x]
        cols = [pa.array([r[i] for r, _ in kept], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([x for _, x in kept], _RANGES)], ["rk", "pa", "pb", "ranges"])

    held, size, group, key = [], 0, [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group and row[0] != key:
                if len(group) > 1 or group[0][3] > 1:  # a string alone under its key meets nothing
                    held += group
                    size += sum(len(r[4]) for r in group)
                group = []
                if size >= BUCKET_BYTES:
                    yield solve(held)
                    held, size = [], 0
            key = row[0]
            group.append(row)
    held += group
    if held:
        yield solve(held)


def _pieces(batches, length: int, strings: bool, tiers: tuple[int, ...]):
    """Pieces of the runs of ``tiers``: (rk, pa, pb, doc, th, at[, string]); ``at``: the piece's first start.

    Without ``strings`` only single runs count, those that wait for an answer.
    """

    def batch(b: pa.RecordBatch, out: list[tuple], row_of: list[int]) -> pa.RecordBatch:
        rk, pa_, pb, at, string = zip(*out, strict=True)
        arrays = [*(pa.array(c, pa.int64()) for c in (rk, pa_, pb)), *(b.column(c).take(pa.array(row_of)) for c in (0, 1)), pa.array(at, pa.int64())]
        names = ["rk", "pa", "pb", "doc", "th", "at"]
        if strings:
            arrays, names = [*arrays, pa.array(string, pa.binary())], [*names, "string"]
        return pa.RecordBatch.from_arrays(arrays, names)

    for b in (some for whole in batches for some in slices(whole, 2, 4 * SEGMENT)):
        out: list[tuple] = []
        row_of: list[int] = []
        for i, (text, rs) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            for r in rs:
                if r["tier"] not in tiers or not (strings or r["single"]):
                    continue
                if r["tier"] == 0:
                    found = [(r["key"], r["ra"], r["rb"], r["s"], text[r["s"] : r["e"] + length])]
                else:
                    found = _cut(text, r, length, strings, BLOCK_STARTS if r["tier"] == 1 else 1)
                out += found
                row_of += [i] * len(found)
                if len(out) >= PIECES:
                    yield batch(b, out, row_of)
                    out, row_of = [], []
        if out:
            yield batch(b, out, row_of)


def _cut(text: bytes, r: dict, length: int, strings: bool, starts: int):
    """Pieces of a run: starts by blocks of their distance to the anchor; rk digests the key, the block and its common bytes."""
    anchor = r["s"] + r["o"]
    found = []
    at = r["s"]
    while at <= r["e"]:
        block = (anchor - at) // starts
        last = min(r["e"], anchor - block * starts)
        low, high = anchor - (block + 1) * starts + 1, anchor - block * starts
        # A run that ends inside a block shares the block's common bytes, wherever it ends.
        common = text[high : low + length] if starts > 1 else b""
        piece = text[at : last + length]
        pa_, pb = _digest(piece)
        rk = xxhash.xxh3_64_intdigest(b"%d:%d:" % (r["key"], block) + common) - (1 << 63)
        found.append((rk, pa_, pb, at, piece if strings and starts > 1 else None))
        at = last + 1
    return found


def _candidates(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Runs whose key is met again, and the texts of the documents that have any.

    Runs: (doc, th, s, e, o, key, ra, rb, single, tier). A run that is not
    ``single`` is repeated as a whole. Under a key of different strings the
    single ones are to be compared, with one copy of each other string: tier 0
    to 2; the rest has tier -1. Texts: (doc, th, text, runs of tier 0 to 2).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    schema = f"doc {kind}, th bigint, s bigint, e bigint, o int, key bigint, ra bigint, rb bigint"
    found = materialize(rows.mapInArrow(lambda it: _find_runs(it, length), schema), "suffix-runs")
    keys = materialize(found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key"), "suffix-keys")
    again = materialize(found.join(keys, "key"), "suffix-again")
    strings = materialize(
        again.groupBy("key", "ra", "rb").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "s")).alias("copy")), "suffix-strings"
    )
    several = materialize(strings.groupBy("key").agg(F.count("*").alias("strings")), "suffix-several")
    known = materialize(strings.join(several, "key"), "suffix-known")
    tier = F.when(F.col("strings") <= WHOLE_STRINGS, 0).when(F.col("strings") <= BLOCK_STRINGS, 1).otherwise(2)
    is_copy = F.struct("doc", "th", "s").eqNullSafe(F.col("copy"))
    marked = materialize(
        again.join(known, ["key", "ra", "rb"]).select(
            *found.columns,
            (F.col("n") == 1).alias("single"),
            F.when((F.col("strings") > 1) & ((F.col("n") == 1) | is_copy), tier).otherwise(-1).alias("tier"),
        ),
        "suffix-marked",
    )
    run = F.struct("s", "e", "o", "key", "ra", "rb", "single", "tier")
    of_doc = marked.groupBy("doc", "th").agg(F.collect_list(F.when(F.col("tier") >= 0, run)).alias("runs"))
    r, d = of_doc.alias("r"), rows.alias("d")
    on = F.col("d.doc").eqNullSafe(F.col("r.doc")) & (F.col("d.th") == F.col("r.th"))
    return marked, materialize(d.join(r, on).select("d.doc", "d.th", "d.text", "r.runs"), "suffix-texts")


def _ranges(marked: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(doc, th, a, b): ranges of repeated starts of the single runs."""
    kind = texts.schema["doc"].dataType.simpleString()
    schema = f"rk bigint, pa bigint, pb bigint, doc {kind}, th bigint, at bigint"
    ranges_type = "array<struct<a:bigint,b:bigint>>"

    def pieces(strings: bool, *tiers: int) -> DataFrame:
        some = texts.where(F.exists("runs", lambda r: r["tier"].isin(*tiers)))
        return some.mapInArrow(lambda it: _pieces(it, length, strings, tiers), schema + ", string binary" * strings)

    meet = pieces(True, 0).select("rk", "pa", "pb", F.lit(1).cast("bigint").alias("n"), "string")
    places = marked.where("tier = 0 and single").select(F.col("key").alias("rk"), F.col("ra").alias("pa"), F.col("rb").alias("pb"), "doc", "th", F.col("s").alias("at"))
    alike = None
    if (marked.agg(F.max("tier")).first()[0] or 0) > 0:  # some key has many strings
        same = materialize(pieces(True, 1, 2).groupBy("rk", "pa", "pb").agg(F.count("*").alias("n"), F.first("string").alias("string")), "suffix-same")
        meet = meet.unionByName(same.where(F.col("string").isNotNull()))
        one = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
        alike = same.where(F.col("string").isNull() & (F.col("n") > 1)).select("rk", "pa", "pb", F.array(one).alias("ranges"))
        places = places.unionByName(pieces(False, 1, 2))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = (
        meet.repartition(parts, "rk")
        .sortWithinPartitions("rk", "pa", "pb")
        .mapInArrow(lambda it: _merge_buckets(it, length), f"rk bigint, pa bigint, pb bigint, ranges {ranges_type}")
    )
    ranges = materialize(merged if alike is None else merged.unionByName(alike), "suffix-ranges")
    return (
        places.join(ranges, ["rk", "pa", "pb"])
        .select("doc", "th", "at", F.explode("ranges").alias("r"))
        .select("doc", "th", (F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b")).alias("b"))
    )


def _cut_texts(batches, length: int):
    for b in (some for whole in batches for some in slices(whole, 2, 4 * SEGMENT)):
        spans_of, kept = [], []
        for text, ranges in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            spans, left, at = [], [], 0
            for r in sorted(ranges, key=lambda r: r["a"]):
                a, e = r["a"], r["b"] + length
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([a, e])
            for a, e in spans:
                left.append(text[at:a])
                at = e
            left.append(text[at:])
            kept.append(b"".join(left))
            spans_of.append([{"s": a, "e": e} for a, e in spans])
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans_of, kind), pa.array(kept, pa.binary())], ["doc", "th", "spans", "kept"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, th, spans, kept) of the rows that lose bytes: maximal removed byte ranges and the bytes left.

    ``th`` is the text's xxhash64, which with the id names a row's text.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    marked, texts = _candidates(docs, id_col, text_col, length)
    whole = marked.where("not single").select("doc", "th", F.col("s").alias("a"), F.col("e").alias("b"))
    ranges = whole.unionByName(_ranges(marked, texts, length)).groupBy("doc", "th").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    kind = docs.schema[id_col].dataType.simpleString()
    t, r = texts.alias("t"), ranges.alias("r")
    on = F.col("t.doc").eqNullSafe(F.col("r.doc")) & (F.col("t.th") == F.col("r.th"))
    return t.join(r, on).select("t.doc", "t.th", "t.text", "r.ranges").mapInArrow(
        lambda it: _cut_texts(it, length), f"doc {kind}, th bigint, spans array<struct<s:bigint,e:bigint>>, kept binary"
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    lost = materialize(
        repeated_spans(docs, id_col, text_col, length)
        .select("doc", "th", F.size("spans").cast("long").alias("n_spans"), F.octet_length("kept").cast("long").alias("n_kept"), F.sha2("kept", 256).alias("sha"))
        .distinct(),
        "suffix-lost",
    ).alias("l")
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")
    ).alias("d")
    on = F.col("d.doc").eqNullSafe(F.col("l.doc")) & (F.col("d.th") == F.col("l.th"))
    return rows.join(lost, on, "left").select(
        "d.doc",
        "n_bytes",
        (F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("l.sha", "d.sha").alias("kept_sha256"),
    )
