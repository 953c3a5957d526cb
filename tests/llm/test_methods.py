"""The operators' inner methods against brute force, and the cases their methods exist for."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import bitpack, graph, html_extract, license_scan, line_dedup, pii, quality, simhash, suffix_dedup
from cohortlens.llm.html_labelled import PAGES
from tests.llm import brute as B
from tests.llm.html_layouts import LAYOUTS


def test_bwt_merge_finds_repeated_windows():
    rng = random.Random(1)
    for _ in range(60):
        length = rng.choice([5, 8, 16, 64])
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(1, 12))]
        x = rng.choice(strings)
        strings.append(x[rng.randint(0, len(x)) :] + b"z" + x[:60])
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        got = suffix_dedup.repeated_starts(strings, length, shard_bytes=rng.choice([50, 200, 10_000]))
        for s, ranges in zip(strings, got, strict=True):
            starts = [i for a, b in ranges for i in range(a, b + 1)]
            assert starts == [i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1]


@pytest.mark.parametrize(("whole", "block"), [(100, 5_000), (2, 5_000), (2, 4)])
def test_suffix_dedup_of_a_large_group_in_every_tier(spark, monkeypatch, whole, block):
    monkeypatch.setattr(suffix_dedup, "WHOLE_STRINGS", whole)
    monkeypatch.setattr(suffix_dedup, "BLOCK_STRINGS", block)
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = [(1, base), (2, base[200:900]), (3, "ab" * 700), (4, "x" + base[:450])]
    for i in range(30):
        x = list(base)
        for _ in range(2):
            x[rng.randrange(len(x))] = "#"
        rows.append((10 + i, "".join(x)))
    got = {r["doc"]: r.asDict() for r in suffix_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for d, e in B.suffix_repeats(rows).items():
        assert {c: got[d][c] for c in e} == e


@pytest.mark.parametrize("step", ["runs", "merge", "pieces"])
def test_suffix_dedup_holds_little_of_a_batch_at_once(step):
    rng = random.Random(3)
    rows = 0
    if step == "runs":  # 6 MB of texts in one batch
        texts = [rng.randbytes(3_000) for _ in range(2_000)]
        b = pa.RecordBatch.from_arrays([pa.array(range(2_000)), pa.array(range(2_000)), pa.array(texts, pa.binary())], ["doc", "th", "text"])
        found, limit, least = suffix_dedup._find_runs(iter([b]), 400), 30, 2_000
    elif step == "merge":  # 2 MB of strings, three under a key
        held = [(k, j, j, 1, rng.randbytes(100) + bytes([k % 251]) * 100 + rng.randbytes(500)) for k in range(1_000) for j in range(3)]
        c = list(zip(*held, strict=True))
        b = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.binary())], ["rk", "pa", "pb", "n", "string"])
        found, limit, least = suffix_dedup._merge_buckets(iter([b]), 400), 110, 0
    else:  # a piece for each of 300,000 starts
        text = rng.randbytes(301_000)
        runs = [{"s": s, "e": s + 99, "o": 150, "key": s, "ra": s, "rb": s, "single": True, "tier": 2} for s in range(0, 300_000, 100)]
        b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text], pa.binary()), pa.array([runs])], ["doc", "th", "text", "runs"])
        found, limit, least = suffix_dedup._pieces(iter([b]), 400, False, (1, 2)), 20, 300_000
    tracemalloc.start()
    try:
        for out in found:
            rows += out.num_rows
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert rows >= least
    assert peak < limit


def test_suffix_dedup_of_small_slices_gives_the_same_rows(monkeypatch):
    rng = random.Random(4)
    base = rng.randbytes(6_000)
    texts = [base, base[700:2_900] + b"x", b"", b"ab" * 900, b"y" + base[1_000:4_400], base[:399], base[:1_500] + b"#" + base[1_501:]]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(range(7)), pa.array(texts, pa.binary())], ["doc", "th", "text"])

    def rows(batches) -> list[tuple]:
        return [x for out in batches for x in zip(*(c.to_pylist() for c in out.columns), strict=True)]

    runs = [[] for _ in texts]
    for i, (doc, _, s, e, o, key, ra, rb) in enumerate(rows(suffix_dedup._find_runs(iter([b]), 400))):
        runs[doc].append({"s": s, "e": e, "o": o, "key": key, "ra": ra, "rb": rb, "single": i % 4 > 0, "tier": i % 3})
    ranges = [[{"a": r["s"], "b": r["e"]} for r in rs if r["single"]] for rs in runs]
    with_runs = pa.RecordBatch.from_arrays([*b.columns, pa.array(runs)], ["doc", "th", "text", "runs"])
    with_ranges = pa.RecordBatch.from_arrays([*b.columns, pa.array(ranges)], ["doc", "th", "text", "ranges"])

    def results() -> list:
        found = rows(suffix_dedup._find_runs(iter([b]), 400))
        return [
            sorted((doc, th, s + i, o - i, key) for doc, th, s, e, o, key, _, _ in found for i in range(e - s + 1)),
            *(rows(suffix_dedup._pieces(iter([with_runs]), 400, strings, tiers)) for strings, tiers in ((True, (0,)), (True, (1, 2)), (False, (1, 2)))),
            rows(suffix_dedup._cut_texts(iter([with_ranges]), 400)),
        ]

    expected = results()
    assert all(expected)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    monkeypatch.setattr(suffix_dedup, "PIECES", 3, raising=False)
    assert results() == expected


@pytest.mark.parametrize("limit", [2, 64])
def test_simhash_links_make_the_components_of_all_pairs(spark, limit):
    """A dense cloud of fingerprints, whose cells are over the limit, and loose ones."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(40)}
    fps |= {rng.getrandbits(64) for _ in range(40)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:20]}
    signed = {f: int(np.uint64(f).astype(np.int64)) for f in fps}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp bigint"), cell_limit=limit)
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    expected = B.components({i: f for i, f in enumerate(sorted(fps))})
    order = sorted(fps)
    group = {f: got.get(signed[f], signed[f]) for f in fps}
    for i, f in enumerate(order):
        for j, g in enumerate(order):
            assert (expected[i] == expected[j]) == (group[f] == group[g])


def test_embedding_distance_is_a_lower_bound(spark):
    rng = random.Random(4)
    rows = [(int(np.uint64(rng.getrandbits(64)).astype(np.int64)), int(np.uint64(rng.getrandbits(64)).astype(np.int64))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").select(
        "a", "b", F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("low")
    )
    for r in df.collect():
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        manhattan = sum(abs((a >> i & 3).bit_count() - (b >> i & 3).bit_count()) for i in range(0, 64, 2))
        assert r["low"] == manhattan <= (a ^ b).bit_count()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(2000, 2060)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in [1000, *range(2000, 2060)]}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_pack_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 1000, dtype=np.uint64).astype("<u4")
    assert (bitpack.unpack(bitpack.pack(ids, bits), bits, len(ids)) == ids).all()
    data = bitpack.shard_bytes([5, 6], np.array([400, 1000]), ids, bits)
    shard = bitpack.Shard(data)
    for a, b in ((0, 1000), (0, 0), (399, 401), (999, 1000), (100, 900)):
        assert (shard.ids(a, b) == ids[a:b]).all()
    assert bitpack.bits_for(50_257) == 16 and bitpack.bits_for(65_537) == 17 and bitpack.bits_for(1) == 1


def test_packed_blocks(monkeypatch):
    monkeypatch.setattr(bitpack, "BLOCK", 64)
    ids = np.arange(1000, dtype="<u4") % 700
    shard = bitpack.Shard(bitpack.shard_bytes([1], np.array([1000]), ids, 10))
    for a, b in ((0, 1000), (63, 65), (64, 128), (990, 1000), (130, 700)):
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_license_notice_with_edits():
    s = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES, license_scan.CHARS_PER_EDIT)
    words, exact, fuzzy = s.scan(b"Some text. Licenced under teh Apache License, v2. All rigts reserved")
    assert words == 11 and not exact
    assert ("apache", 2, 7) in {x[:3] for x in fuzzy} and "reserved" in {x[0] for x in fuzzy}
    assert s.scan(b"CC BY, cc-by; General Public License")[1] == [("cc-by", 0), ("cc-by", 2), ("gpl", 4)]
    assert not s.scan(b"licensed to kill under a bridge, all right")[2]


def test_license_seeds_lose_no_match_within_the_bound():
    """Pigeonhole: every text within the allowed edits of a notice is found."""
    rng = random.Random(5)
    s = license_scan.Scanner({}, license_scan.NOTICES, license_scan.CHARS_PER_EDIT)
    for notice, label in license_scan.NOTICES:
        k = len(notice) // license_scan.CHARS_PER_EDIT
        for _ in range(20):
            x = list(notice)
            for _ in range(k):
                x[rng.randrange(len(x))] = rng.choice(["q", ""])
            assert label in {f[0] for f in s.fuzzy(f" some words {''.join(x)} and more ")}


def _bounded_matches(notice: str, line: str, k: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) by plain edit distance at every place, the best of overlapping ones."""
    hits = []
    for a in range(len(line)):
        row = list(range(len(notice) + 1))
        for b in range(a, min(len(line), a + len(notice) + k)):
            new = [b + 1 - a]
            for j, c in enumerate(notice):
                new.append(min(row[j] + (c != line[b]), row[j + 1] + 1, new[j] + 1))
            row = new
            if row[-1] <= k:
                hits.append((row[-1], a, b + 1))
    taken: list[tuple[int, int, int]] = []
    for edits, a, b in sorted(hits):
        if all(b <= x or y <= a for x, y, _ in taken):
            taken.append((a, b, edits))
    return sorted(taken)


def test_license_notices_side_by_side():
    """Repeated notices, misspelt and exact ones in any order: as many matches of as many edits as by plain edit distance."""
    s = license_scan.Scanner({}, [("all rights reserved", "reserved")], license_scan.CHARS_PER_EDIT)
    bad, good = "all rights reservd", "all rights reserved"
    got = s.scan(" ".join([bad] * 4 + [good, bad]).encode())[2]
    assert got == [("reserved", 3 * i, 3 * i + 3, int(i != 4)) for i in range(6)]
    rng = random.Random(8)
    for notice, label in license_scan.NOTICES[:2] + license_scan.NOTICES[4:7]:
        s = license_scan.Scanner({}, [(notice, label)], license_scan.CHARS_PER_EDIT)
        k = len(notice) // license_scan.CHARS_PER_EDIT
        for _ in range(6):
            parts = []
            for _ in range(rng.randint(2, 5)):
                x = list(notice)
                for _ in range(rng.randint(0, k)):
                    x[rng.randrange(1, len(x) - 1)] = rng.choice(["q", ""])
                parts.append("".join(x))
            line = f" {' '.join(parts)} "
            expected = _bounded_matches(notice, line, k)
            assert len(expected) == len(parts)
            assert sorted(x[3] for x in s.fuzzy(line)) == sorted(e for _, _, e in expected), line


def test_pii_rules_against_the_patterns():
    rng = random.Random(6)
    parts = ["a@b.c", "x.y@z-1.co.uk", "@", "@@a@b", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (042) 555-7845", "+1", "99999999999999999999", " ", "word", "\n", ".", "a@b.c@d.e", "٣٤"]
    for _ in range(300):
        t = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(12))
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in pii.rule_spans(t)) == B.pii_base(t)["base"], t
    assert pii.rule_spans("a" * 200_000 + "@") == [] and pii.rule_spans("1" * 200_000) == []


def test_pii_contexts_find_what_no_rule_knows(frame):
    rows = [(i, f"please mail to user{i}@mail.example.com now and then {i}") for i in range(40)]
    rows += [(100 + i, f"please mail to user{i}(at)host{i}x now") for i in range(3)]
    rows += [(200 + i, f"in the year 19{i:02d}05 something happened") for i in range(40)]
    got = {r["doc"]: r for r in pii.find(frame(rows)).collect()}
    for i in range(3):
        text = rows[40 + i][1]
        assert {(a["kind"], text[a["s"] : a["e"]]) for a in got[100 + i]["added"]} == {("identifier", f"user{i}(at)host{i}x")}
    assert all(not got[200 + i]["added"] for i in range(40)) and all(len(got[i]["base"]) == 1 for i in range(40))


def test_pii_found_instances_induce_patterns(frame):
    """Identifiers found beside e-mail seeds are marked in a second context, and make it mark identifiers of its own."""
    rows = [(i, f"for help contact: user{i}@mail.example.com today") for i in range(40)]
    rows += [(100 + i, f"for help contact: EMP-{10000 + i} today") for i in range(20)]
    rows += [(200 + i, f"the employee id EMP-{10000 + i} was given out") for i in range(23)]
    rows += [(300, "see EMP-10000 about it"), (301, "in the year 190501 something happened")]
    got = {r["doc"]: r["added"] for r in pii.find(frame(rows)).collect()}
    for d, t in rows[40:84]:
        i = t.index("EMP")
        assert {(a["kind"], a["s"], a["e"]) for a in got[d]} == {("identifier", i, i + 9)}, t
    assert not got[301]


def test_pii_grouped_and_short_identifiers(frame):
    """Groups joined by blanks or hyphens, short tokens and addresses in words are mentions; the longest marked one counts."""
    rows = [(i, f"please mail to user{i}@mail.example.com now") for i in range(60)]
    whole = ["020 7946 0958", "4111 1111 111 1111", "AB 12 34 56 C", "ann at example dot org", "12-34", "X7", "GB29 NWBK 6016 1331 9268 19"]
    rows += [(100 + i, f"please mail to {w} now") for i, w in enumerate(whole)]
    got = {r["doc"]: r["added"] for r in pii.find(frame(rows)).collect()}
    for i, w in enumerate(whole):
        assert {(a["kind"], a["s"], a["e"]) for a in got[100 + i]} == {("identifier", 15, 15 + len(w))}, w
    t = "NI AB 12 34 56 C was"
    assert {"AB 12 34 56 C", "12 34 56", "34"} <= {t[m["s"] : m["e"]] for m in pii.mentions(t, [])}


def test_pii_finds_hidden_members_of_a_kind(spark):
    """Seven of eight secrets of the test table are hidden from the seeds: their contexts find them, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    secrets = {
        (r["doc_id"], m.start(), m.end())
        for r in docs.where(r"text RLIKE '[0-9a-f]{32}'").collect()
        for m in pii._SECRET.finditer(r["text"])
        if not m[0].isalpha()
    }
    got = pii.find(docs, secret_seeds=8).where("size(added) > 0").select("doc", F.explode("added").alias("a")).select("doc", "a.*").collect()
    seeds = {(r["doc"], r["s"], r["e"]) for r in got if r["kind"] == pii.SECRET}
    found = {(r["doc"], r["s"], r["e"]) for r in got if r["kind"] == pii.IDENTIFIER}
    hidden = secrets - seeds
    assert seeds <= secrets and len(hidden) > 0.75 * len(secrets)
    assert len(found & hidden) >= 0.9 * len(hidden) and len(found & hidden) >= 0.9 * len(found)


@pytest.mark.parametrize("hidden", [1, 4])
def test_pii_spans_against_plain_python(spark, hidden):
    """All added spans of a small table with nulls, repeated rows and ids, ties and shared instances."""
    rng = random.Random(5)
    contexts = ["please mail to {} now", "contact: {} today", 'key = "{}" set', "in the year {} it was", "call {} or {}"]
    rows = [(None, None), (1, ""), (2, "no data here"), (3, "please mail to X-77 now"), (3, "please mail to X-77 now"), (3, "other X-77")]
    for i in range(260):
        made = [f"user{rng.randrange(60)}@mail.example.com", f"+44 20 7946 0{rng.randrange(100, 999)}", f"{rng.getrandbits(160):040x}", f"EMP-{rng.randrange(40)}", str(rng.randrange(1900, 1999))]
        c = rng.choice(contexts)
        rows.append((rng.choice([None, i, i // 2]), c.format(*(rng.choice(made[:4] if "year" not in c else made[4:]) for _ in range(2)))))
    rows += [(1000 + i, f"a token: {rng.getrandbits(160):040x} of it") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc"], tuple(sorted(tuple(a) for a in r["added"]))) for r in pii.find(docs, secret_seeds=hidden).collect())
    assert got == Counter((d, a) for (d, _), a in zip(rows, B.pii_added([t for _, t in rows], hidden), strict=True))
    assert sum(len(a) * n for (_, a), n in got.items()) > 20 and (hidden == 1 or any(k == "identifier" for _, a in got for k, _, _ in a))


def test_label_model_separates_planted_quality(spark):
    """Rules of known accuracy: the posterior beats every rule alone and recovers who is reliable."""
    rng = random.Random(7)
    names, rows = ["r0", "r1", "r2", "r3"], []
    wrong = {"r0": 0.02, "r1": 0.1, "r2": 0.1, "r3": 0.4}
    for i in range(4000):
        good = rng.random() < 0.8
        votes = [0 if rng.random() < 0.2 else (1 if (rng.random() > wrong[r]) == good else -1) for r in names]
        rows.append((i, good, *votes))
    votes = spark.createDataFrame(rows, "id bigint, good boolean, r0 int, r1 int, r2 int, r3 int")
    model = quality.fit(votes, names)
    assert model["bad"]["r0"][-1] / model["good"]["r0"][-1] > model["bad"]["r3"][-1] / model["good"]["r3"][-1]
    right = votes.withColumn("p", quality._posterior(model, names)).where((F.col("p") >= 0.5) == F.col("good")).count()
    assert right > 0.92 * len(rows)


def test_label_model_beats_all_must_pass(spark):
    """Rules of planted accuracy through ``judge``: a vote is a base-3 digit of the text's length beyond 50 words."""
    rng = random.Random(11)
    # (a good document's bad votes, a bad document's bad votes, share of abstentions); r4 is noise.
    rules = {"r0": (0.03, 0.9, 0.3), "r1": (0.05, 0.9, 0.3), "r2": (0.05, 0.85, 0.3), "r3": (0.1, 0.8, 0.6), "r4": (0.3, 0.3, 0.1)}
    rows, truth = [], {}
    for i in range(3000):
        truth[i] = good = rng.random() < 0.35
        votes = [0 if rng.random() < skip else (-1 if rng.random() < (a if good else b) else 1) for a, b, skip in rules.values()]
        rows.append((i, " ".join(f"w{j}" for j in range(50 + sum((v + 1) * 3**k for k, v in enumerate(votes))))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    digit = {r: (F.floor((F.col("n_words") - 50) / 3**k) % 3 - 1).cast("int") for k, r in enumerate(rules)}
    got = {r["doc_id"]: r for r in quality.judge(docs, keep=["doc_id"], votes=digit).collect()}
    must = {d: r["n_bad_votes"] == 0 for d, r in got.items()}
    right = sum(r["kept"] == truth[d] for d, r in got.items())
    assert right > 0.93 * len(rows) and right > sum(must[d] == truth[d] for d in got) + 0.05 * len(rows)
    # Both ways: votes of inaccurate rules are outvoted, and documents that no accurate rule speaks for go.
    assert sum(r["kept"] and not must[d] and truth[d] for d, r in got.items()) > 200
    assert sum(must[d] and not r["kept"] and not truth[d] for d, r in got.items()) > 10


def test_quality_repeats_in_a_long_text_go_by_whole_hashes(spark):
    """Two different windows whose hashes differ in their lower 18 bits only, in a text whose positions take 18 bits."""
    fill = [f"f{i}" for i in range(140_000)]
    words = [*fill[:50_000], "q", "q", "4139091", *fill[50_000:60_000], "q", "q", "3334575", "a", "b", "c", *fill[60_000:], "a", "b", "c"]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    assert [r["n_repeat_words"] for r in quality.statistics(docs, keep=["doc_id"]).collect()] == [6]


def test_quality_against_labels(spark):
    """Held-out labels of the test tables: junk goes, good documents stay, also those that fail a single rule."""
    sf = "/root/testdata/sf0.01"
    q = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), keep=["doc_id"])
    rows = q.where(~F.col("base_failed")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.2 * len(junk)
    must = [r["n_bad_votes"] == 0 for r in rows if r["quality"] == 1]
    assert sum(good) >= sum(must)


def test_html_on_held_out_layouts():
    """Each labelled page by a model of all others: nearly all blocks right."""
    right = total = 0
    for i, html in enumerate(PAGES):
        model = html_extract.Model(PAGES[:i] + PAGES[i + 1 :])
        page, labels = html_extract.Page(html), []
        for n in page.nodes:
            labels.append(int(n.y) if n.y is not None else labels[n.parent] if n.parent >= 0 else 0)
        p = model.marginals(page)
        right += sum((p[n] >= 0.5) == bool(labels[n]) for n, _ in page.blocks)
        total += len(page.blocks)
    assert right >= 0.97 * total


def test_html_on_layouts_of_other_markup():
    """Pages that are no variation of the labelled ones: article headers, link-only references, camel case, bare markup."""
    model = html_extract.Model(PAGES)
    right = found = wanted = 0
    for html, blocks in LAYOUTS:
        got = model.text(html).split("\n")
        right += sum((Counter(got) & Counter(blocks)).values())
        found, wanted = found + len(got), wanted + len(blocks)
        assert [x for x in got if x in blocks] == [x for x in blocks if x in got]  # page order
    assert right >= 0.97 * found and right >= 0.97 * wanted


def test_html_very_long_page(spark):
    """A page of some megabytes, whole, beside columns named like the operator's own."""
    text = "\n".join(f"Paragraph {i} of a very long page with a few words in it." for i in range(60_000))
    html = f"<body><nav><a href='/'>Home</a></nav><article>{''.join(f'<p>{x}</p>' for x in text.split(chr(10)))}</article></body>"
    pages = spark.createDataFrame([(1, html, "x", "y", "z")], "page_id bigint, html string, c0 string, n_chars string, url string")
    row = html_extract.extract(pages).first()
    assert row["text"] == text and (row["c0"], row["n_chars"], row["url"]) == ("x", "y", "z")


def test_html_marginals_are_those_of_the_joint_distribution():
    """Sum-product against summing over all labellings of a small tree."""
    from itertools import product
    from math import exp

    model = html_extract.Model(PAGES)
    page = html_extract.Page('<body><nav><p>Menu here</p></nav><article><p>Some text</p><div class="ad">Buy</div></article></body>')
    n = len(page.nodes)
    odds = [sum(model.odds.get(f, 0) for f in html_extract._features(x)) * (html_extract.FLOW_WEIGHT if x.tag in html_extract._FLOW and not x.words else 1) for x in page.nodes]
    odds[0] += model.root
    total, main = 0.0, [0.0] * n
    for y in product((0, 1), repeat=n):
        w = exp(sum(o for o, l in zip(odds, y, strict=True) if l))
        for i in range(1, n):
            q = model.main_if[html_extract._tie(page.nodes[page.nodes[i].parent], page.nodes[i]), y[page.nodes[i].parent]]
            w *= q if y[i] else 1 - q
        total += w
        for i in range(n):
            main[i] += w * y[i]
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(page), main, strict=True))


def test_html_markup():
    page = html_extract.Page(
        "<head><title>no</title></head><p>A&amp;B &eacute;&#33;<br>c  d<b>e</b>\n f<p>g<script>if (a < b) '</p>'</script>h<ul><li>i<li>j</ul><!-- k --><textarea>l</textarea>m < n<style>o"
    )
    assert [t for _, t in page.blocks] == ["A&B é! c de f", "gh", "i", "j", "m < n"]


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<html><head><meta charset=utf-8><title>t</title><body><article>x<p>y", ["x", "y"]),
        ("<head><link href=a><script>s</script><p>x<p>y", ["x", "y"]),
        ("<head><title>t</title>\n x <b>y</b>", ["x y"]),
        ("<head><svg><p>no</p></svg>x", ["x"]),
        ("<head><style>s</style></html>x", ["x"]),
        ("<div><button>no<p>x</p>y</div>z", ["x", "y", "z"]),
        ("<div><button>no<button>no</button>x</div>", ["x"]),
        ("<div><button><div>no</div></button>x</div>", ["x"]),
        ("<div><select><option>no<option>no<p>x</p></div>y", ["x", "y"]),
        ("<div><select><option>no<option>no</select>x</div>", ["x"]),
        ("<p>so <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds", ["so a=1 holds"]),
        ("<object data=f>v</object> <canvas>w</canvas> <audio src=a>x</audio> <video><source src=b>y</video>", ["v w x y"]),
    ],
)
def test_html_missing_ends_and_fallback(html, blocks):
    assert [t for _, t in html_extract.Page(html).blocks] == blocks


def test_slices_cover_the_batch():
    import pyarrow as pa

    from cohortlens.llm.common import slices

    texts = ["a", None, "bb" * 50, "", "ccc", "d" * 9, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    for size in (1, 10, 1000):
        parts = list(slices(batch, 1, size))
        assert [t for p in parts for t in p.column(1).to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= size for p in parts)
    assert not list(slices(batch.slice(0, 0), 1, 10))


def test_simhash_blocks_keep_chance_meetings_in_proportion_to_the_points():
    """Expected random pairs of a cell stay under the cells themselves, at every number of points."""
    before = 0
    for n in (0, 1, 10**5, 10**6, 10**7, 10**8, 10**9, 10**10):
        blocks = simhash.blocks_for(n)
        assert blocks >= before
        before = blocks
        assert n * 0.375 ** (32 * (blocks - 4) / blocks) < 2


@pytest.mark.parametrize("blocks", [8, 9, 10, 12, 16])
def test_simhash_links_are_those_of_all_pairs_at_every_number_of_blocks(spark, blocks):
    rng = random.Random(blocks)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for f in fps for _ in range(3)]
    fps = sorted({int(np.uint64(f).astype(np.int64)) for f in fps})
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {(min(r), max(r)) for r in simhash.links(table, blocks=blocks).collect()}
    assert got == set(near)


def test_line_dedup_of_a_text_of_many_dropped_lines(spark):
    """Positions, not a search of the dropped keys for each line: 60,000 lines of which two thirds go."""
    lines = [f"line number {i} of a very long text" if i % 3 else f"own {i}" for i in range(60_000)]
    own = "\n".join(x for i, x in enumerate(lines) if i % 3 == 0)
    docs = spark.createDataFrame([(i, "\n".join(lines)) for i in (1, 2, 3)] + [(1, "x\nline number 1 of a very long text \nx")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_lines"]): (r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    assert got == {(1, 60_000): (40_000, own), (2, 60_000): (40_000, own), (3, 60_000): (0, "\n".join(lines)), (1, 3): (1, "x\nx")}
