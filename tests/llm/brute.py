"""Plain-Python statements of the query contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}
WS = " \t\n\x0b\x0c\r"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def low(s: str | None) -> str:
    return (s or "").translate(UPPER)


def licenses_base(text: str | None) -> dict:
    words = ALNUM.findall(low(text))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    at, labels = [], set()
    for p, label in phrases.items():
        p = p.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return dict(
        n_words=len(words), n_base=len(at), first_word=min(at, default=None), last_word=max(at, default=None), base_labels=",".join(sorted(labels))
    )


def quality_stats(text: str | None) -> dict:
    t = text or ""
    w = SPACED.findall(t)
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return dict(
        n_words=len(w),
        word_chars=sum(map(len, w)),
        n_symbols=len(re.findall(r"[#*$%&|<>]", t)),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=len(covered),
        base_failed=len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


def quality_votes(text: str | None) -> list[int]:
    """The rules' votes in plain Python: -1 bad, 1 good, 0 abstains."""
    t, s = text or "", quality_stats(text)
    w = SPACED.findall(t)
    n, lines = max(1, len(w)), max(1, sum(1 for x in t.split("\n") if SPACED.search(x)))
    graded = [
        (s["word_chars"] / n, (3, 7), (4, 6.5)),
        (s["n_symbols"] / n, (None, 0.1), (None, 0.01)),
        (s["n_repeat_words"] / n, (None, 0.3), (None, 0.1)),
        (s["n_dup_lines"] / lines, (None, 0.3), (None, 0.1)),
        (2 * len(re.findall("[A-Z]{2}", t)) / max(1, s["word_chars"]), (None, 0.2), (None, 0.05)),
        (t.count("!") / n, (None, 0.1), (None, 0.02)),
    ]
    votes = [-1 if len(w) < 50 else int(len(w) >= 80)]
    variety = len(set(w)) / n
    votes.append(-1 if variety < 0.3 and n <= 2000 else int(variety > 0.5))
    for x, (low, high), (least, most) in graded:
        bad = x > high or (low is not None and x < low)
        votes.append(-1 if bad else int((least is None or x >= least) and x <= most))
    return votes


def label_model(votes: list[list[int]], rounds: int = 40, belief: float = 0.9, weight: float = 1.0, smooth: float = 0.1) -> list[float]:
    """P(good) of each row of votes, document by document."""
    good = [(v.count(1) + 1) / (v.count(1) + v.count(-1) + 2) for v in votes]
    last = None
    for _ in range(rounds):
        share = (sum(good) + smooth) / (len(good) + 2 * smooth)
        rates = []
        for r in range(len(votes[0]) if votes else 0):
            bad = [sum(g for g, v in zip(good, votes, strict=True) if v[r] == -1), sum(1 - g for g, v in zip(good, votes, strict=True) if v[r] == -1)]
            fine = [sum(g for g, v in zip(good, votes, strict=True) if v[r] == 1), sum(1 - g for g, v in zip(good, votes, strict=True) if v[r] == 1)]
            n = sum(bad)
            bad = [(b + weight * x * n) / (1 + weight) for b, x in zip(bad, (1 - belief, belief), strict=True)]
            rates.append([(b + smooth) / (b + f + 2 * smooth) for b, f in zip(bad, fine, strict=True)])
        good = []
        for v in votes:
            a, b = share, 1 - share
            for vote, (p, q) in zip(v, rates, strict=True):
                if vote:
                    a, b = (a * p, b * q) if vote < 0 else (a * (1 - p), b * (1 - q))
            good.append(a / (a + b))
        flat = [x for pair in rates for x in pair]
        if last and max(abs(x - y) for x, y in zip(flat, last, strict=True)) < 1e-4:
            break
        last = flat
    return good


def quality_kept(rows: list[tuple[int, str | None]]) -> set[int]:
    """Ids that pass the base rule and the label model, which is estimated on those that pass the base rule."""
    passed = [(d, quality_votes(t)) for d, t in rows if not quality_stats(t)["base_failed"]]
    return {d for (d, _), p in zip(passed, label_model([v for _, v in passed]), strict=True) if p >= 0.5}


def suffix_repeats(docs: list[tuple[int, str | None]], length: int = 400) -> dict[int, dict]:
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = {}
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = dict(n_bytes=len(b), n_removed=sum(gone), n_spans=spans, kept_sha256=sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def pii_base(text: str | None) -> dict:
    t = text or ""
    found: dict[str, list] = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        found["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found["phone"].append(m.span())
    digest = ",".join(f"{k}:{s}:{e}" for k in found for s, e in found[k])
    return {f"n_{k}": len(v) for k, v in found.items()} | {"base_sha256": sha(digest.encode()), "base": digest}


def line_dedup(docs: list[tuple[int, str | None]]) -> dict[int, dict]:
    key = lambda x: low(x.strip(WS))
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == d]
        out[d] = dict(n_lines=len(lines), n_dropped=len(lines) - len(kept), kept_sha256=sha("\n".join(kept).encode()), kept="\n".join(kept))
    return out


def decontam(docs, benchmark, n: int = 10) -> dict[int, dict]:
    windows = defaultdict(set)
    for item, t in benchmark:
        w = ALNUM.findall(low(t))
        if w:
            k = min(n, len(w))
            for i in range(len(w) - k + 1):
                windows[tuple(w[i : i + k])].add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w = ALNUM.findall(low(t))
        hit, items = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    items |= got
        out[d] = dict(
            n_words=len(w), n_hit=len(hit), n_items=len(items), items_sha256=sha(",".join(sorted(map(str, items))).encode()), contaminated=bool(hit)
        )
    return out


def simhash_fp(text: str | None, k: int = 4) -> int:
    w = SPACED.findall(low(text))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: dict[int, int], bits: int = 4) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def crc_of(ids: list[int]) -> int:
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def spelling_words(docs) -> dict[str, int]:
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def spelling(words: dict[str, int]) -> dict[str, dict]:
    by_rest = defaultdict(set)  # words that are near or equal share a word with at most one letter gone
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest[rest].add(w)
    near = defaultdict(set)
    for group in by_rest.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = dict(form=form[w], root=root, n=n, n_near=len(near[w]), form_n=words.get(form[w]))
    return out


def filter_audit(docs, labels) -> dict[tuple, dict]:
    """``docs``: (doc_id, text, lang); ``labels``: (doc_id, quality, toxic)."""
    from itertools import permutations

    ids = defaultdict(list)
    for d, t, _ in docs:
        ids[t or ""].append(d)
    good, toxic = ({r[0] for r in labels if r[i] == 1} for i in (1, 2))
    parts = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = SPACED.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": d is not None and any(x is not None and x < d for x in ids[t]),
        }
        parts[lang or ""].append(({f for f in fails if fails[f]}, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] += len(gone)
                out[part, order, step] = dict(
                    kept=len(left),
                    removed=len(gone),
                    redundant=sum(f in r[0] for r in rows) - len(gone),
                    unique_fails=sum(r[0] == {f} for r in rows),
                    good_lost=sum(r[1] for r in gone),
                    toxic_lost=sum(r[2] for r in gone),
                )
        for key in [k for k in out if k[0] == part]:
            out[key]["shapley"] = total[key[1][key[2] - 1]]
    return out


def pii_added(texts: list[str | None], secret_seeds: int = 1, rounds: int = 3, sure: float = 0.8, support: int = 5) -> list[tuple]:
    """Sorted (kind, start, end) that the bootstrapping adds to each text, over dicts; mentions and their patterns as the operator reads them."""
    from cohortlens.llm import pii

    places = [pii.mentions(t or "", pii.rule_spans(t or ""), secret_seeds) for t in texts]
    edge: dict[tuple, str | None] = {}
    for m in (m for ms in places for m in ms):
        for p in m["pats"]:
            edge[p, m["inst"]] = max(filter(None, (edge.get((p, m["inst"])), m["kind"])), default=None)
    seed_kinds = defaultdict(set)
    of_pattern = defaultdict(list)
    for (p, i), k in edge.items():
        of_pattern[p].append(i)
        if k:
            seed_kinds[i].add(k)
    of_pattern = {p: x for p, x in of_pattern.items() if len(x) >= support}
    score = {(i, k): 1.0 for i, ks in seed_kinds.items() for k in ks}
    conf: dict = {}
    for _ in range(rounds):
        conf, backed = {}, {}
        for p, inst in of_pattern.items():
            n_seeds = sum(edge[p, i] is not None for i in inst)
            backed[p] = 0
            for k in {k for i, k in score if i in set(inst)}:
                mine = [(score[i, k], k in seed_kinds[i]) for i in inst if (i, k) in score]
                total, own = sum(x for x, _ in mine), sum(s for _, s in mine)
                share = 1 / secret_seeds if k == "secret" else 1
                n = sum(x >= sure for x, _ in mine)
                backed[p] += n
                conf[p, k] = (total / (total + n_seeds - own + share * (len(inst) - n_seeds - (total - own)) + 1), n)
        score = {(i, k): 1.0 for i, ks in seed_kinds.items() for k in ks}
        kinds = {k for _, k in conf}
        stands = defaultdict(list)
        for p, inst in of_pattern.items():
            for i in inst if backed[p] >= support else ():
                if not seed_kinds[i]:
                    stands[i].append(p)
        for i, ps in stands.items():
            for k in kinds:
                c = [conf.get((p, k), (0.0, 0))[0] for p in ps]
                miss = 1.0
                for x in c:
                    miss *= 1 - x
                x = (1 - miss) * min(1, 2 * sum(c) / len(c))
                if x >= 0.5:
                    score[i, k] = x
    marks = {p for (p, _), (c, n) in conf.items() if c >= sure and n >= support}
    accepted = {i for (i, _), x in score.items() if x >= sure}
    out = []
    for ms in places:
        found = {(m["s"], m["e"]): "secret" for m in ms if m["kind"] == "secret"}
        for m in ms:
            if m["kind"] is None and (m["inst"] in accepted or marks.intersection(m["pats"])):
                found.setdefault((m["s"], m["e"]), "identifier")
        out.append(tuple(sorted((k, a, b) for (a, b), k in found.items() if not any((x <= a and y >= b) and (x, y) != (a, b) for x, y in found))))
    return out
