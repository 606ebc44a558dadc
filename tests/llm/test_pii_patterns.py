"""op9: the bootstrapped patterns against a plain least fixed point."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import regex

from . import brute


def plain_spans(texts, confident, support, shortest):
    """Further spans of each text: counts, graph and rounds in plain Python."""
    from lorekeep.llm import pii

    cand, word = regex.compile(pii.CANDIDATE), regex.compile(r"[\p{L}\p{M}'_-]+")
    base = []
    for t in texts:
        base.append([(m.start(), m.end(), name, m[0]) for name, rx, ok in brute.PII for m in regex.finditer(rx, t) if ok(m)])
    seen, total, rows = Counter(), Counter(), []
    for i, t in enumerate(texts):
        words = [m[0] for m in word.finditer(t.lower())]
        total.update(words)
        total.update(" ".join(p) for p in zip(words, words[1:]))
        found = list(cand.finditer(t))
        for k, m in enumerate(found):
            seeds = sorted(b for b in base[i] if m.start() <= b[0] < m.end())
            if not seeds and len(m[0]) < shortest:
                continue
            before = t[found[k - 1].end() if k else 0 : m.start()].lower()
            after = t[m.end() : found[k + 1].start() if k + 1 < len(found) else len(t)].lower()
            own = []
            near = [x for x in word.finditer(before)]
            if near and len(before) - near[-1].end() <= 6 and not regex.search("[0-9]", before[near[-1].end() :]):
                own.append(("before", near[-1][0]))
                if len(near) > 1:
                    own.append(("two before", near[-2][0] + " " + near[-1][0]))
            x = word.search(after)
            if x and x.start() <= 6 and not regex.search("[0-9]", after[: x.start()]):
                own.append(("after", x[0]))
            rows.append((i, m.start(), m.end(), seeds[0][3] if seeds else m[0], seeds[0][2] if seeds else None, own))
    edges = defaultdict(Counter)
    for *_, v, kind, own in rows:
        for p in own:
            edges[p][v, kind] += 1
    instances, trusted = {(v, kind) for p in edges for v, kind in edges[p] if kind}, {}
    while True:
        now = {}
        for p, vs in edges.items():
            for kind in ("email", "ip", "card", "phone"):
                good = {(v, k): n for (v, k), n in vs.items() if k == kind or k is None and (v, kind) in instances}
                trust = sum(good.values()) / (total[p[1]] + 1)
                if len(good) >= support and trust >= confident:
                    now[p, kind] = trust
        if now.keys() == trusted.keys():
            break
        trusted = now
        instances |= {(v, kind) for p, kind in trusted for v, k in edges[p] if k is None}
    out = [set() for _ in texts]
    order = ["email", "ip", "card", "phone"]
    for i, s, e, v, kind, own in rows:
        near = [(trust, -order.index(k), k) for (p, k), trust in trusted.items() if p in own]
        if kind is None and near and not any(b[0] < e and s < b[1] for b in base[i]):
            out[i].add(f"{max(near)[2]}:{s}:{e}")
    return out, trusted


def test_patterns_equal_the_plain_fixed_point(spark):
    from lorekeep.llm import pii

    rng = random.Random(12)
    ident = lambda: rng.choice((f"user_{rng.randrange(60)}x", f"{rng.randrange(100, 130)}-{rng.randrange(10, 20)}", f"(0{rng.randrange(20, 30)}) 946 00{rng.randrange(10, 14)}"))
    kinds = {"call": lambda: f"+1 212 555 01{rng.randrange(10, 60)}", "write": lambda: f"u{rng.randrange(40)}@ex.org", "reach": ident, "dial": ident, "see": lambda: rng.choice((ident(), f"10.0.0.{rng.randrange(200)}")), "it": ident}
    texts = []
    for _ in range(260):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(list(kinds))
            value = ident() if rng.random() < 0.3 else kinds[w]()
            parts.append(rng.choice((f"please {w} to {value} soon", f"{w}: {value}, or", f"we {w} us at {value}", f"and it was {w} of no use.")))
        texts.append(" ".join(parts))
    for confident in (0.2, 0.35, 0.5):
        want, trusted = plain_spans(texts, confident, 3, 5)
        got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), confident=confident).collect()}
        for i, t in enumerate(texts):
            spans = set(filter(None, got[i]["spans"].split(",")))
            assert spans - set(brute.base_spans(t, brute.PII)[2].split(",")) == want[i], t
            assert got[i]["n_more"] == len(want[i])
        if confident < 0.3:
            assert trusted and any(want)


def test_contexts_of_plain_words_and_labels_at_two_hops(spark):
    from lorekeep.llm import pii

    rows = [(i, f"contact: user{i}@mail.example.com end") for i in range(9)] + [(20 + i, f"contact: handle_{i}77 end") for i in range(6)] + [(40 + i, f"kontakt: handle_{i}77 fin") for i in range(6)]
    rows += [(60, "kontakt: unseen_person99"), (61, "call me at (0207) 946 0018 now"), (62, "call me at 020 7946 0018")]
    rows += [(100 + i, f"please call me at +1 (212) 555-01{10 + i} today") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.detect(df).collect()}
    assert got[60] == "email:9:24" and got[61] == "phone:11:26" and got[62] == "phone:11:24"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[60] == "kontakt: <EMAIL>" and clean[61] == "call me at <PHONE> now"


def test_awkward_rows_and_columns(spark):
    from lorekeep.llm import pii

    rows = [(None, None, "a"), (1, "", "b"), (1, "x" * 200_000 + " 12345", "c"), (2, "1@" * 20_000, None), (2, "1@" * 20_000, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, _base string, trust double")
    got = pii.detect(df).collect()
    assert len(got) == 5 and sorted((r["doc_id"] is None, r["n_more"]) for r in got) == [(False, 0)] * 4 + [(True, 0)]
    clean = pii.redact(df)
    assert clean.columns == df.columns and sorted(str(r["text"])[:5] for r in clean.collect()) == sorted(["None", "", "xxxxx", "1@1@1", "1@1@1"])
