"""op11: bounds of grams on random edits, near words and forms against all pairs, awkward tables, the query against its SQL."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from lorekeep.llm import spelling, twins

LETTERS = "abcdé"


def edited(rng, word, letters):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    new = rng.choice(letters)
    return word[:i] + new + word[i:] if kind == 0 else word[:i] + (new if kind == 1 else "") + word[i + 1 :]


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_words_one_apart_share_a_listed_gram():
    rng = random.Random(11)
    for _ in range(400):
        letters = LETTERS[: rng.choice([2, 3, 5])]
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 14))) for _ in range(20)]
        pairs = [(w, edited(rng, w, letters)) for w in words]
        count = Counter(w[p : p + k] for pair in pairs for w in pair for k in range(spelling.LEAST, spelling.MOST) for p in range(len(w) - k + 1))
        limit = rng.choice([2, 4, 8, 20])
        known = {g: m for g, m in count.items() if m >= limit}

        def listed(w):
            kept = spelling.grams(w, known)
            loses = spelling.bound(w, kept, known)
            out = {(g, p) for _, g, p in sorted((known.get(w[p:e], 0), w[p:e], p) for p, e in kept)[: loses + 1]}
            if loses >= len(kept):
                out |= {(" " + g, p) for _, g, p in sorted((known.get(w[p : p + 3], 0), w[p : p + 3], p) for p in range(len(w) - 2))[:4]}
            return out

        for a, b in pairs:
            if a != b and min(len(a), len(b)) >= 7:
                assert any(g == h and abs(p - q) <= 1 for g, p in listed(a) for h, q in listed(b)), (a, b)


def brute(rows):
    count: Counter = Counter()
    import re

    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 7
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_apart(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(7, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "bababab"]
    words = []
    for s in stems:
        words += [s] * rng.choice([2, 30, 300])
        for _ in range(6):
            v = edited(rng, s, "abcdefgé")
            words += [v] * rng.choice([1, 2, 3, 20])
            words += [edited(rng, v, "abé")] * 2
    rng.shuffle(words)
    texts = [" ".join(rng.choice([w, w.upper(), w + "-x1"]) for w in words[i : i + 40]) for i in range(0, len(words), 40)]
    return [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (7, texts[1]), (7, texts[1]), (8, None), (9, ""), (10, "x " * 50_000 + "zzzzzzz zzzzzzz"), (11, "Z" * 100_000), (12, "Z" * 100_000)]


def test_near_words_and_forms_against_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "RARE", 15)
    docs = spark.createDataFrame([(d, t, "w", 3) for d, t in rows], "doc_id long, text string, word string, n int")
    found = [tuple(r) for r in spelling.variants(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_lists_of_any_length(spark, monkeypatch):
    """Words that all share every gram but one letter, and lists cut into blocks."""
    monkeypatch.setattr(spelling, "LIST", 8)
    words = [f"commonstem{chr(97 + i)}{chr(97 + j)}ending" for i in range(20) for j in range(20)]
    dictionary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {tuple(sorted(r)) for r in spelling.near(dictionary).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_apart(a, b)}


def test_query_equals_its_sql(spark, rows):
    con = duckdb.connect()
    con.register("frame", pd.DataFrame([(d, t) for d, t in rows if d != 11 and d != 12], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.sql("create view documents as select doc_id::bigint as doc_id, text from frame")
    assert {tuple(r) for r in con.sql(f"select word, form, root, n, n_near, form_n from ({twins.SPELLING})").fetchall()} == brute([(d, t) for d, t in rows if d != 11 and d != 12])


def test_empty_table(spark):
    assert not spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect()
