"""Spans of texts with very many matches: running values, overlaps and replacements against plain versions, bounded time."""

from __future__ import annotations

import itertools
import random
import time

from pyspark.sql import functions as F

from lorekeep.llm import pii, secrets, spans


def test_running_values(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 4)
    rng = random.Random(1)
    rows = [(k, [rng.randrange(-9, 20) for _ in range(n)]) for k, n in enumerate([0, 1, 3, 4, 5, 8, 9, 50])]
    df = spark.createDataFrame(rows, "k int, v array<long>")
    got = {r["k"]: (r["a"], r["b"]) for r in df.select("k", spans.running(F.col("v"), spans.plus, 0).alias("a"), spans.running(F.col("v"), F.greatest, -100).alias("b")).collect()}
    assert got == {k: (list(itertools.accumulate(v)), list(itertools.accumulate(v, max))) for k, v in rows}


def test_overlaps_and_replacements(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 4)
    rng = random.Random(2)
    rows = []
    for k in range(60):
        some = lambda: [(s, rng.randrange(3), rng.choice("ab"), s + rng.randrange(1, 9), "v") for s in sorted(rng.randrange(60) for _ in range(rng.randrange(0, 14)))]
        rows.append((k, "é" + "".join(rng.choice("xyz ") for _ in range(80)), some(), some()))
    df = spark.createDataFrame(rows, f"k int, t string, a array<{spans.SPAN}>, b array<{spans.SPAN}>")
    got = df.select("k", spans.free_of(F.col("a"), F.array_sort("b")).alias("free"), spans.replaced(F.col("t"), F.array_sort("a")).alias("t")).collect()
    for r, (k, text, a, b) in zip(sorted(got), rows):
        assert [tuple(x) for x in r["free"]] == sorted(x for x in a if not any(y[0] < x[3] and x[0] < y[3] for y in b))
        out, p = "", 0
        for s, _, kind, e, _ in sorted(a):
            if s >= p:
                out += text[p:s] + f"<{kind.upper()}>"
            p = max(p, e)
        assert r["t"] == out + text[p:]


def test_many_matches_take_bounded_time(spark):
    n = 30_000
    mails = " ".join(f"user{i}@mail{i % 7}.example.com" for i in range(n))
    docs = spark.createDataFrame([(1, mails), (2, " ".join(f"{i:020x}" for i in range(n))), (3, "a@b.c " * 10)], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert found[1]["n_email"] == n and found[3]["n_email"] == 10 and found[1]["spans"].startswith("email:0:23,email:24:47,")
    assert {r["doc_id"]: r["n_hex"] for r in secrets.detect(docs).collect()}[2] == n
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[1] == " ".join(["<EMAIL>"] * n)
    assert time.time() - began < 120
