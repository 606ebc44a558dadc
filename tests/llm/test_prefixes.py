"""op12 and the z-fast trie: random conversations against plain nodes, awkward rows, long chains, the SQL."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from lorekeep.llm import prefixes, trie, twins

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def ordered(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    return {c: [(x[2], x[4]) for x in sorted(v)] for c, v in conv.items()}


def brute(rows):
    own = ordered(rows)
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k in nodes:
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(nodes[k]) - 1) * len(k[-1][1]) if k else 0
    return {
        (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, sorted(c for c in m if len(made[c]) == len(k))))))
        for k, m in nodes.items()
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = []
    for c in [*range(0, 60), *range(97, 140), 250, 251, -3, -104, 1000]:
        text = ["x" * rng.randrange(3) for _ in range(rng.randrange(1, 12))]
        out += [(c, t, rng.choice(["user", "assistant"]) if t % 3 else "user", x) for t, x in enumerate(text)]
    out += [(3, None, "user", "first"), (4, 1, None, None), (4, 1, None, None), (5, 2, "a", "tie"), (5, 2, "b", "tie"), (5, 2, "a", "tie2"), (None, 1, "user", "nobody")]
    out += [(c, t, "user", f"long {t}") for c in (400, 401, 402) for t in range(70 - c % 3)]  # proper prefixes of one another
    return out


def test_nodes_against_plain_ones(spark, rows):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", depth int, fa string")
    got = [tuple(r) for r in prefixes.shared(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_sql_against_plain_nodes(rows):
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.sql("create view conversations as select * from frame")
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert {tuple(r) for r in con.sql(f"select {names} from ({twins.PREFIXES})").fetchall()} == brute(rows)


def test_many_copies_and_one_turn(spark):
    rows = [(100 * c, t, "user", f"t{t}") for c in range(120) for t in range(6)] + [(100 * c + 1, 0, "user", "hi") for c in range(60)]
    assert {tuple(r) for r in prefixes.shared(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_empty(spark):
    assert not prefixes.shared(spark.createDataFrame([], SCHEMA)).collect()
    assert not prefixes.shared(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect()


def test_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 40) for a in range(b)] + [(5, 2**40 + 3)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for r in got[:-1]:
        assert r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x)
    assert got[-1]["f"] == 2**40
