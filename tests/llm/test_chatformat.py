"""op13: exact round trips, one emission per distinct beginning, positions and attention of every segment, the SQL."""

from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from lorekeep.llm import chatformat, twins
from lorekeep.llm.queries import tokenizer_files

from .test_prefixes import SCHEMA, ordered

NAMES = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    odd = ["", "\\", "<|", "<\\|", "\\<|im_end|>", "<|endoftext|> <|im_start|>user", "a\nb\\n", "é 漢字 😀", "x" * 5000, None, "|", "<", "\n"]
    out = [(c, t, rng.choice(["user", "assistant", "assistant", "sys\ntem<|", None]), rng.choice(odd)) for c in range(30) for t in range(rng.randrange(1, 8))]
    for c in range(40, 70):  # common beginnings, copies and proper prefixes
        out += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t if t < c % 5 else (t, c % 3)}") for t in range(rng.randrange(1, 9))]
    return out + [(3, None, "user", "no number"), (4, 1, "user", "same"), (4, 1, "user", "same"), (None, 0, "user", "nobody")]


def test_round_trip_equals_the_sql(spark, rows):
    got = {tuple(r) for r in chatformat.checked(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", owner int"), *tokenizer_files()).select(*NAMES.split(", ")).collect()}
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.sql("create view conversations as select * from frame")
    assert got == {tuple(r) for r in con.sql(f"select {NAMES} from ({twins.FORMATTED})").fetchall()}


def test_segments(spark, rows):
    segments, members = chatformat.formatted(spark.createDataFrame(rows, SCHEMA), *tokenizer_files())
    conv, decode = ordered(rows), chatformat._decoder(tokenizer_files()[0])
    held, where = segments.collect(), {r["conv_id"]: (r["owner"], r["depth"]) for r in members.collect()}
    assert len(held) == len({tuple(v[:d]) for v in conv.values() for d in range(1, len(v) + 1)})  # shared turns once
    trees, by = defaultdict(list), {}
    for s in held:
        trees[s["tree"]].append(s)
        by[s["owner"], s["depth"]] = s
    tokens = {}
    for t, rows_ in trees.items():
        rows_.sort(key=lambda s: s["offset"])
        at = 0
        for s in rows_:  # gapless
            assert s["offset"] == at and s["length"] == len(s["ids"]) // 4
            at += s["length"]
        tokens[t] = np.concatenate([np.frombuffer(s["ids"], "<u4") for s in rows_])
        # depth first: what starts after a segment and attends to it is contiguous
        for s in rows_:
            under = [k for k, x in enumerate(rows_) if any(a["lo"] <= s["offset"] < a["hi"] for a in x["attends"])]
            assert under == list(range(under[0], under[0] + len(under))) if under else True
    for c, v in conv.items():
        last = by[where[c]]
        runs = [(a["lo"], a["hi"]) for a in last["attends"]] + [(last["offset"], last["offset"] + last["length"])]
        seen = np.concatenate([tokens[last["tree"]][lo:hi] for lo, hi in runs])
        assert last["position"] == len(seen) - last["length"]
        want = "".join("<|im_start|>" + chatformat.escaped(role).replace("\n", "\\n") + "\n" + chatformat.escaped(text) + "<|im_end|>\n" for role, text in v)
        assert decode(seen) == want
    assert all((s["loss_hi"] > 0) <= (chatformat.plain(decode(np.frombuffer(s["ids"], "<u4")).split("\n")[0][12:]) == "assistant") for s in held)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert [r["conv_id"] for r in chatformat.checked(empty, *tokenizer_files()).collect()] == [-1]
    assert all(not x.collect() for x in chatformat.formatted(empty, *tokenizer_files()))
