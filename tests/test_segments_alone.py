"""Slots that do not depend on others are folded by themselves, whatever the rest of the log does."""

from __future__ import annotations

import random

from lorekeep.operators import fold, segments

from .test_segments import SCHEMA, random_log


def own_log(rng, conv, n, slots):
    """Operations that each name one slot."""
    out = []
    for msg in range(1000, 1000 + n):
        slot = f"own{rng.randrange(slots)}"
        op = rng.choice(["add", "add", "supersede", "close", "invalidate", "reinforce", "update", "noop"])
        out.append((conv, msg, 0, op, rng.choice(["state", "knowledge", "event"]), slot if rng.random() < 0.9 else None, rng.choice("ab"), None, None, None, slot, None, None, rng.choice([None, "c"]), rng.choice([None, "closed"]), None))
    return out


def test_mixed_logs(spark):
    rng = random.Random(5)
    rows = random_log(rng, 1, 80) + own_log(rng, 1, 200, 12) + own_log(rng, 2, 60, 3)
    rows += [(1, 2000, 0, "update", None, None, None, None, None, "m1003_0", None, None, "s1", None, None, None), (2, 1001, 0, "add", "state", "own9", "twice", None, None, None, None, None, None, None, None, None)]
    log = spark.createDataFrame(rows, SCHEMA)
    alone = {tuple(r) for r in segments._alone(log, 50).collect()}
    assert 5 < len(alone) < 15 and all(s.startswith("own") for _, s in alone)
    assert {tuple(r) for r in segments.apply_ops(log, size=50).collect()} == {tuple(r) for r in fold.apply_ops(log).collect()}


def test_folded_once(spark, monkeypatch):
    """Before, every segment was told what the others had left, round after round."""
    monkeypatch.setattr(segments, "_told", lambda outs: 1 / 0)
    log = spark.createDataFrame(own_log(random.Random(6), 1, 300, 40), SCHEMA)
    assert {tuple(r) for r in segments.apply_ops(log, size=30).collect()} == {tuple(r) for r in fold.apply_ops(log).collect()}
