"""The fold in segments equals the fold in order, on random logs with moves between slots, targets by id and ends."""

from __future__ import annotations

import random

import pytest

from lorekeep.operators import fold, segments

SCHEMA = "conv_id long, msg long, op_idx int, op string, kind string, slot string, text string, status string, importance string, target_id string, target_slot string, new_kind string, new_slot string, new_text string, new_status string, new_importance string"


def random_log(rng, conv, n, slots=6):
    rows = []
    for msg in range(n):
        for k in range(rng.choice([1, 1, 2])):
            op = rng.choice(["add", "add", "add", "supersede", "close", "invalidate", "reinforce", "update", "update", "noop"])
            slot = rng.choice([f"s{rng.randrange(slots)}", f"s{rng.randrange(slots)}", None])
            named = rng.random() < 0.25
            some = lambda p, *x: rng.choice(x) if rng.random() < p else None
            rows.append((
                conv, msg, k, op, rng.choice(["state", "knowledge", "event", "belief"]) if op in ("add", "supersede") and rng.random() < 0.9 else None if op != "add" else "state",
                slot, rng.choice(["a", "b", " a "]), some(0.1, "closed", "active"), some(0.3, "high", "low"), f"m{rng.randrange(max(1, msg))}_{rng.randrange(2)}" if named else None,
                None if named and rng.random() < 0.5 else f"s{rng.randrange(slots)}", some(0.2, "belief"), some(0.4, f"s{rng.randrange(slots)}"), some(0.4, "a", "c"), some(0.3, "active", "closed", "invalid"), some(0.2, "critical"),
            ))
    return rows


@pytest.mark.parametrize("seed,size", [(1, 7), (2, 40)])
def test_equal_to_the_fold_in_order(spark, seed, size):
    rng = random.Random(seed)
    rows = random_log(rng, 1, 400) + random_log(rng, 2, 60, slots=2) + random_log(rng, 3, 3) + random_log(rng, 4, 200, slots=50)
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in fold.apply_ops(log).collect()}
    got = segments.apply_ops(log, size=size)
    assert got.columns == fold.apply_ops(log).columns
    assert {tuple(r) for r in got.collect()} == want and len(want) > 200


def test_empty_and_short_tables(spark):
    assert not segments.apply_ops(spark.createDataFrame([], "conv_id long, msg long, op string")).collect()
    log = spark.createDataFrame([(1, 1, "add", "state", "x", "t")], "conv_id long, msg long, op string, kind string, slot string, text string")
    assert [tuple(r) for r in segments.apply_ops(log).collect()] == [tuple(r) for r in fold.apply_ops(log).collect()]
