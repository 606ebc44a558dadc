"""Scenes against an ordered pass, with stretches of few records."""

from __future__ import annotations

import random

from lorekeep.operators import derived


def plain(rows, most):
    out, place, branch, n = [], None, None, most
    for turn, location, b, _ in rows:
        if n >= most or b != branch or (location and place and location != place):
            out.append([0, turn, turn, None])
            n, place = 0, None
        n, branch, place = n + 1, b, location or place
        out[-1][0], out[-1][2], out[-1][3] = n, turn, place
    return [(k, *x) for k, x in enumerate(out)]


def test_scenes_equal_an_ordered_pass(spark, monkeypatch):
    monkeypatch.setattr(derived, "STRETCH", 16)
    rng = random.Random(6)
    rows = {c: [(t, rng.choice([None, "", "a", "a", "b"]), "x" if t % 23 < 15 or c else "y", f"s{t}") for t in range(n)] for c, n in enumerate([300, 1, 7, 40, 64, 65])}
    df = spark.createDataFrame([(c, *r) for c, v in rows.items() for r in v] + [(9, 1, "a", "x", " ")], "conv_id long, turn long, location string, branch string, summary string")
    for most in (6, 3):
        got = sorted(tuple(r) for r in derived.scene_sessions(df, most).select("conv_id", "scene", "n", "first_turn", "last_turn", "location").collect())
        assert got == sorted((c, *x) for c, v in rows.items() for x in plain(v, most))
