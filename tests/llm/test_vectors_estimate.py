"""op7: the estimate is unbiased, its bound covers, and whole tables agree with brute force."""

from __future__ import annotations

import math

import numpy as np

from . import brute


def test_estimate_is_unbiased_and_its_bound_covers(monkeypatch):
    from lorekeep.llm import vectors

    dim, n = 64, 400
    g = np.random.default_rng(1)
    error, scaled = [], []
    for seed in range(25):
        monkeypatch.setattr(vectors, "SEED", 1000 + seed)
        a = g.standard_normal((n, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        c = g.uniform(-0.2, 0.99, n)
        w = g.standard_normal((n, dim))
        w -= (w * a).sum(1, keepdims=True) * a
        b = c[:, None] * a + np.sqrt(1 - c**2)[:, None] * w / np.linalg.norm(w, axis=1, keepdims=True)
        turned = a @ vectors.rotations(dim)[0].T
        factor = np.abs(turned).sum(1) / math.sqrt(dim)
        words = np.packbits(turned > 0, axis=1).view(np.int64)
        estimate, spread = vectors.estimates(words, factor, b)
        e = np.diag(estimate) - c
        error.append(e)
        scaled.append(e / (spread * np.sqrt(1 - c**2)))
    error, scaled = np.concatenate(error), np.concatenate(scaled)
    assert abs(error.mean()) < 4 * error.std() / math.sqrt(len(error))
    assert 0.95 < scaled.std() < 1.05
    assert (np.abs(scaled) > vectors.Z).mean() < 5e-4


def test_number_of_tables():
    from lorekeep.llm import vectors

    g = np.random.default_rng(2)
    bits, tables = vectors.tables_for(50_000, 64, 0.95)
    pool = vectors.ROTATIONS * 64
    missed = 0
    for _ in range(4000):
        same = g.random(pool) >= math.acos(0.95) / math.pi
        drawn = np.stack([g.permutation(pool)[:bits] for _ in range(tables)])
        missed += not same[drawn].all(1).any()
    assert missed <= 4000 * vectors.MISS + 4 * math.sqrt(4000 * vectors.MISS)


def test_links_of_groups_in_several_blocks(spark, monkeypatch):
    from lorekeep.llm import vectors

    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "ENTRY", 16)
    g = np.random.default_rng(4)
    base = g.standard_normal((12, 24))
    rows = []
    for i in range(900):
        near = base[0] if i < 400 else base[i % 12]
        rows.append((i, (near + 0.17 * g.standard_normal(24) * np.linalg.norm(near) / math.sqrt(24)).astype("f4").tolist(), "x"))
    rows += [(2000, [1.0] * 24, "x"), (2001, [2.0] * 24, "x"), (2002, [1.0] * 23, "x"), (2003, [float("inf")] + [1.0] * 23, "x"), (2003, [-float("inf")] * 24, "x"), (None, [1.0] * 24, None), (2004, [1e300] * 24, "x"), (2005, [0.0, -0.0], "x")]
    got = vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string")).collect()
    good = [(i, np.array(v)) for i, v, _ in rows if len(v) == 24 and np.isfinite(v).all()]
    x = np.stack([v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, v in good])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    n = {i: 0 for i, _, _ in rows} | {i: int(k) for (i, _), k in zip(good, near.sum(1))}
    missed = sum(n[r["vec_id"]] - r["n_links"] for r in got)
    assert missed >= 0 and missed <= 0.002 * near.sum()
    comp = dict(zip([i for i, _ in good if i is not None], brute.least_reachable([i if i is not None else 1 << 60 for i, _ in good], [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])))
    assert sum(r["component_id"] != comp[r["vec_id"]] for r in got if r["vec_id"] in comp) <= 2
    assert {r["vec_id"]: r["n_links"] for r in got}[2002] == 0 and len(got) == len(rows)
