"""op4: the fit minimises the non-negative risk, against a plain gradient by differences."""

from __future__ import annotations

import numpy as np


def plain_risk(rows, positive, w, b, prior):
    s = np.array([1 / (1 + np.exp(-(sum(w[f] for f in r) + b))) for r in rows])
    negative = s[~positive].mean() - prior * s[positive].mean()
    return prior * (1 - s[positive]).mean() + max(0.0, negative), negative


def test_one_step_follows_the_risk():
    from lorekeep.llm import toxicity

    g = np.random.default_rng(3)
    rows = [sorted(set(g.integers(0, 6, 3).tolist())) for _ in range(60)]
    positive = np.array([0 in r and k % 2 == 0 for k, r in enumerate(rows)])
    prior, rate = 0.2, 1e-3
    w, b = toxicity.fit_nnpu(rows, positive, 6, prior, rounds=1, rate=rate, decay=0.0)
    gradient = []
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-6
        up, _ = plain_risk(rows, positive, step[:6], step[6], prior)
        down, _ = plain_risk(rows, positive, -step[:6], -step[6], prior)
        gradient.append((up - down) / 2e-6)
    gradient = np.array(gradient)
    # Adam's first step goes by rate against the sign of each partial derivative
    clear = np.abs(gradient) > 1e-6
    assert (np.sign(np.append(w, b)[clear]) == -np.sign(gradient[clear])).all()
    assert np.allclose(np.abs(np.append(w, b)[clear]), rate, rtol=1e-2)


def test_fit_lowers_the_risk_and_finds_the_toxic_among_the_unlabelled():
    from lorekeep.llm import toxicity

    g = np.random.default_rng(4)
    toxic = g.random(800) < 0.25
    rows = [sorted({int(g.integers(1, 20)), int(g.integers(1, 20))} | ({0} if t else set())) for t in toxic]
    positive = toxic & (g.random(800) < 0.4)
    w, b = toxicity.fit_nnpu(rows, positive, 20, prior=0.25)
    before, _ = plain_risk(rows, positive, np.zeros(20), 0.0, 0.25)
    after, _ = plain_risk(rows, positive, w, b, 0.25)
    assert after < before - 0.1
    predicted = np.array([sum(w[f] for f in r) + b >= 0 for r in rows])
    assert (predicted == toxic).mean() > 0.98


def test_repeated_ids_and_null_ids_do_not_depend_on_partitions(spark):
    from lorekeep.llm import toxicity

    rows = [(i % 40, f"word{i % 7} other{i % 11} " + ("awful" if i % 40 % 4 == 1 else "fine"), 0.5) for i in range(160)] + [(None, "awful thing", 1.0), (None, None, 1.0), (3, "x " * 50_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 1), "q") for i in range(40)] + [(None, 1, "q"), (7, None, "q"), (99, 1, "q")], "doc_id long, toxic int, text string")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    one, two = (sorted((tuple(r) for r in toxicity.detect(d, labels).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert one == two and len(one) == len(rows) and key
