"""Canonical JSON against Python's, deep values included; profiles whose spelling does not matter."""

from __future__ import annotations

import json
import random

from lorekeep.operators import canonical


def made(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -3, 12345678901, 7])
    if kind == 2:
        return rng.choice([0.5, -1.25, 3.0])
    if kind < 5:
        return rng.choice(["", "a", 'q"\\', "é漢", "line\nfeed"])
    n = rng.randrange(4)
    return [made(rng, depth - 1) for _ in range(n)] if kind == 5 else {rng.choice(["b", "a", "é", "a.b", 'k"', "0"]) + str(k % 2): made(rng, depth - 1) for k in range(n)}


def plain(v):
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{plain(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, float) and v == int(v):
        v = int(v)
    return json.dumps(v, ensure_ascii=False)


def test_any_spelling_any_depth(spark):
    rng = random.Random(9)
    values = [made(rng, 5) for _ in range(80)] + [[[[[[[[1]]]]]]], {"a": {"b": {"c": {"d": {"e": {}}}}}}]
    rows = [(2 * k, json.dumps(v)) for k, v in enumerate(values)] + [(2 * k + 1, json.dumps(v, indent=1, ensure_ascii=False)) for k, v in enumerate(values)]
    got = dict(map(tuple, canonical.stable_json(spark.createDataFrame(rows + [(-1, "{"), (-2, None)], "id long, j string"), "id", "j").collect()))
    assert got.pop(-1) is None and got.pop(-2) is None
    assert got == {i: plain(json.loads(j)) for i, j in rows}


def test_profiles(spark):
    rows = [
        ("a", '{"model": "org/e5-large", "dimensions": 3}'), ("b", '{ "dimensions":3.0,"role_strategy":"auto","model":" org/e5-large ", "provider":"unknown"}'), ("c", '{"model": "org/e5-large", "dimensions": 4}'),
        ("d", '{"model": "org/e5-large", "dimensions": 3, "score_policy": {"memory": 0.5}}'), ("e", "no json"), ("f", None),
    ]
    got = {r["id"]: r for r in canonical.embedding_profiles(spark.createDataFrame(rows, "id string, c string"), "id", "c").collect()}
    space, policy = ({k: r[f] for k, r in got.items()} for f in ("space_fingerprint", "policy_fingerprint"))
    assert space["a"] == space["b"] == space["d"] != space["c"] and policy["a"] == policy["b"] == policy["c"] != policy["d"]
    assert got["a"]["query_prefix"] == "query: " and got["e"]["family"] == "generic" and space["e"] == space["f"]
