"""op10: keys of a single class of characters can be discoveries, writing of the same class cannot."""

from __future__ import annotations

import random


def test_secrets_of_one_class(spark):
    from lorekeep.llm import secrets

    rng = random.Random(4)
    key = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    low = "abcdefghijklmnopqrstuvwxyz"
    plain = ("the", "river", "under", "another", "writing", "of", "and", "some", "thing", "2024", "17", "consideration", "international")
    rows = [(i, " ".join(rng.choice(plain) for _ in range(200))) for i in range(100)]
    rows += [(200 + i, f"key {key(s, n)} end") for i, (s, n) in enumerate([(low, 40), (low.upper(), 40)] * 10)]
    rows += [(300 + i, t) for i, t in enumerate(("considerationinternationalwriting", "CONSIDERATIONINTERNATIONALWRITING"))]
    rows += [(400, "key " + key("0123456789", 80) + " end")]  # a base span already, since digits are hexadecimal
    got = {r["doc_id"]: (r["n_more"], r["spans"]) for r in secrets.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in range(2):
        assert sum(got[200 + i][0] for i in range(kind, 20, 2)) >= 8
    assert got[300][0] == got[301][0] == 0 and sum(got[i][0] for i in range(100)) == 0
    assert got[400] == (0, "hex:4:84")
