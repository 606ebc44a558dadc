"""op8: the limits of rejection come from all training texts."""

from __future__ import annotations

import random


def test_langid_limits_need_no_sample(spark):
    from pyspark.sql import functions as F

    from lorekeep.llm import langid

    rng = random.Random(9)
    # ids that a sample of a sixteenth by this hash would not hold
    ids = [r["id"] for r in spark.range(400).where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(16)) != 0).limit(200).collect()]
    text = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    rows = [(i, text(["ka", "lo", "mi", "ta"], 30), "aa") for i in ids]
    rows += [(1000 + i, text(["zu", "xe", "qo", "vi"], 30), "few") for i in range(4)] + [(2000, text(["gf", "wq", "hj", "dx"], 30), None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[2000]["rejected"]
    assert sum(got[i]["rejected"] for i in ids) <= 4


def test_langid_limits_of_languages_with_few_texts(spark):
    from lorekeep.llm import langid

    scored = spark.createDataFrame([("a", 2.0)] * 6 + [("a", 4.0)] * 6 + [("b", 3.0)] * 3, "lang_pred string, cross_entropy double")
    limits = langid.calibrate(scored, ["a", "b", "c"])
    assert limits["a"] == (3.0, 1.0)
    assert limits["b"] == limits["c"] and abs(limits["b"][0] - 3.0) < 1e-12 and abs(limits["b"][1] - 0.8**0.5) < 1e-12
    assert langid.calibrate(scored.where("lang_pred = 'b'"), ["b"]) == {}
