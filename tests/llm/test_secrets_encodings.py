"""op10: planted keys of every encoding are found, long writing and identifiers are not; the battery keeps its level."""

from __future__ import annotations

import random

LOW = "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "lower": LOW, "upper": LOW.upper(), "base32": LOW.upper() + "234567", "base36": LOW + "0123456789", "base36 upper": LOW.upper() + "0123456789",
    "base62": LOW + LOW.upper() + "0123456789", "base64": LOW + LOW.upper() + "0123456789+/",
}
PLAIN = ("the", "river", "under", "another", "writing", "of", "and", "some", "thing", "consideration", "international", "2024", "17", "Because", "Therefore", "getValue", "user_name", "MAX_SIZE")


def test_planted_recall_by_encoding(spark):
    from lorekeep.llm import secrets

    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(PLAIN) for _ in range(150))) for i in range(150)]
    of = {}
    for name, signs in ENCODINGS.items():
        for _ in range(30):
            i = 1000 + len(of)
            of[i] = name
            rows.append((i, "see " + "".join(rng.choice(signs) for _ in range(44)) + " there"))
    false = ["".join(rng.choice(PLAIN) for _ in range(rng.randint(4, 8))) for _ in range(100)] + ["_".join(rng.choice(PLAIN) for _ in range(5)) for _ in range(100)]
    rows += [(5000 + k, "in " + (t if len(t) >= 20 else t * 3) + " it is") for k, t in enumerate(false)]
    rows += [(9000, None), (None, ""), (9001, "a" * 100_000), (9001, "a" * 100_000)]
    got = spark.createDataFrame(rows, "doc_id long, text string").transform(secrets.detect).collect()
    assert len(got) == len(rows)
    found = {name: sum(r["n_more"] > 0 for r in got if of.get(r["doc_id"]) == name) for name in ENCODINGS}
    assert min(found.values()) >= 27, found
    assert sum(r["n_more"] > 0 for r in got if r["doc_id"] not in of) <= 4
    for r in got:
        if r["doc_id"] in of and r["n_more"]:
            assert r["spans"] == "random:4:48"


def test_battery_keeps_its_level(spark):
    """Of random tokens of each encoding, about a share alpha fails the combined test; of ordered ones nearly all do."""
    from pyspark.sql import functions as F

    from lorekeep.llm import secrets

    rng = random.Random(15)
    rows = [(name, "".join(rng.choice(signs) for _ in range(60))) for name, signs in ENCODINGS.items() for _ in range(300)]
    rows += [("ordered", "".join(sorted(rng.choice(LOW) for _ in range(60)))) for _ in range(50)]
    model = secrets.writing(spark.createDataFrame([(" ".join(PLAIN),)], "_text string"))
    got = secrets.battery(spark.createDataFrame(rows, "name string, v string"), model).groupBy("name").agg(F.avg((F.col("p_random") < 0.05).cast("double")).alias("share")).collect()
    share = {r["name"]: r["share"] for r in got}
    assert share.pop("ordered") > 0.9
    assert max(v for k, v in share.items() if k != "base62") < 0.1  # base 62 is tested as base 64
