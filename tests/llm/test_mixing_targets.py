"""op5: sources land near their targets, documents keep their expected mass, and copies of rows and awkward rows are whole."""

from __future__ import annotations

import random


def test_sources_come_near_their_targets(spark):
    from lorekeep.llm import mixing

    rng = random.Random(2)
    rows = [(i, "w " * int(10 ** rng.uniform(0, 3.3)), ("a", "b", "c", None)[min(3, int(rng.random() ** 2 * 4))]) for i in range(3000)]
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.002 * r["max(target)"]


def test_documents_expect_the_share_of_their_source(spark):
    """The mean of the copies over many seeds is target / source_size."""
    from lorekeep.llm import mixing

    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 60), ("a", "b", "c")[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total: dict[int, float] = {}
    for seed in range(16):
        got = mixing.mix(docs, seed=1000 * seed + 7).collect()
        for r in got:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["taken"] / r["size"]
    share = {r["source"]: r["target"] / r["source_size"] for r in got}
    for s in share:
        mean = sum(total[r["doc_id"]] for r in got if r["source"] == s) / 16 / 30
        assert abs(mean - share[s]) < 0.08


def test_mixed_documents_keep_rows_whole(spark):
    from lorekeep.llm import mixing

    rows = [(1, "a b c", "s", "x")] * 5 + [(1, "a b d", "s", "y"), (None, "a b", None, "z"), (2, None, "s", "n"), (3, "", None, "e"), (4, "w " * 50_000, "s", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = [tuple(r) for r in mixed.collect()]
    assert set(got) <= set(rows) and (2, None, "s", "n") in got and (3, "", None, "e") in got
    assert max(got.count(r) for r in set(rows) if r != rows[0]) <= 2 and got.count(rows[0]) <= 10
