"""First changed rows against a plain comparison, with blocks of few rows; thresholds over many distinct scores."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lorekeep.operators import evaluate, history

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(o, n):
    pos = next((i for i in range(max(len(o), len(n))) if i >= len(o) or i >= len(n) or o[i][1:] != n[i][1:]), None)
    if not o or not n:
        kind = "new" if not o else "gone"
    elif pos is None:
        kind = "same"
    elif pos >= len(o):
        kind = "append"
    elif pos >= len(n):
        kind = "delete"
    elif pos == len(o) - 1 == len(n) - 1 and o[pos][1] == n[pos][1] == "assistant":
        kind = "swipe"
    elif pos + 1 < len(o) and o[pos + 1][1:] == n[pos][1:]:
        kind = "delete"
    elif pos + 1 < len(n) and n[pos + 1][1:] == o[pos][1:]:
        kind = "insert"
    else:
        kind = "edit"
    turn = None if pos is None else (n[pos] if pos < len(n) else o[pos])[0]
    return kind, None if pos is None else pos + 1, turn, len(o), len(n)


def test_first_change(spark):
    rng = random.Random(4)
    olds, news, want = [], [], {}
    for c in range(80):
        o = [(t, rng.choice(["user", "assistant"]), f"x{rng.randrange(4)}") for t in range(rng.randrange(0, 14))]
        n = list(o)
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(n) + 1)
            what = rng.randrange(3)
            if what == 0 and n:
                n.pop(min(i, len(n) - 1))
            elif what == 1:
                n.insert(i, (0, "assistant", f"y{c}"))
            elif n:
                i = min(i, len(n) - 1)
                n[i] = (0, n[i][1], None)
        n = [(t, r, x) for t, (_, r, x) in enumerate(n)]
        olds += [(c, *r) for r in o]
        news += [(c, *r) for r in n]
        if o or n:
            want[c] = plain([(t, r, x or "") for t, r, x in o], [(t, r, x or "") for t, r, x in n])
    o, n = (history.chain(spark.createDataFrame(x, SCHEMA)) for x in (olds, news))
    for size in (3, 256):
        assert {r[0]: tuple(r)[1:] for r in history.first_change(o, n, size).collect()} == want
    ids = {r["conv_id"]: r["branch_id"] for r in history.branch_ids(o).collect()}
    same = {r["conv_id"]: r["branch_id"] for r in history.branch_ids(n).collect()}
    assert all((ids.get(c) == same.get(c)) == (w[0] == "same") for c, w in want.items())


def test_thresholds_over_many_scores(spark):
    df = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("score"), (F.col("id") % 3 == 0).alias("label"))
    t = evaluate.threshold_table(df)
    assert t.rdd.getNumPartitions() > 1
    some = [r for r in t.where("threshold > 0.3").orderBy("threshold").limit(3).collect()]
    for r in some:
        got = df.where(F.col("score") >= r["threshold"]).agg(F.count_if("label").alias("tp"), F.count_if(~F.col("label")).alias("fp")).first()
        assert (r["tp"], r["fp"]) == tuple(got)
