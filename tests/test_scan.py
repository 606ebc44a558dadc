"""Running sums on two levels against a plain loop, one key over many tasks included."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lorekeep.operators import scan


def test_running_sums_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [("hot", k, rng.randrange(-5, 9), f"t{k}") for k in range(3000)] + [(rng.choice(["a", "b", None, ""]), k, rng.randrange(9), None) for k in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v long, text string").repartition(7)
    got = scan.running(df, ["k"], ["at"], {"total": F.col("v"), "n": F.lit(1)}).collect()
    want, sums = {}, {}
    for k, at, v, text in sorted(rows, key=lambda r: r[1]):
        total, n = sums.get(k, (0, 0))
        sums[k] = total + v, n + 1
        want[k, at] = (*sums[k], v, text)
    assert {(r["k"], r["at"]): (r["total"], r["n"], r["v"], r["text"]) for r in got} == want and len(got) == len(rows)


def test_empty(spark):
    assert not scan.running(spark.createDataFrame([], "k string, at long"), ["k"], ["at"], {"n": F.lit(1)}).collect()
