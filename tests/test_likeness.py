"""T2 in blocks: the chunks, ranks and scores of all pairs, texts inside texts and ties included; few rows are passed on."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions.text import normalize_baseline, overlap_similarity, tokens_baseline
from lorekeep.operators import likeness, settings as S

CHUNK = "world_id string, entry_id long, chunk int, constant boolean, ord double, text string, retrieval_text string"


def plain(queries, chunks, k, least=0.05):
    """All pairs of a world that share a token."""
    col = F.col
    rows = queries.select("query_id", "world_id", col("text").alias("x")).join(chunks, "world_id")
    q, b, r = (normalize_baseline(col(c)) for c in ("x", "text", "retrieval_text"))
    tq, tb, tr = (tokens_baseline(col(c)) for c in ("x", "text", "retrieval_text"))
    ib, ir = F.size(F.array_intersect(tq, tb)), F.size(F.array_intersect(tq, tr))
    score = F.greatest(overlap_similarity(ib, F.size(tq), F.size(tb), q, b), 0.88 * overlap_similarity(ir, F.size(tq), F.size(tr), q, r)) + F.when(col("constant"), 0.015).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), col("constant").desc(), col("ord").asc_nulls_last(), "entry_id", "chunk")
    return rows.where(ib + ir > 0).withColumn("score", score).where(col("score") >= least).withColumn("rank", F.row_number().over(order) - 1).where(col("rank") < k)


def tables(spark, n, words, seed):
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(1, most)))
    queries = [(i, rng.choice(["a", "b", None]), text(9)) for i in range(n // 4)]
    rows = []
    for i in range(n):
        body = rng.choice([text(12), rng.choice(queries)[2], rng.choice(queries)[2][1:-1], "x" + rng.choice(queries)[2], ""])
        rows.append((rng.choice("abc"), i // 3, i % 3, i % 7 == 0, rng.choice([None, 1.0, 2.0]), body, f"[title {rng.choice(words)}] {body}"))
    return spark.createDataFrame(queries, "query_id long, world_id string, text string"), spark.createDataFrame(rows, CHUNK)


@pytest.mark.parametrize("block,asked", [(7, 5), (1024, 1024)])
def test_equal_to_all_pairs(spark, monkeypatch, block, asked):
    monkeypatch.setattr(likeness, "BLOCK", block)
    monkeypatch.setattr(likeness, "ASKED", asked)
    queries, chunks = tables(spark, 240, ["river", "stone", "abcdefghij", "an", "of", "記憶", "記憶検索", "v1.2", "km/h"], 3)
    at = ("query_id", "entry_id", "chunk", "score", "rank")
    got, want = (sorted(tuple(r) for r in x.select(*at).collect()) for x in (S.lexical_topk(queries, chunks, 4), plain(queries, chunks, 4)))
    assert got == want and len(want) > 100


def test_pairs_are_not_passed_on(spark):
    """Every chunk shares a token with every query here; before, each such pair was a row of a shuffle."""
    queries = spark.range(50).select(F.col("id").alias("query_id"), F.lit("a").alias("world_id"), F.concat(F.lit("common words of "), "id").alias("text"))
    text = F.concat(F.lit("common words about "), F.col("id") % 40)
    chunks = spark.range(2000).select(F.lit("a").alias("world_id"), F.col("id").alias("entry_id"), F.lit(0).alias("chunk"), F.lit(False).alias("constant"), F.lit(1.0).alias("ord"), text.alias("text"), text.alias("retrieval_text"))
    assert likeness.candidates(queries, chunks, 5, 0.05).count() <= 50 * 5 * spark.sparkContext.defaultParallelism
