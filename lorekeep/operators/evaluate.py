"""Quality of rankings and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan


def case_scores(cases: DataFrame, ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per case recall, precision, reciprocal rank and hit of the first k; no gold: recall 1, rank 0, precision 0 unless nothing came back."""
    top = ranked.where(F.col("rank") < k)
    hits = top.join(gold.withColumn("g", F.lit(1)), ["query_id", "id"], "left")
    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("g").alias("h"), F.min(F.when(F.col("g") == 1, F.col("rank"))).alias("first"))
    want = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("w"))
    c = cases.select("query_id").join(got, "query_id", "left").join(want, "query_id", "left").na.fill(0, ["n", "h", "w"])
    empty = F.col("w") == 0
    return c.select(
        "query_id",
        F.when(empty, 1.0).otherwise(F.col("h") / F.col("w")).alias("recall"),
        F.when(empty, (F.col("n") == 0).cast("double")).when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0).alias("precision"),
        F.when(empty | F.col("first").isNull(), 0.0).otherwise(1 / (F.col("first") + 1)).alias("reciprocal_rank"),
        (~empty & (F.col("h") > 0)).alias("hit"),
    )


def mean_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("cases"), *[F.avg(c).alias(c) for c in ("recall", "precision", "reciprocal_rank")], F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def compare_runs(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Candidate less baseline, for two rows of mean scores."""
    names = ("recall", "precision", "reciprocal_rank", "hit_rate")
    both = base.select(*[F.col(c).alias(f"b_{c}") for c in names]).join(candidate.select(*names), F.lit(True))
    return both.select(*[(F.col(c) - F.col(f"b_{c}")).alias(f"delta_{c}") for c in names])


def threshold_table(samples: DataFrame) -> DataFrame:
    """Confusion counts at every distinct score, at 0 and at 1. samples: (score 0..1, label boolean).

    Cumulative counts over the distinct scores on two levels (``scan``): no task has them all, however many they are.
    """
    per = samples.groupBy("score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))
    ends = samples.sparkSession.sql("select explode(array(0D, 1D)) as score").withColumns({"p": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    per = per.unionByName(ends).groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    down = scan.running(per.withColumns({"all": F.lit(0), "down": -F.col("score")}), ["all"], ["down"], {"tp": F.col("p"), "fp": F.col("n")}, "thresholds")
    whole = down.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("all_p"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"))
    t = down.join(F.broadcast(whole), F.lit(True))  # one row
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    recall = F.when(F.col("all_p") > 0, F.col("tp") / F.col("all_p")).otherwise(1.0)
    t = t.select(F.col("score").alias("threshold"), "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("fp")).alias("tn"), precision.alias("precision"), recall.alias("recall"))
    return t.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def calibrate(samples: DataFrame, min_recall: float = 0.98) -> DataFrame:
    """The threshold of the highest precision, then F1, then score, among those that reach the recall (else among all)."""
    t = threshold_table(samples)
    best = F.max(F.struct((F.col("recall") >= min_recall).alias("met"), "precision", "f1", "threshold", "recall", "tp", "fp", "fn", "tn"))
    return t.agg(best.alias("b")).select("b.*")


def key_retention(must: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per conversation the share of mandatory texts whose first 32 characters are in the block; null without a block."""
    head = F.left(F.regexp_replace(F.trim("text"), r"\s+", " "), F.lit(32))
    both = must.join(blocks, "conv_id", "left")
    inside = F.when(F.col("block").isNotNull(), F.contains(F.regexp_replace("block", r"\s+", " "), head).cast("double"))
    return both.groupBy("conv_id").agg(F.avg(inside).alias("retention"), F.count(F.lit(1)).alias("mandatory"))


def causal_probes(versions: DataFrame) -> DataFrame:
    """Per slot the current value, the latest one that was replaced and the first: rows (conv_id, slot, probe, text)."""
    by = ["conv_id", "slot"]
    per = versions.groupBy(*by).agg(
        F.max_by(F.when(F.col("status") == "active", F.col("text")), F.when(F.col("status") == "active", F.col("valid_from"))).alias("current"),
        F.max_by(F.when(F.col("superseded_by").isNotNull(), F.col("text")), F.when(F.col("superseded_by").isNotNull(), F.col("valid_from"))).alias("superseded"),
        F.min_by("text", "valid_from").alias("first"),
    )
    rows = per.unpivot(by, ["current", "superseded", "first"], "probe", "text")
    return rows.where("text is not null")


def score_probes(probes: DataFrame, corpus: DataFrame) -> DataFrame:
    """Share of probes whose first 32 characters are in the conversation's corpus text (conv_id, block), by kind of probe."""
    both = probes.join(corpus, "conv_id", "left")
    return both.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.contains("block", F.left("text", F.lit(32))), F.lit(False)).cast("double")).alias("score"))
