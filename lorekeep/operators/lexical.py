"""BM25 within each conversation, over postings; exact term statistics per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_hybrid

#: Fixed values of the ranking function.
K1, B, QUERY_CAP = 1.2, 0.75, 2


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(conv_id, id, token, tf, dl) of docs (conv_id, id, text); docs without a token have no rows."""
    t = docs.select("conv_id", "id", tokens_hybrid(F.col(text)).alias("t")).select("conv_id", "id", F.size("t").alias("dl"), F.explode("t").alias("token"))
    return t.groupBy("conv_id", "id", "token").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Per conversation and token its document frequency, with the number of docs and their mean length."""
    size = F.greatest(F.lit(1), F.size(tokens_hybrid(F.col("text"))))
    per = docs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(size).alias("avg_len"))
    df = postings(docs).groupBy("conv_id", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return df.join(per, "conv_id")


def bm25(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id, score) of docs that share a token with a query of their conversation.

    queries: (query_id, conv_id, text). The statistics are those of the docs given, so filter recent ones out before.
    """
    q = queries.select("query_id", "conv_id", F.explode(tokens_hybrid(F.col("text"))).alias("token")).groupBy("query_id", "conv_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    post = postings(docs)
    size = F.greatest(F.lit(1), F.size(tokens_hybrid(F.col("text"))))
    per = docs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("avg_len"))
    # document frequencies of query tokens only
    hits = post.join(q.select("conv_id", "token").distinct(), ["conv_id", "token"], "left_semi")
    df = hits.groupBy("conv_id", "token").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(df, ["conv_id", "token"]).join(per, "conv_id").join(q, ["conv_id", "token"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.lit(1.0), F.col("avg_len")))) * F.least(F.lit(QUERY_CAP), F.col("qtf"))
    return rows.groupBy("query_id", "conv_id", "id").agg(F.sum(part).alias("score"))


def entity_bonus(n_entities: Column, n_topics: Column) -> Column:
    """What exact entity and topic mentions add."""
    return F.when(n_entities > 0, 3.2 + 0.8 * F.least(F.lit(3), n_entities - 1)).otherwise(0.0) + F.least(F.lit(2.4), 0.8 * n_topics)


def top_k(scored: DataFrame, k: int, by: str = "query_id", newest: str = "id", digits: int = 9) -> DataFrame:
    """Ranks from 0 within each query; ties of rounded scores go to the newest."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.round("score", digits).desc(), F.col(newest).desc()))
    return scored.withColumn("rank", rank - 1).where(F.col("rank") < k)
