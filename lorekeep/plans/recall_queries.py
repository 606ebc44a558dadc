"""Queries over the read path: channels, fusion, diffusion, re-ranking, diversity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clusters, dense, derived, evaluate, recall, scan
from ..operators.turns import query_views as turn_views
from ..sources.shared import durable
from .conversation_queries import newest_queries
from .driver import IMPORTANCE, KINDS, pick, table, turns
from .registry import query


def told(queries, docs):
    """Memories of turns: entities are the words with capitals, topics the longest words; one in seven is over, one in nine was just recalled."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{Lu}[\p{L}\p{N}]{3,})"), F.lit(1)))
    topics = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{9,})"), F.lit(1)))
    i = F.col("id")
    memories = docs.select(
        "conv_id", "id", "text", pick(KINDS, i).alias("kind"), pick(IMPORTANCE, F.floor(i / 2)).alias("importance"), F.concat(F.lit("slot."), i % 5).alias("slot"), F.slice(words, 1, 4).alias("entities"),
        F.slice(topics, 1, 4).alias("topics"), F.when(i % 7 == 3, "closed").otherwise("active").alias("status"), i.alias("valid_from"), (i % 3).cast("int").alias("reinforcement"), (i % 8 != 5).alias("evidenced"),
        F.when(i % 9 == 4, i + 1).alias("last_recalled"),
    )
    now = docs.groupBy("conv_id").agg((F.max("id") + 1).alias("as_of"))
    return queries.join(now, "conv_id").select("query_id", "conv_id", "text", "as_of"), memories


def neighbours(spark, d, queries, memories, k: int = 18):
    """A vector channel: a turn's vector is one of the given ones, by a rule on its conversation and number."""
    v = table(spark, d, "embeddings").select(F.lit(0).alias("all"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = scan.running(v, ["all"], ["vec_id"], {"n": F.lit(1)}, "recall-vectors").select("n", "v")
    size = v.agg(F.max("n").alias("size"))
    at = lambda n: (F.col("conv_id") * 31 + n * 7) % F.col("size") + 1
    memories, queries = (x.join(F.broadcast(size), F.lit(True)) for x in (memories, queries))  # one row
    m = memories.select("conv_id", "id", at(F.col("id")).alias("n")).join(v, "n").select("conv_id", "id", F.col("v").alias("b"))
    q = queries.select("query_id", "conv_id", at(F.col("as_of")).alias("n")).join(v, "n").select("query_id", "conv_id", F.col("v").alias("a"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = q.join(m, "conv_id").withColumn("score", dot / (dense.norm(F.col("a")) * dense.norm(F.col("b"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")) - 1
    return near.withColumn("rank", rank).where((F.col("rank") < k) & (F.col("score") >= -0.1)).select("query_id", "id", "rank", F.lit("dense1").alias("channel"))


@query("r7_recall")
def r7(spark, d):
    """The newest user turn of each conversation against the memories of its earlier ones, over all channels."""
    queries, memories = told(*newest_queries(spark, d))
    out = recall.recall(memories, queries, neighbours(spark, d, queries, memories))
    return out.select("query_id", "id", "rank", *[F.round(c, 6).alias(c) for c in ("score", "rerank_score", "mmr")], F.array_join("channels", ",").alias("channels"))


def by_view(spark, d, queries, memories, k: int = 18):
    """Two vector channels: the newest turn's view searches as dense1, that of the newest turns, if it differs, as dense2, each in its own conversation."""
    v = table(spark, d, "embeddings").select(F.lit(0).alias("all"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    v = durable(scan.running(v, ["all"], ["vec_id"], {"n": F.lit(1)}, "recall-vectors").select("n", "vec"), "recall-numbered")
    size = F.broadcast(v.agg(F.max("n").alias("size")))  # one row
    at = lambda rows, n: rows.join(size, F.lit(True)).withColumn("n", (F.col("conv_id") * 31 + n * 7) % F.col("size") + 1).join(v, "n")
    stored = durable(at(memories.select("conv_id", "id"), F.col("id")).select("conv_id", "id", "vec"), "recall-stored")
    views = turn_views(turns(spark, d)).select("conv_id", "view").join(queries.select("query_id", "conv_id", "as_of"), "conv_id")
    out = None
    for view, channel, shift in (("focus", "dense1", 0), ("context", "dense2", 3)):
        asked = at(views.where(F.col("view") == view), F.col("as_of") + shift).select("query_id", "conv_id", "vec")
        hits = clusters.topk_within(asked, stored, "conv_id", 64, k, -0.1).select("query_id", "id", "rank", F.lit(channel).alias("channel"))
        out = hits if out is None else out.unionByName(hits)
    return durable(out, "recall-dense")


@query("r7_recall_views")
def r7b(spark, d):
    """The recall of r7 for one actor: memories of another audience or scope are out, and both views of the query search."""
    queries, docs = newest_queries(spark, d)
    none, i = F.array().cast("array<string>"), F.col("id")
    audience, scope = F.when(i % 11 == 6, F.array(F.lit("Other"))).otherwise(none), F.when(i % 13 == 7, "side").otherwise("")
    docs = docs.where(derived.visible(audience, none, F.array(F.lit("ME")), none, F.lit(False)) & scope.isin("", "main"))
    queries, memories = told(queries, docs)
    out = recall.recall(memories, queries, by_view(spark, d, queries, memories))
    return out.select("query_id", "id", "rank", *[F.round(c, 6).alias(c) for c in ("score", "rerank_score", "mmr")], F.array_join("channels", ",").alias("channels"))


def questions(docs):
    """Three questions about each conversation's turns, as conversations of their own: (conv_id * 3 + k, text, gold).

    What is asked for is the oldest turn by its first 60 characters, the middle one by every third of its first 30 words, the
    newest by its three longest words.
    """
    per = docs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("id"))
    rows = docs.withColumn("place", place).join(per, "conv_id")
    k = F.explode(F.filter(F.array(*[F.when(F.col("place") == at, F.lit(i)) for i, at in enumerate((F.lit(1), F.floor((F.col("n") + 1) / 2), F.col("n")))]), lambda x: x.isNotNull()))
    rows = rows.select("conv_id", "id", "text", k.alias("k"), F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("w"))
    third = F.array_join(F.filter(F.slice("w", 1, 30), lambda x, i: i % 3 == 0), " ")
    long = F.transform(F.slice(F.array_sort(F.transform(F.array_distinct("w"), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1, 3), lambda z: z["x"])
    text = F.when(F.col("k") == 0, F.left("text", F.lit(60))).when(F.col("k") == 1, third).otherwise(F.array_join(long, " "))
    return rows.select((F.col("conv_id") * 3 + F.col("k")).alias("conv_id"), text.alias("text"), F.col("id").alias("gold"))


def three_times(docs):
    """The turns, once for each question."""
    return docs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select((F.col("conv_id") * 3 + F.col("_k")).alias("conv_id"), "id", "text")


def alike(memories):
    """The memories without what would put one before another whatever is asked: all active, of medium weight, never recalled."""
    return memories.withColumns({"status": F.lit("active"), "importance": F.lit("medium"), "reinforcement": F.lit(0), "evidenced": F.lit(True), "last_recalled": F.lit(None).cast("long")})


@query("g27_selfcheck")
def g27(spark, d):
    """Every conversation is asked for turns of its own, over the whole read path: where each was found."""
    _, docs = newest_queries(spark, d)
    asked = questions(docs)
    queries, memories = told(asked.select(F.col("conv_id").alias("query_id"), "conv_id", "text"), three_times(docs))
    memories = alike(memories)
    found = recall.recall(memories, queries, neighbours(spark, d, queries, memories)).select("query_id", "id", "rank")
    gold = asked.select(F.col("conv_id").alias("query_id"), F.col("gold").alias("id"))
    scored = evaluate.case_scores(queries, found.withColumn("rank", F.col("rank") - 1), gold, 6)
    return scored.join(gold, "query_id").select("query_id", F.col("id").alias("gold"), "hit", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))
