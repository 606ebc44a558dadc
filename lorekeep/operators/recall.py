"""The read path over a table of queries: channels, fusion, diffusion, re-ranking by the query's words, diversity.

Every step is keyed by conversation and query; what a query carries on is bounded by its channels' lengths. All conversations
are answered in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import durable
from . import lexical, oplog, rank

#: Fixed values of the fusion.
WEIGHTS = {"dense1": 1.0, "dense2": 0.82, "structured": 0.8, "lexical": 0.9}
BYPASS = 0.006
#: What memories lack if the table has no such column.
DEFAULTS = {
    "slot": ("", "string"), "entities": (None, "array<string>"), "topics": (None, "array<string>"), "importance": ("medium", "string"), "scope": ("", "string"), "valid_until": (None, "long"),
    "reinforcement": (0, "int"), "evidenced": (True, "boolean"), "last_recalled": (None, "long"), "indexable": (True, "boolean"),
}


def _filled(memories: DataFrame) -> DataFrame:
    out = memories
    for name, (value, kind) in DEFAULTS.items():
        plain = F.lit(value).cast(kind) if not kind.startswith("array") else F.array().cast(kind)
        out = out.withColumn(name, F.coalesce(F.col(name).cast(kind), plain) if name in out.columns else plain)
    return out


def _tight(text: Column) -> Column:
    return F.regexp_replace(X.normalize(text), r"\s+", "")


def mentions(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, id, entities, topics): how many of a memory's entities and topics the query of its conversation names."""
    def of(column: str, form, name: str) -> DataFrame:
        terms = memories.select("conv_id", "id", F.explode(column).alias("term")).select("conv_id", "id", form(F.col("term")).alias("term")).where(F.length("term") >= 2).distinct()
        asked = queries.select("query_id", "conv_id", form(F.col("text")).alias("q"))
        return asked.join(terms, "conv_id").where(F.contains("q", "term")).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias(name))

    both = of("entities", _tight, "n_entities").join(of("topics", X.normalize, "n_topics"), ["query_id", "id"], "full")
    return both.na.fill(0, ["n_entities", "n_topics"])


def lexical_hits(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """T1 over memories: (query_id, id, score, rank, entity), entity: whether one is named in the query."""
    docs = memories.select("conv_id", "id", F.concat_ws(" ", "text", F.array_join("entities", " "), F.array_join("topics", " ")).alias("text"))
    scored = lexical.bm25(queries, docs).select("query_id", "id", "score")
    found = scored.join(mentions(queries, memories), ["query_id", "id"], "full").na.fill(0, ["n_entities", "n_topics"]).na.fill(0.0, ["score"])
    found = found.withColumn("score", F.col("score") + lexical.entity_bonus(F.col("n_entities"), F.col("n_topics"))).where("score > 0")
    newest = found.join(queries.select("query_id", "conv_id"), "query_id").join(memories.select("conv_id", "id", "valid_from"), ["conv_id", "id"])
    return lexical.top_k(newest, k, newest="valid_from").select("query_id", "id", "score", "rank", (F.col("n_entities") > 0).alias("entity"))


def fuse(queries: DataFrame, memories: DataFrame, dense: DataFrame | None, lexical_k: int, temporal_k: int, cooldown: int) -> DataFrame:
    """(query_id, conv_id, id, score, channels, entity): G6 over all channels, with bonuses, evidence and cooldown."""
    asked = queries.select("query_id", "conv_id", "as_of")
    open_ = memories.where(oplog.is_indexable(F.col("indexable"), F.col("status"), F.col("text"), F.col("evidenced"), F.col("importance"), F.col("kind")))
    lex = lexical_hits(queries, open_, lexical_k).select("query_id", "id", "rank", F.lit("lexical").alias("channel"), "entity")
    now = memories.join(asked, "conv_id").withColumn("conv_id", F.col("query_id"))
    structured = rank.temporal_topk(now, temporal_k).select("query_id", "id", "rank", F.lit("structured").alias("channel"), F.lit(False).alias("entity"))
    rows = lex.unionByName(structured)
    if dense is not None:
        near = dense.join(asked, "query_id").join(open_.select("conv_id", "id"), ["conv_id", "id"], "left_semi")
        rows = rank.dense_gate(rows.unionByName(near.select("query_id", "id", "rank", "channel", F.lit(False).alias("entity"))))
    rows = durable(rows, "recall-channels")
    fused = rank.rrf(rows, WEIGHTS)
    named = rows.where("entity").select("query_id", "id").distinct()
    found = rows.where(F.col("channel").startswith("dense")).select("query_id", "id").distinct()
    bypass = named.join(found, ["query_id", "id"], "left_anti").withColumn("entity", F.lit(1))
    out = fused.join(bypass, ["query_id", "id"], "left").withColumn("entity", F.coalesce("entity", F.lit(0))).withColumn("score", F.col("score") + BYPASS * F.col("entity"))
    out = out.join(asked, "query_id").join(memories.select("conv_id", "id", "importance", "reinforcement", "evidenced", "last_recalled"), ["conv_id", "id"])
    age = F.col("as_of") - F.col("last_recalled")
    out = rank.adjusted(out).withColumn("score", F.col("score") * F.when(age.isNotNull(), rank.cooldown_penalty(age, cooldown)).otherwise(1.0) if cooldown else F.col("score"))
    return out.select("query_id", "conv_id", "id", "score", "channels", "entity")


def graph_terms(memories: DataFrame) -> DataFrame:
    """(conv_id, id, type, term): entities (e) and topics (t) in normal form."""
    of = lambda c, kind: memories.select("conv_id", "id", F.lit(kind).alias("type"), F.explode(c).alias("term"))
    return of("entities", "e").unionByName(of("topics", "t")).withColumn("term", X.normalize(F.col("term"))).where("term <> ''").distinct()


def features(rows: DataFrame, queries: DataFrame, memories: DataFrame, half_life: float) -> DataFrame:
    """The features of T9, from the texts: coverage, phrase, slot, recency, importance, breadth; entity is there already."""
    full = X.retrieval_text(F.col("scope"), F.col("entities"), F.col("topics"), F.col("text"))
    about = memories.select("conv_id", "id", "slot", "text", "topics", "importance", "valid_from", full.alias("full"))
    rows = rows.join(about, ["conv_id", "id"]).join(queries.select("query_id", F.col("text").alias("q"), "as_of"), "query_id")
    q = X.words(F.col("q"))
    return rows.withColumns({
        "coverage": X.word_coverage(q, X.words(F.col("full"))), "slot_hit": X.word_coverage(q, X.words(F.col("slot"))),
        "phrase": F.when(F.size(q) > 1, F.least(F.lit(1.0), X.phrase_hits(q, F.col("full")) / F.greatest(F.lit(1), F.size(q) - 1))).otherwise(0.0),
        "recency": rank.recency(F.col("as_of") - F.col("valid_from"), half_life), "breadth": F.least(F.lit(1.0), F.size("channels") / 3.0),
        "importance": rank.lookup(rank.RERANK_IMPORTANCE, F.col("importance"), 0.6),
    }).drop("slot").withColumnRenamed("slot_hit", "slot")


def recall(memories: DataFrame, queries: DataFrame, dense: DataFrame | None = None, k: int = 6, lexical_k: int = 24, temporal_k: int = 8, cooldown: int = 4, half_life: float = 120, diffusion: bool = True) -> DataFrame:
    """(query_id, id, rank, score, rerank_score, mmr, channels) of the k memories chosen for each query.

    memories: (conv_id, id, kind, text, status, valid_from) and any of DEFAULTS; queries: (query_id, conv_id, text, as_of);
    dense: (query_id, id, rank from 0, channel dense1 or dense2) of a vector search, None if there is none, in which case
    lexical hits pass without a gate.
    """
    memories = _filled(memories)
    rows = durable(fuse(queries, memories, dense, lexical_k, temporal_k, cooldown), "recall-fused")
    if diffusion:
        size = memories.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
        rows = rank.diffuse(rows, rank.candidate_edges(rows, graph_terms(memories), size))
    ranked = rank.rerank(features(rows, queries, memories, half_life), pool=max(30, 5 * k))
    ranked = durable(ranked.select("query_id", "id", "score", "rerank_score", "channels", F.col("rank").alias("place"), rank.similarity_terms(F.col("text"), F.col("topics")).alias("terms")), "recall-ranked")
    chosen = rank.mmr(ranked, k)
    return chosen.join(ranked.drop("terms", "place"), ["query_id", "id"]).select("query_id", "id", "rank", "score", "rerank_score", "mmr", "channels")
