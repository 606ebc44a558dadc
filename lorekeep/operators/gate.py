"""The baseline gate: operations that restate known facts, by a similarity anti-join with blocking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_similarity, normalize_baseline, overlap_similarity, tokens_baseline
from ..sources.shared import durable, spread

LEXICAL, SEMANTIC, FLOOR = 0.78, 0.84, 0.16
#: Characters of a text that one in it must have, at least; pieces of so many characters find texts of few tokens.
INSIDE = 8
#: Rows of the smaller side's vocabulary that are broadcast at most.
BROADCAST_TOKENS = 1_000_000


def _sides(ops: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, x, t, m) of both: normal form, distinct tokens and their number. Each text is taken apart once."""
    def side(rows: DataFrame, label: str) -> DataFrame:
        own = ["entity_ids"] if "entity_ids" in rows.columns else []
        t = spread(rows.select("id", "text", *own)).select("id", normalize_baseline(F.col("text")).alias("x"), tokens_baseline(F.col("text")).alias("t"), *own)
        return durable(t.withColumn("m", F.size("t")), f"gate-{label}")

    return side(ops, "ops"), side(records, "records")


def _tokens(o: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(op_id, m, token, df) and (record_id, n, token, df) of the tokens that both sides have; df: the operations that have it."""
    b = r.select(F.col("id").alias("record_id"), F.col("m").alias("n"), F.explode("t").alias("token"))
    words = durable(b.select("token").distinct(), "gate-words")
    known = F.broadcast(words) if words.count() <= BROADCAST_TOKENS else words
    a = durable(o.select(F.col("id").alias("op_id"), "m", F.explode("t").alias("token")).join(known, "token", "left_semi"), "gate-tokens")
    df = durable(a.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "gate-df")
    df = F.broadcast(df) if df.count() <= BROADCAST_TOKENS else df
    return a.join(df, "token"), b.join(df, "token")


def _overlaps(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """(op_id, record_id) whose smaller token set may be held by the larger one to that share, but for two tokens.

    Tokens are ordered by their frequency, those that only one side has first. Of a set of m tokens that shares
    ceil(share (m - 2)) with another, one of the first m - ceil(share (m - 2)) + 1 is shared. Each side's first tokens meet
    all of the other's, where the own set is the smaller one.
    """
    def first(rows: DataFrame, key: str, size: str) -> DataFrame:
        own = Window.partitionBy(key)
        rows = rows.withColumns({"r": F.row_number().over(own.orderBy("df", "token")), "known": F.count(F.lit(1)).over(own)})
        need = F.col(size) - F.ceil(F.lit(share) * (F.col(size) - 2)) + 1
        return rows.where(F.col("r") + F.col(size) - F.col("known") <= need).select(key, size, "token")

    one = first(a, "op_id", "m").join(b.select("record_id", "n", "token"), "token").where("m <= n")
    two = a.select("op_id", "m", "token").join(first(b, "record_id", "n"), "token").where("n < m")
    return one.select("op_id", "record_id").unionByName(two.select("op_id", "record_id")).distinct()


def _pieces(o: DataFrame, r: DataFrame) -> DataFrame:
    """(op_id, record_id) of texts of two tokens at most with others that have their first INSIDE characters: they may be inside unseen by tokens."""
    few = lambda s: s.where((F.col("m") <= 2) & (F.length("x") >= INSIDE)).select("id", F.left("x", F.lit(INSIDE)).alias("g"))
    every = lambda s: F.explode(F.array_distinct(F.regexp_extract_all("x", F.lit(f"(?s)(?=(.{{{INSIDE}}}))"), F.lit(1)))).alias("g")

    def held(short: DataFrame, long: DataFrame) -> DataFrame:
        n = durable(few(short), "gate-few")
        if n.isEmpty():
            return n.select(F.col("id").alias("s"), F.col("id").alias("l")).limit(0)
        begins = n.select("g").distinct()
        side = F.broadcast(begins) if begins.count() <= BROADCAST_TOKENS else begins
        found = long.select(F.col("id").alias("l"), every(long)).join(side, "g", "left_semi")
        return found.join(n.withColumnRenamed("id", "s"), "g").select("s", "l").distinct()

    one = held(o, r).select(F.col("s").alias("op_id"), F.col("l").alias("record_id"))
    two = held(r, o).select(F.col("l").alias("op_id"), F.col("s").alias("record_id"))
    return one.unionByName(two)


def candidates(o: DataFrame, r: DataFrame, a: DataFrame, b: DataFrame, threshold: float = LEXICAL) -> DataFrame:
    """(op_id, record_id) that may reach the threshold: by tokens, by equal normal forms, or as short texts inside others.

    Token overlap reaches the threshold only if the smaller set is held by threshold / 0.92 or more; a text inside another
    has all its tokens there but the two at its ends.
    """
    share = math.floor(threshold / 0.92 * 1000) / 1000
    equal = o.select(F.col("id").alias("op_id"), F.md5("x").alias("h")).join(r.select(F.col("id").alias("record_id"), F.md5("x").alias("h")), "h").select("op_id", "record_id")
    return _overlaps(a, b, share).unionByName(equal).unionByName(_pieces(o, r)).distinct()


def best_match(ops: DataFrame, records: DataFrame, threshold: float = LEXICAL) -> DataFrame:
    """(op_id, record_id, score): each operation's best record at or above the threshold."""
    o, r = _sides(ops, records)
    entities = "entity_ids" in o.columns and "entity_ids" in r.columns
    # common tokens are counted by a join, so no text or token array goes with a pair that they rule out
    a, b = _tokens(o, r)
    pairs = durable(candidates(o, r, a, b, threshold), "gate-pairs")
    hits = pairs.join(b.select("record_id", "token"), "record_id").join(a.select("op_id", "token"), ["op_id", "token"])
    both = pairs.join(hits.groupBy("op_id", "record_id").agg(F.count(F.lit(1)).alias("both")), ["op_id", "record_id"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    rows = both.join(o.select(F.col("id").alias("op_id"), "m"), "op_id").join(r.select(F.col("id").alias("record_id"), F.col("m").alias("n")), "record_id")
    least = F.least("m", "n")
    overlap = F.when(least > 0, F.greatest(F.col("both") / (F.col("m") + F.col("n") - F.col("both")), 0.92 * F.col("both") / least)).otherwise(0.0)
    rows = rows.where((overlap >= threshold) | (F.col("both") >= least - 2))
    own = lambda s, i, x, e: s.select(F.col("id").alias(i), F.col("x").alias(x), *([F.col("entity_ids").alias(e)] if entities else []))
    rows = rows.join(own(o, "op_id", "ox", "oe"), "op_id").join(own(r, "record_id", "rx", "re"), "record_id")
    if entities:  # one name, other entities: no duplicate
        rows = rows.where((F.coalesce(F.size("oe"), F.lit(0)) < 1) | (F.coalesce(F.size("re"), F.lit(0)) < 1) | F.arrays_overlap("oe", "re"))
    scored = rows.withColumn("score", overlap_similarity(F.col("both"), F.col("m"), F.col("n"), F.col("ox"), F.col("rx"))).where(F.col("score") >= threshold)
    return scored.groupBy("op_id").agg(F.max_by("record_id", F.struct(F.round("score", 9), -F.col("record_id"))).alias("record_id"), F.max("score").alias("score"))


def anchored(topics: Column, entities: Column, text: Column) -> Column:
    """Whether a record's text has one of the topics (two characters or more) or entities (three or more)."""
    hay = normalize_baseline(text)
    has = lambda xs, n: F.exists(xs, lambda x: (F.length(normalize_baseline(x)) >= n) & F.contains(hay, normalize_baseline(x)))
    return has(topics, 2) | has(entities, 3)


def split(ops: DataFrame, records: DataFrame, eligible: Column, dense: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted operations, rejected ones with their match).

    dense: (op_id, record_id, cosine) of an embedding search, if there is one. A hit of SEMANTIC or more rejects too, if the
    texts are alike by FLOOR at least or the record has one of the operation's topics or entities (columns topics, entities).
    """
    match = best_match(ops.where(eligible), records).select(F.col("op_id").alias("id"), "record_id", "score")
    if dense is not None:
        o = ops.where(eligible).select(F.col("id").alias("op_id"), F.col("text").alias("ot"), *[c for c in ("topics", "entities") if c in ops.columns])
        r = records.select(F.col("id").alias("record_id"), F.col("text").alias("rt"))
        near = dense.where(F.col("cosine") >= SEMANTIC).join(match.select(F.col("id").alias("op_id")), "op_id", "left_anti").join(o, "op_id").join(r, "record_id")
        of = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in ops.columns else F.array().cast("array<string>")
        near = near.withColumn("lexical", lexical_similarity(F.col("ot"), F.col("rt"))).where((F.col("lexical") >= FLOOR) | anchored(of("topics"), of("entities"), F.col("rt")))
        best = near.groupBy(F.col("op_id").alias("id")).agg(F.max_by("record_id", F.struct("cosine", -F.col("record_id"))).alias("record_id"), F.max("cosine").alias("score"))
        match = match.unionByName(best)
    match = durable(match, "gate-match")
    return ops.join(match.select("id"), "id", "left_anti"), ops.join(match, "id")
