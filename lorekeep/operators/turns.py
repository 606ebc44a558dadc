"""Turns of conversations: pairs, completed turns, query windows, fingerprints, compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def pair_turns(turns: DataFrame) -> DataFrame:
    """Each assistant row with the user row right before it; with none there, the user's side is empty."""
    before = F.lag(F.struct("role", "turn", "text")).over(by_turn())
    rows = turns.withColumn("b", before).where("role = 'assistant'")
    user = F.col("b.role") == "user"
    text = F.when(user, F.col("b.text")).otherwise("")
    return rows.select("conv_id", F.col("turn").alias("assistant_turn"), F.when(user, F.col("b.turn")).alias("user_turn"), text.alias("user_text"), F.col("text").alias("assistant_text"))


def pair_keys(pairs: DataFrame) -> DataFrame:
    """Pairs with a 64-bit identity of both texts and their lengths."""
    return pairs.withColumn("pair_key", F.concat_ws(":", F.hex(F.xxhash64("user_text", "assistant_text")), F.length("user_text"), F.length("assistant_text")))


def completed_turns(turns: DataFrame) -> DataFrame:
    """The user rows since the last assistant row, with that row: one turn text."""
    island = F.sum((F.col("role") == "assistant").cast("int")).over(by_turn().rowsBetween(Window.unboundedPreceding, -1))
    rows = turns.withColumn("island", F.coalesce(island, F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    out = rows.groupBy("conv_id", "island").agg(parts.alias("p"), F.max(F.col("role") == "assistant").alias("whole"), F.count(F.lit(1)).alias("n_rows"))
    return out.where("whole").select("conv_id", F.col("island").cast("long").alias("island"), F.col("p")[F.size("p") - 1]["turn"].alias("assistant_turn"), "n_rows", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("turn_text"))


def latest(turns: DataFrame) -> DataFrame:
    """Per conversation, the newest turn of either side."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return turns.groupBy("conv_id").agg(F.max(F.when(user, F.col("turn"))).alias("last_user"), F.max(F.when(assistant, F.col("turn"))).alias("last_assistant"), F.max_by("text", "turn").alias("last_text"))


def query_views(turns: DataFrame, n: int = 3, focus_chars: int = 3200, context_chars: int = 8000) -> DataFrame:
    """Per conversation the newest row (focus) and, if it differs, the newest n rows (context), both cut at the head."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = turns.where(F.trim("text") != "").withColumn("r", rank).where(F.col("r") <= n)
    both = last.groupBy("conv_id").agg(F.max_by("text", "turn").alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("c"))
    both = both.select("conv_id", F.trim(F.right("f", F.lit(focus_chars))).alias("f"), F.trim(F.right("c", F.lit(context_chars))).alias("c"))
    view = lambda name, text, weight: F.struct(F.lit(name).alias("view"), text.alias("text"), F.lit(weight).alias("weight"))
    views = F.when(F.col("f") == F.col("c"), F.array(view("focus", F.col("f"), 1.0))).otherwise(F.array(view("focus", F.col("f"), 1.0), view("context", F.col("c"), 0.82)))
    return both.select("conv_id", F.explode(views).alias("v")).select("conv_id", "v.*")


def branch_ids(turns: DataFrame) -> DataFrame:
    """A conversation's identity: a hash of its ordered rows."""
    row = F.struct("turn", "role", F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    return turns.groupBy("conv_id").agg(F.xxhash64(F.array_sort(F.collect_list(row))).alias("branch_id"), F.count(F.lit(1)).alias("n_rows"))


def is_prefix(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per conversation, whether the old rows are a prefix of the new ones, and how many rows came after."""
    o = old.select("conv_id", "turn", F.xxhash64("role", "text").alias("ho"))
    n = new.select("conv_id", "turn", F.xxhash64("role", "text").alias("hn"))
    both = o.join(n, ["conv_id", "turn"], "full_outer")
    return both.groupBy("conv_id").agg(F.bool_and(F.when(F.col("ho").isNotNull(), F.coalesce(F.col("ho") == F.col("hn"), F.lit(False))).otherwise(True)).alias("prefix"), F.count_if(F.col("ho").isNull()).alias("appended"))


def compression_series(turns: DataFrame, memory_tokens: DataFrame, every: int = 10) -> DataFrame:
    """Memory tokens over dialogue tokens so far, at each so many turns. memory_tokens: (conv_id, turn, tokens)."""
    seq = F.row_number().over(by_turn())
    raw = turns.select("conv_id", "turn", estimate_tokens(F.col("text")).alias("raw")).join(memory_tokens, ["conv_id", "turn"], "left")
    run = by_turn().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = raw.select("conv_id", "turn", seq.alias("n"), F.sum("raw").over(run).alias("raw_tokens"), F.coalesce(F.sum("tokens").over(run), F.lit(0)).alias("memory_tokens"))
    return out.where(F.col("n") % every == 0).withColumn("ratio", F.round(F.col("memory_tokens") / F.col("raw_tokens"), 6))
