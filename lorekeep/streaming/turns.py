"""Incremental jobs over turns and operations: micro-batches give what a batch over everything gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical, history, segments
from ..operators.fold import apply_ops
from ..operators.turns import pair_keys, pair_turns


def missing_pairs(turns: DataFrame, extractions: DataFrame, every: int = 1) -> DataFrame:
    """Turn pairs without a record; with every = n only each n-th assistant turn of a conversation starts one."""
    from pyspark.sql import Window

    pairs = pair_keys(pair_turns(turns))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("assistant_turn"))
    due = pairs.withColumn("nth", nth).where(F.col("nth") % every == 0)
    return due.join(extractions.select("conv_id", "pair_key"), ["conv_id", "pair_key"], "left_anti")


def backfill(turns: DataFrame, extractions: DataFrame, most: int = 200, marker: str = "<memory_ops") -> DataFrame:
    """The first so many pairs of each conversation that have no record and whose reply carries no operations itself.

    The canonical memories are then those of ``fold.replay`` over all records.
    """
    from pyspark.sql import Window

    due = missing_pairs(turns, extractions).where(~F.contains("assistant_text", F.lit(marker)))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("assistant_turn"))
    return due.withColumn("place", place).where(F.col("place") <= most)


def rebuild(ops: DataFrame, due: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The memories after the due pairs (``backfill``) have gone to extract, whose operations join those there are, and all are folded in segments."""
    return segments.apply_ops(ops.unionByName(extract(due), allowMissingColumns=True))


def settled_without_vector(memories: DataFrame, sizes: DataFrame, indexable, settle: int) -> DataFrame:
    """Memories that may be indexed, have no vector yet and lie so many messages back. sizes: (conv_id, n messages)."""
    rows = memories.where(indexable & F.col("vector_hash").isNull()).join(sizes, "conv_id")
    return rows.where(F.col("valid_from") <= F.col("n") - 1 - settle)


def touched(changed: DataFrame, table: DataFrame) -> DataFrame:
    """All rows of the conversations that have changed rows."""
    return table.join(changed.select("conv_id").distinct(), "conv_id", "left_semi")


def refold(log: DataFrame, changed: DataFrame) -> DataFrame:
    """The memories of the touched conversations, folded anew from their whole logs."""
    return apply_ops(touched(changed, log))


def ingest_ops(stream: DataFrame, log_path: str, memories_path: str, checkpoint: str):
    """R2: appends each micro-batch to the log and rewrites the memories of the conversations it touches, and only those.

    memories are partitioned by bucket of conversation, so a batch overwrites the buckets that it touches.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again finds its rows in place, as its folder has its number
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        log = spark.read.parquet(log_path).drop("batch")
        bucket = F.pmod(F.xxhash64("conv_id"), F.lit(64))
        buckets = batch.select(bucket.alias("bucket")).distinct()
        rows = log.withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")  # 64 buckets at most
        apply_ops(rows).withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(memories_path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_new_turns(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], records_path: str, checkpoint: str):
    """Every micro-batch's turn pairs that have no record yet go to handle, whose records are stored."""

    def step(batch: DataFrame, batch_id: int) -> None:
        handle(pair_keys(pair_turns(batch))).write.mode("overwrite").parquet(f"{records_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recall_counters(events: DataFrame) -> DataFrame:
    """Counters of memories from the events of used recalls: (conv_id, id, recalled_count, last_recalled)."""
    return events.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("recalled_count"), F.max("msg").alias("last_recalled"))


def recall_signatures(chained: DataFrame, settings: DataFrame) -> DataFrame:
    """(conv_id, signature, msg): what a prefetched recall depends on. chained: ``history.chain``; settings: (conv_id, json).

    The digest of all rows of the conversation, with the canonical text of its settings; msg is the number of rows.
    """
    branch = history.branch_ids(chained)
    said = canonical.stable_json(settings.select("conv_id", "json"), "conv_id", "json")
    mark = F.sha2(F.concat_ws("|", "conv_id", "branch_id", F.coalesce("stable", F.lit(""))), 256)
    return branch.join(said, "conv_id", "left").select("conv_id", mark.alias("signature"), F.col("n_rows").alias("msg"))


def prefetch(results: DataFrame, signatures: DataFrame, path: str) -> None:
    """Stores recalls (conv_id, id, rank) made ahead, under the signatures of now. Nothing is counted yet."""
    results.join(signatures, "conv_id").select("conv_id", "signature", "msg", "id", "rank").write.mode("append").parquet(path)


def parked(spark: SparkSession, path: str, signatures: DataFrame) -> DataFrame:
    """The stored recalls that fit the conversations as they are: (conv_id, signature, msg, id, rank). Others are stale."""
    stored = spark.read.parquet(path)
    return stored.join(signatures.select("conv_id", "signature"), ["conv_id", "signature"], "left_semi").distinct()


def commit_recall(used: DataFrame, path: str) -> None:
    """Notes used recalls (rows of ``parked``) in the ledger. A use is known by conversation and signature: noting it again adds nothing to the counts."""
    used.select("conv_id", "signature", "msg", "id").write.mode("append").parquet(path)


def committed(ledger: DataFrame) -> DataFrame:
    """The ledger's uses, each once, as events for ``recall_counters``."""
    return ledger.select("conv_id", "signature", "msg", "id").distinct()


def purge(table: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of conversations that are still there."""
    return table.join(gone.select("conv_id"), "conv_id", "left_anti")
