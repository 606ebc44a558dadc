"""The engine's tables, derived from the given ones: turns, an operation log, reference entries, vectors.

conversations are the turns. events are an operation log: the user is the conversation, the event the message; signup
adds, purchase supersedes, error closes, view reinforces and click updates; the slot is the number in props modulo 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("state", "knowledge", "commitment", "relation", "event")
IMPORTANCE = ("low", "medium", "high", "critical")
OPS = {"signup": "add", "purchase": "supersede", "error": "close", "view": "reinforce", "click": "update"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue rows; the system's are out."""
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", "text")


def pick(names: tuple[str, ...], n) -> F.col:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, msg, op, slot, kind, importance, text, k)."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    op = F.element_at(F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv]), F.col("event_type"))
    return e.select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("msg"), op.alias("op"), F.concat(F.lit("slot"), F.col("k") % 5).alias("slot"),
        pick(KINDS, F.floor(F.col("k") / 5)).alias("kind"), pick(IMPORTANCE, F.floor(F.col("k") / 7)).alias("importance"), F.concat(F.lit("value "), F.col("k")).alias("text"), "k",
    )


#: The same log for DuckDB.
OPS_SQL = """ops as (
  select user_id as conv_id, event_id as msg,
         case event_type when 'signup' then 'add' when 'purchase' then 'supersede' when 'error' then 'close' when 'view' then 'reinforce' when 'click' then 'update' end as op,
         'slot' || (k % 5) as slot, (['state','knowledge','commitment','relation','event'])[(k // 5) % 5 + 1] as kind,
         (['low','medium','high','critical'])[(k // 7) % 4 + 1] as importance, 'value ' || k as text, k
  from (select *, cast(json_extract(props, '$.k') as bigint) as k from events))"""
