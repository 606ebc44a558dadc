"""Records out of model replies and messages, source collection, imports, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable
from .oplog import EPISTEMICS, IMPORTANCES, MEMORY_KINDS, OP_TYPES, STATUSES

OP = (
    "struct<op:string,kind:string,text:string,slot:string,target_id:string,target_slot:string,status:string,importance:string,epistemic:string,"
    "reason:string,scope:string,entities:array<string>,topics:array<string>,known_by:array<string>,indexable:boolean>"
)


def parse_ops(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations, errors) of the memory_ops blocks of messages (conv_id, msg, text).

    A block is taken apart at line ends that follow a closing and precede an opening brace, so objects over several lines
    stay whole; what doesn't parse is reported by its place, and an unclosed block as an error of place -1.
    """
    body = F.regexp_extract("text", r"(?is)<memory_ops>(.*?)</memory_ops>", 1)
    parts = F.filter(F.split(F.trim(body, F.lit(" \n\t\r")), r"(?<=\})\s*(?:\n|,)\s*(?=\{)|(?<=\})\s+(?=\{)"), lambda x: x != "")
    rows = messages.select("conv_id", "msg", F.posexplode(parts).alias("op_idx", "raw")).withColumn("ok", F.try_parse_json("raw").isNotNull() & F.rtrim("raw").endswith("}"))
    ops = rows.where("ok").select("conv_id", "msg", "op_idx", F.from_json("raw", OP).alias("op"))
    bad = rows.where("not ok").select("conv_id", "msg", "op_idx", F.lit("invalid JSON").alias("error"))
    unclosed = messages.where(F.col("text").rlike("(?is)<memory_ops>") & ~F.col("text").rlike("(?is)</memory_ops>")).select("conv_id", "msg", F.lit(-1).alias("op_idx"), F.lit("unclosed block").alias("error"))
    return ops, bad.unionByName(unclosed)


def _known(op: Column) -> Column:
    """An operation whose fields of unknown value are null."""
    keep = lambda field, names: F.when(op[field].isin(*names), op[field])
    return op.withField("kind", keep("kind", MEMORY_KINDS)).withField("status", keep("status", STATUSES)).withField("importance", keep("importance", IMPORTANCES)).withField("epistemic", keep("epistemic", EPISTEMICS))


def parse_extractions(replies: DataFrame) -> DataFrame:
    """S3: (id, ok, event_summary, active_state, operations, dropped, warnings) of model replies (id, raw).

    Tried in turn: the reply, the reply without code fences, what lies between the first and the last brace without
    trailing commas. Operations of unknown type are dropped and counted; operations must be an array.
    """
    raw = F.trim(F.coalesce("raw", F.lit("")), F.lit(" \n\t\r"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_replace(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), r",(\s*[}\]])", "$1")
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c)
    rows = replies.select("id", F.coalesce(valid(raw), valid(bare), valid(inner)).alias("json"))
    rows = rows.withColumn("r", F.from_json("json", f"struct<event_summary:string,active_state:string,operations:array<{OP}>>"))
    is_list = F.schema_of_variant(F.try_variant_get(F.try_parse_json("json"), "$.operations", "variant")).startswith("ARRAY")
    ok = F.col("json").isNotNull() & F.coalesce(is_list, F.lit(False))
    given = F.coalesce("r.operations", F.array().cast(f"array<{OP}>"))
    kept = F.transform(F.filter(given, lambda o: o["op"].isin(*OP_TYPES)), _known)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    warnings = F.array_compact(F.array(F.when(blank(F.col("r.event_summary")), "missing event_summary"), F.when(blank(F.col("r.active_state")), "missing active_state")))
    tidy = lambda c: F.left(F.trim(F.coalesce(c, F.lit(""))), F.lit(1800))
    return rows.select("id", ok.alias("ok"), F.when(ok, tidy("r.event_summary")).otherwise("").alias("event_summary"), F.when(ok, tidy("r.active_state")).otherwise("").alias("active_state"), F.when(ok, kept).otherwise(F.array().cast(f"array<{OP}>")).alias("operations"), F.when(ok, F.size(given) - F.size(kept)).otherwise(0).alias("dropped"), F.when(ok, warnings).alias("warnings"))


def collect_sources(*scans: DataFrame) -> DataFrame:
    """Sources (source_type, source_id, title, text, disabled) of all kinds; disabled and empty ones and equal copies go."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out.where(~F.coalesce("disabled", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != "")).dropDuplicates(["source_type", "source_id", "text"])


def content_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def preview_import(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """Incoming (world_id, filename, text) with its hash and the source of the world that has the same content."""
    rows = incoming.withColumn("content_hash", F.sha2("text", 256))
    have = sources.groupBy("world_id", "content_hash").agg(F.min("source_id").alias("duplicate_of"))
    return rows.join(have, ["world_id", "content_hash"], "left")


def commit_import(preview: DataFrame, policy: str = "reuse_source") -> DataFrame:
    """What each incoming file becomes, under the policy for known content: reject, reuse_source or copy_source."""
    fresh = F.concat(F.lit("src_"), F.left(F.sha2(F.concat_ws("|", "world_id", "filename", "content_hash"), 256), F.lit(16)))
    known = F.col("duplicate_of").isNotNull()
    if policy == "reject":
        return preview.where(~known).withColumn("source_id", fresh)
    return preview.withColumn("source_id", F.when(known, F.col("duplicate_of")).otherwise(fresh) if policy == "reuse_source" else fresh)


def write_canonical(rows: DataFrame, path: str, key: list[str]) -> None:
    """Canonical tables only grow, by rows whose key they do not hold: what is written again is there once."""
    spark = rows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = rows.dropDuplicates(key)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        fresh = durable(fresh.join(spark.read.schema(rows.schema).parquet(path).select(*key), key, "left_anti"), "canonical")
    fresh.write.mode("append").parquet(path)


def merge_state(stored: DataFrame, written: DataFrame, owned: list[str]) -> DataFrame:
    """A store's auxiliary fields after a write, key by key. Both: (conv_id, key, value); value null: absent.

    What the writer brings counts, an explicit JSON null too; what it lacks (an unhydrated copy) is kept from the stored ones,
    except for keys that other tables own, which are never brought back.
    """
    new = written.where("value is not null").select("conv_id", "key", F.col("value").alias("new"))
    both = stored.where("value is not null").join(new, ["conv_id", "key"], "full")
    kept = F.when(F.col("new").isNotNull(), F.col("new")).when(~F.col("key").isin(*owned), F.col("value"))
    return both.select("conv_id", "key", kept.alias("value")).where("value is not null")


def write_derived(rows: DataFrame, path: str, by: str) -> None:
    """Derived tables are rebuilt, part by part; parts that rows do not touch stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


VERSION = 1


def export_settings(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines, with the version of the format."""
    for name, df in tables.items():
        df.withColumn("schema_version", F.lit(VERSION)).write.mode("overwrite").json(f"{path}/{name}")


def import_settings(spark, schemas: dict[str, str], path: str) -> dict[str, DataFrame]:
    """The tables again; a newer version than this one is an error when they are read."""
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(f"{schema}, schema_version int").json(f"{path}/{name}")
        checked = F.assert_true(F.col("schema_version") <= VERSION, "newer settings format").isNull()
        out[name] = df.where(checked).drop("schema_version")
    return out
