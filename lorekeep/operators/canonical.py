"""One text for all spellings of a JSON value, at any depth, and fingerprints made from it.

Values are VARIANTs. They are taken apart level by level, and put together again from the deepest level up: keys sorted,
numbers in one form, no blanks. So there is a round per level of the deepest value, and every round is a plain aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable
from .dense import PREFIXES, family


def _number(text: Column) -> Column:
    """A JSON number: no exponent for whole numbers below 1e15, no zeros at the end of a fraction, no minus zero."""
    d = text.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(whole, d.cast("bigint").cast("string")).when(text.rlike("[eE]"), d.cast("string")).otherwise(plain)


def _scalar(v: Column) -> Column:
    text = F.to_json(v)
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _number(text)).otherwise(text)


def stable_json(values: DataFrame, key: str, json: str) -> DataFrame:
    """(key, stable): the canonical text of each row's JSON text; null where it is null or no JSON. key: unique, not null."""
    spark = values.sparkSession
    top = values.select(F.col(key).alias("_key"), F.try_parse_json(json).alias("_v")).where("_v is not null")
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^(OBJECT|ARRAY)", 1)
    level = top.select("_key", F.lit("").alias("_at"), F.lit(0).alias("_pos"), F.lit(None).cast("string").alias("_name"), kind(F.col("_v")).alias("_kind"), F.col("_v"))
    levels = []
    while True:
        # VARIANT columns are kept as texts between the rounds
        level = durable(level.select("_key", "_at", "_pos", "_name", "_kind", F.when(F.col("_kind") == "", _scalar(F.col("_v"))).otherwise(F.to_json("_v")).alias("_text")), f"json-level{len(levels)}")
        levels.append(level)
        inner = level.where("_kind <> ''")
        if inner.isEmpty():
            break
        inner = inner.withColumn("_v", F.parse_json("_text"))
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        level = below.select("_key", F.concat_ws(".", "_at", F.col("_pos").cast("string")).alias("_at"), F.col("pos").alias("_pos"), F.col("key").alias("_name"), kind(F.col("value")).alias("_kind"), F.col("value").alias("_v"))
    done = levels[-1].select("_key", "_at", "_pos", "_name", "_text")
    for depth in range(len(levels) - 2, -1, -1):
        here = levels[depth]
        entry = F.struct(F.coalesce("_name", F.lit("")).alias("n"), "_pos", F.when(F.col("_name").isNotNull(), F.concat(F.regexp_replace(F.to_json(F.array("_name")), r"^\[|\]$", ""), F.lit(":"), "_text")).otherwise(F.col("_text")).alias("t"))
        parts = done.groupBy("_key", F.col("_at").alias("_in")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]).alias("_p"))  # the members of one container
        full = here.withColumn("_in", F.concat_ws(".", "_at", F.col("_pos").cast("string"))).join(parts, ["_key", "_in"], "left")
        inside = F.array_join(F.coalesce("_p", F.array().cast("array<string>")), ",")
        text = F.when(F.col("_kind") == "OBJECT", F.concat(F.lit("{"), inside, F.lit("}"))).when(F.col("_kind") == "ARRAY", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(F.col("_text"))
        done = durable(full.select("_key", "_at", "_pos", "_name", text.alias("_text")), f"json-up{depth}")
    out = done.select(F.col("_key").alias(key), F.col("_text").alias("stable"))
    return values.select(key).join(out, key, "left")


#: Fixed values of a profile: its version, what may be chosen, the rank constant of fused queries.
VERSION, ROLES, NORMS, RANK_CONSTANT = 1, ("symmetric", "prefix"), ("auto", "l2", "none"), 60
CHOSEN = ("generic", "jina", "e5", "bge", "qwen3", "openai", "voyage")


def embedding_profiles(configs: DataFrame, key: str, json: str) -> DataFrame:
    """The normal form of every configuration, and its two fingerprints.

    space_fingerprint covers what makes vectors comparable, policy_fingerprint how hits are judged; both are SHA-256 heads of
    canonical JSON, so that key order, blanks and spelled-out defaults do not matter. Columns: key, family, role_strategy,
    query_prefix, document_prefix, dimensions, normalization, multi_query_rrf_k, space_fingerprint, policy_fingerprint.
    """
    v = F.coalesce(F.try_parse_json(json), F.parse_json(F.lit("{}")))
    text = lambda name: F.trim(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))
    number = lambda name: F.try_variant_get(v, f"$.{name}", "double")
    low = lambda name: F.lower(text(name))
    unit = lambda name: F.when(number(name).isNotNull() & ~F.isnan(number(name)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(name))))
    kind = F.when(low("family").isin(*CHOSEN), low("family")).otherwise(family(F.concat_ws(" ", text("model"), text("endpoint"), text("provider"))))
    rows = configs.select(F.col(key), F.when(low("provider") == "", "unknown").otherwise(low("provider")).alias("provider"), text("model").alias("model"), text("endpoint").alias("endpoint"), kind.alias("family"), v.alias("_v"))
    v = F.col("_v")
    role = F.when(low("role_strategy").isin(*ROLES), low("role_strategy")).when(F.col("family").isin(*PREFIXES), "prefix").otherwise("symmetric")
    rows = rows.withColumn("role_strategy", role)
    size = number("dimensions")
    default = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for name, p in PREFIXES.items() for x in (name, p[k])]), F.col("family")), F.lit(""))
    raw = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    prefix = lambda name, k: F.when(F.col("role_strategy") == "prefix", F.when(F.trim(raw(name)) != "", F.trim(raw(name))).otherwise(default(k))).otherwise("")
    fused = F.coalesce(F.try_variant_get(v, "$.multi_query_fusion", "boolean"), F.lit(True))
    constant = F.floor(F.coalesce(number("multi_query_rrf_k"), F.lit(0.0)))
    rows = rows.select(
        key, "provider", "model", "endpoint", "family", "role_strategy", prefix("query_prefix", 0).alias("query_prefix"), prefix("document_prefix", 1).alias("document_prefix"),
        F.when((size > 0) & (size == F.floor(size)), size.cast("long")).alias("dimensions"), F.when(low("normalization").isin(*NORMS), low("normalization")).otherwise("auto").alias("normalization"),
        F.struct(*[unit(f"score_policy.{p}").alias(p) for p in ("memory", "setting", "baseline")]).alias("score_policy"), fused.alias("multi_query_fusion"),
        F.greatest(F.lit(1), F.least(F.lit(500), F.when(constant == 0, F.lit(RANK_CONSTANT)).otherwise(constant))).cast("long").alias("multi_query_rrf_k"),
    )
    rows = durable(rows, "profiles")
    space = F.struct(F.lit(VERSION).alias("version"), "provider", "model", "endpoint", "family", "role_strategy", "query_prefix", "document_prefix", "dimensions", "normalization")
    policy = F.struct(F.lit(VERSION).alias("version"), "score_policy", "multi_query_fusion", "multi_query_rrf_k")
    whole = {"ignoreNullFields": "false"}
    for name, payload, head in (("space_fingerprint", space, "es"), ("policy_fingerprint", policy, "rp")):
        made = stable_json(rows.select(key, F.to_json(payload, whole).alias("_j")), key, "_j")
        rows = rows.join(made.select(key, F.concat(F.lit(f"{head}{VERSION}:"), F.left(F.sha2("stable", 256), F.lit(16))).alias(name)), key)
    return rows.select(key, "family", "role_strategy", "query_prefix", "document_prefix", "dimensions", "normalization", "multi_query_rrf_k", "space_fingerprint", "policy_fingerprint")
