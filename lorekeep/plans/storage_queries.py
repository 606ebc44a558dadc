"""Queries over jobs that write: streamed ingest, imports, stored tables, backfill, settling vectors, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dense, ingest as I, oplog
from ..sources.shared import folder as place
from ..streaming import state as S, turns as R
from .conversation_queries import PAIRS, TURNS
from .driver import OPS_SQL, ops, table, turns
from .oplog_queries import VERSIONS, state_ops, versions
from .registry import query
from .settings_queries import ENTRIES, entries


FOLDED = ("conv_id", "slot", "kind", "text", "valid_from", "valid_until", "status")


def streamed(spark, batches):
    """The memories that a stream leaves whose files are these tables, one batch each."""
    at = place(spark, "ingest")
    for k, rows in enumerate(batches):
        rows.write.parquet(f"{at}/in/part={k}")
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 8).parquet(f"{at}/in/*")
    S.ingest(stream, f"{at}/changes", f"{at}/state").awaitTermination()
    return S.current(spark.read.parquet(f"{at}/changes")).select(*FOLDED)


@query("r2_ingest_ops", VERSIONS + " select conv_id, slot, kind, text, valid_from, valid_until, status from versions")
def r2(spark, d):
    """The log comes in three parts, out of order; the memories that they leave are those of the whole log."""
    log = state_ops(spark, d).withColumn("target_slot", F.col("slot"))
    return streamed(spark, [log.where(F.col("msg") % 3 == k) for k in range(3)])


@query("r2_extracted_again", VERSIONS.replace("from events)", "from events where event_id % 10 <> 3)") + " select conv_id, slot, kind, text, valid_from, valid_until, status from versions")
def r2b(spark, d):
    """Every tenth message is extracted again, with nothing in it: what followed from it is withdrawn."""
    log = state_ops(spark, d).withColumns({"target_slot": F.col("slot"), "tx": F.lit(1).cast("long")})
    again = log.where("msg % 10 = 3").withColumns({"op": F.lit("noop"), "tx": F.lit(2).cast("long")})
    return streamed(spark, [log, again])


@query("r4_backfill", PAIRS + ", n as (select conv_id, assistant_turn, row_number() over (partition by conv_id order by assistant_turn) as r from pairs p where assistant_turn % 3 <> 0 and not contains(assistant_text, '<memory_ops')) select conv_id, assistant_turn from n where r <= 200")
def r4(spark, d):
    """The first pairs of each conversation without a record; every third turn has one."""
    t = turns(spark, d)
    have = R.pair_keys(R.pair_turns(t)).where("assistant_turn % 3 = 0")
    return R.backfill(t, have, most=200).select("conv_id", "assistant_turn")


@query("r5_settle_horizon", VERSIONS + ", n as (select conv_id, max(msg) + 1 as n from ops group by conv_id) select conv_id, slot, version from versions join n using (conv_id) where status in ('active', 'closed') and valid_from <= n - 1 - 500 and valid_from % 2 = 1")
def r5(spark, d):
    """Values of even messages have their vectors; the others get them once they are 500 messages old."""
    n = ops(spark, d).groupBy("conv_id").agg((F.max("msg") + 1).alias("n"))
    stored = F.when(F.col("valid_from") % 2 == 0, F.xxhash64("text"))
    open_ = oplog.is_indexable(F.lit(True), F.col("status"), F.col("text"), F.lit(True), F.col("importance"), F.col("kind"))
    return R.settled_without_vector(versions(spark, d).withColumn("vector_hash", stored), n, open_, settle=500).select("conv_id", "slot", "version")


@query("s9_import_commit", "with s as (select source as world_id, text, min('d' || doc_id) as dup from documents where doc_id % 2 = 0 group by source, text) select d.doc_id, coalesce(s.dup, 'src_' || substr(sha256(d.source || '|' || d.doc_id || '.txt|' || sha256(d.text)), 1, 16)) as reuse, case when s.dup is null then 'new' else 'known' end as state from documents d left join s on s.world_id = d.source and s.text = d.text")
def s9(spark, d):
    """Known content keeps its source; the rest gets a new one."""
    doc = table(spark, d, "documents")
    have = doc.where("doc_id % 2 = 0").select(F.col("source").alias("world_id"), F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("d"), "doc_id").alias("source_id"))
    seen = I.preview_import(doc.select("doc_id", F.col("source").alias("world_id"), F.concat("doc_id", F.lit(".txt")).alias("filename"), "text"), have)
    return I.commit_import(seen).select("doc_id", F.col("source_id").alias("reuse"), F.when(F.col("duplicate_of").isNull(), "new").otherwise("known").alias("state"))


@query("s10_write_derived", f"with {ENTRIES} select entry_id, world_id, case when world_id like '%3' then 'second' else 'first' end as title from entries where entry_id % 2 = 0 or world_id like '%3'")
def s10(spark, d):
    """Derived rows by world, then those of some worlds again: only these worlds' parts are replaced."""
    at, e = place(spark, "derived"), entries(spark, d).select("entry_id", "world_id")
    I.write_derived(e.where("entry_id % 2 = 0").withColumn("title", F.lit("first")), at, "world_id")
    I.write_derived(e.where("world_id like '%3'").withColumn("title", F.lit("second")), at, "world_id")
    return spark.read.parquet(at).select("entry_id", "world_id", "title")


@query("s11_export_import", f"with {ENTRIES} select entry_id, world_id, title, md5(content) as h, ord from entries")
def s11(spark, d):
    """All entries written as versioned JSON lines and read again."""
    at = place(spark, "export")
    I.export_settings({"entries": entries(spark, d).select("entry_id", "world_id", "title", "content", "ord")}, at)
    back = I.import_settings(spark, {"entries": "entry_id long, world_id string, title string, content string, ord double"}, at)["entries"]
    return back.select("entry_id", "world_id", "title", F.md5("content").alias("h"), "ord")


@query("s10_write_canonical", f"with {OPS_SQL} select conv_id, msg, 1::bigint as n from ops")
def s10b(spark, d):
    """Canonical rows only grow: what is written twice is there once."""
    at, o = place(spark, "canonical"), ops(spark, d).select("conv_id", "msg", "op")
    I.write_canonical(o.where("msg % 2 = 0"), at, ["conv_id", "msg"])
    I.write_canonical(o.where("op = 'add' or msg % 2 = 1"), at, ["conv_id", "msg"])
    return spark.read.parquet(at).groupBy("conv_id", "msg").agg(F.count(F.lit(1)).alias("n"))


@query("h6_tokens_to_chars", f"with {TURNS} select conv_id, turn, cast(floor(100 * case when length(text) > 0 then length(text) / greatest(1, ceil(0.2441 * length(text))) else 1 / 0.2441 end) as bigint) as chars from t")
def h6(spark, d):
    """Characters that 100 tokens hold at each turn's own ratio."""
    return turns(spark, d).select("conv_id", "turn", X.tokens_to_chars(F.lit(100), F.col("text")).alias("chars"))


@query("h8_vector_codec", "select vec_id, len(embedding)::integer as n, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 6) as square from embeddings")
def h8(spark, d):
    """Vectors written as text and read again are the same."""
    back = dense.decode(dense.encode(F.col("embedding")))
    return table(spark, d, "embeddings").select("vec_id", F.size(back).alias("n"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x.cast("double") * x), 6).alias("square"))


@query("h14_calibrated_threshold", "select item, case when own between 0 and 1 then own else least(1.0, greatest(0.0, coalesce(asked, 0))) end as threshold from (select doc_id as item, case when doc_id % 4 <> 0 then (doc_id % 7 - 2) / 4.0 end as own, case when doc_id % 5 <> 0 then (doc_id % 9 - 3) / 4.0 end as asked from documents)")
def h14(spark, d):
    """An index's own threshold where it is valid, else the one asked for."""
    i = F.col("doc_id")
    own, asked = F.when(i % 4 != 0, (i % 7 - 2) / 4.0), F.when(i % 5 != 0, (i % 9 - 3) / 4.0)
    return table(spark, d, "documents").select(i.alias("item"), dense.calibrated_threshold(asked, own).alias("threshold"))
