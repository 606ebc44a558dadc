"""Index versions with verification, and changes of the revision tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, at: str = "changed_at") -> DataFrame:
    """Tables only grow; the newest row of a key counts, unless it deletes."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), at).alias("r")).select("r.*")
    return newest.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def cascade(deleted: DataFrame, worlds: DataFrame, sources: DataFrame, revisions: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """The tables without the deleted worlds and all that hangs on them. deleted: (world_id)."""
    s = sources.join(deleted, "world_id", "left_anti")
    r = revisions.join(s.select("source_id"), "source_id", "left_semi")
    return {"worlds": worlds.join(deleted, "world_id", "left_anti"), "sources": s, "revisions": r, "entries": entries.join(r.select("revision_id"), "revision_id", "left_semi")}


def activate_baseline(worlds: DataFrame, world_id: str, revision_id: str, revisions: DataFrame) -> DataFrame:
    """Another active baseline; extensions that build on the old one are dropped."""
    fits = revisions.where((F.col("kind") == "extension") & (F.col("base_id") == revision_id)).select(F.collect_set("revision_id").alias("fits"))
    mine = F.col("world_id") == world_id
    rows = worlds.crossJoin(fits)  # one row
    return rows.select("world_id", F.when(mine, F.lit(revision_id)).otherwise(F.col("baseline_id")).alias("baseline_id"), F.when(mine, F.array_intersect("extension_ids", "fits")).otherwise(F.col("extension_ids")).alias("extension_ids"))


def verify_index(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(expected, stored, missing, foreign) of a new index version, by hash; it may become active if the last two are 0."""
    c, i = chunks.select(F.col("hash").alias("want")), index.select(F.col("hash").alias("have"))
    both = c.join(i, F.col("want") == F.col("have"), "full_outer")
    return both.agg(F.count("want").alias("expected"), F.count("have").alias("stored"), F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("foreign"))


def refresh_index(chunks: DataFrame, index: DataFrame, plan: DataFrame) -> DataFrame:
    """The index after a plan (entry_id, insert, delete): rows of deleted hashes go, inserted ones come from the chunks."""
    gone = plan.select(F.explode("delete").alias("hash"))
    come = plan.select(F.explode("insert").alias("hash"))
    return index.join(gone, "hash", "left_anti").unionByName(chunks.join(come, "hash", "left_semi").select(*index.columns))


def active_version(versions: DataFrame) -> DataFrame:
    """Per collection the newest verified version; a failed refresh leaves the last good one."""
    return versions.where("verified").groupBy("collection").agg(F.max("version").alias("version"))
