"""Where two histories of a conversation part, found by comparing digests.

Every row's digest depends on its place; a prefix's digest is their sum, and a block's is that of the prefix that it ends. So
prefixes of any length are hashed in many tasks, and two histories are compared block by block first: only rows of the one
block in which they part are compared with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable
from . import scan

BLOCK = 256
_PARTS = ("s1", "s2", "s3", "s4")


def row_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a row; nulls are empty."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, F.lit(":"), t), 256)


def _parts(pos: Column, digest: Column) -> dict[str, Column]:
    placed = F.sha2(F.concat_ws(":", pos.cast("string"), digest), 256)
    return {name: F.conv(F.substring(placed, 8 * k + 1, 8), 16, 10).cast("long") for k, name in enumerate(_PARTS)}


def prefix_digest() -> Column:
    """The four sums modulo 2^32 as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.pmod(F.col(s), F.lit(1 << 32))), 8, "0") for s in _PARTS]))


def chain(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn, role, row, prefix): the digest of every row and of all rows up to it. turns: (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", "turn", "role", row_digest(F.col("role"), F.col("text")).alias("row"))
    placed = scan.running(rows, ["conv_id"], ["turn", "row"], {"pos": F.lit(1)}, "history-rows")
    summed = scan.running(placed, ["conv_id"], ["pos"], _parts(F.col("pos"), F.col("row")), "history-sums")
    return summed.select("conv_id", "pos", "turn", "role", "row", prefix_digest().alias("prefix"))


def blocks(chained: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, block, n, prefix): how many rows there are up to a block's end, and their digest."""
    return chained.groupBy("conv_id", F.floor((F.col("pos") - 1) / size).alias("block")).agg(F.max("pos").alias("n"), F.max_by("prefix", "pos").alias("prefix"))


def branch_ids(chained: DataFrame) -> DataFrame:
    """(conv_id, branch_id, n_rows): a conversation's identity is the digest of all its rows."""
    return chained.groupBy("conv_id").agg(F.max_by("prefix", "pos").alias("branch_id"), F.max("pos").alias("n_rows"))


def first_change(old: DataFrame, new: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, kind, pos, turn, n_old, n_new): the first row at which two chained histories differ, and how.

    kind: same, append (all old rows are there), swipe (another last assistant row), edit, delete, insert; new or gone for
    conversations of one side only. turn is the row's in the new history, or in the old one if it ends before. pos and turn
    are null where nothing differs.
    """
    o, n = blocks(old, size), blocks(new, size)
    both = o.select("conv_id", "block", F.col("n").alias("no"), F.col("prefix").alias("po")).join(n.select("conv_id", "block", F.col("n").alias("nn"), F.col("prefix").alias("pn")), ["conv_id", "block"], "full")
    differs = ~(F.col("po").eqNullSafe(F.col("pn")) & F.col("no").eqNullSafe(F.col("nn")))
    per = both.groupBy("conv_id").agg(F.min(F.when(differs, F.col("block"))).alias("block"), F.coalesce(F.max("no"), F.lit(0)).alias("n_old"), F.coalesce(F.max("nn"), F.lit(0)).alias("n_new"))
    per = durable(per, "history-blocks")
    at = per.where("block is not null").select("conv_id", "block")
    # the rows of that block and the one after it
    near = lambda df, *names: df.join(at, "conv_id").where((F.col("pos") > F.col("block") * size) & (F.col("pos") <= F.col("block") * size + size + 1)).select("conv_id", "pos", *[F.col(c).alias(a) for c, a in zip(("turn", "role", "row"), names)])
    rows = durable(near(old, "t_old", "r_old", "d_old").join(near(new, "t_new", "r_new", "d_new"), ["conv_id", "pos"], "full"), "history-rows-near")
    first = rows.where(~F.col("d_old").eqNullSafe(F.col("d_new"))).groupBy("conv_id").agg(F.min(F.struct("pos", "t_old", "r_old", "d_old", "t_new", "r_new", "d_new")).alias("f"))
    first = first.select("conv_id", "f.*")
    after = rows.select("conv_id", (F.col("pos") - 1).alias("pos"), F.col("d_old").alias("next_old"), F.col("d_new").alias("next_new"))
    out = per.join(first.join(after, ["conv_id", "pos"], "left"), "conv_id", "left")
    last = (F.col("pos") == F.col("n_old")) & (F.col("n_old") == F.col("n_new")) & (F.col("r_old") == "assistant") & (F.col("r_new") == "assistant")
    kind = (
        F.when(F.col("n_old") == 0, "new").when(F.col("n_new") == 0, "gone").when(F.col("block").isNull(), "same").when(F.col("d_old").isNull(), "append").when(F.col("d_new").isNull(), "delete")
        .when(last, "swipe").when(F.col("next_old") == F.col("d_new"), "delete").when(F.col("next_new") == F.col("d_old"), "insert").otherwise("edit")
    )
    return out.select("conv_id", kind.alias("kind"), "pos", F.coalesce("t_new", "t_old").alias("turn"), "n_old", "n_new")


def stale(records: DataFrame, changes: DataFrame) -> DataFrame:
    """The records (conv_id, turn, ...) at or after the first changed row: replay starts from those before it. Appended rows make none stale."""
    at = changes.where("kind not in ('same', 'append', 'new')").select("conv_id", F.col("turn").alias("_from"))
    return records.join(at, "conv_id").where(F.col("turn") >= F.col("_from")).drop("_from")
