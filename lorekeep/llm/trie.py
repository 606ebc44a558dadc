"""A z-fast trie over conversations as sequences of turns, held in tables.

The compacted trie has a node where conversations part or end. Its edges lie on the paths of *owners*: the conversation that
brought a path into the trie owns the turns of it that were new, so a node is (owner, extent), extent being its depth. The
node is hashed at its handle: the prefix of its path whose length is the two-fattest number in the edge, the one divisible
by the largest power of two. A fat binary search over the lengths of a conversation finds its exit node by a logarithmic
number of look-ups of such prefixes; where it leaves the edge follows from comparing it with the edge's owner.

Conversations are inserted in batches: all that are outside search at once; of those that leave the trie at one place with
one next turn, one, chosen by hash, becomes an owner, and the others search again in the next batch. Their expected number
grows with the logarithm of the conversations. Prefixes are known by 128-bit sums of position-dependent hashes of turns, so
that a conversation of any length can be hashed in many tasks; equal sums are taken for equal prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan
from .base import durable

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
_HALVES = ("p1", "p2", "p3", "p4")


def plain_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, sha, chars): rows with a conversation, null roles and texts empty, sha the text's SHA-256."""
    text = F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("sha"), F.length(text).cast("long").alias("chars")
    )


#: Turns of a conversation come in this order; rows of one turn by role and SHA-256 of the text.
ORDER = ["turn", "role", "sha"]


def halves(d: Column) -> dict[str, Column]:
    """What a turn (role, sha) adds at depth d to the four sums."""
    one, two = (F.xxhash64(F.lit(k), F.col("role"), F.col("sha"), d.cast("long")) for k in (1, 2))
    low = F.lit(0xFFFFFFFF).cast("long")
    return dict(zip(_HALVES, (F.shiftrightunsigned(one, 32), one.bitwiseAND(low), F.shiftrightunsigned(two, 32), two.bitwiseAND(low))))


def prefixes(turns: DataFrame, d: str, keep: dict[str, Column]) -> DataFrame:
    """(conv_id, d, fa, fb, *keep): the digest of the first d turns; keep are further running sums. turns: a row per depth."""
    summed = scan.running(turns, ["conv_id"], [d], {**halves(F.col(d)), **keep}, "trie-prefixes")
    whole = lambda a, b: F.shiftleft(F.col(a), 32).bitwiseOR(F.col(b).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return summed.withColumns({"fa": whole("p1", "p2"), "fb": whole("p3", "p4")}).drop(*_HALVES)


def two_fattest(lo: Column, hi: Column) -> Column:
    """The number in (lo, hi] that the largest power of two divides; lo < hi."""
    drop = F.length(F.bin(lo.bitwiseXOR(hi))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", hi, drop), drop)


@dataclass
class Trie:
    """owners (conv_id, n, up, at, batch): path of n turns that leaves up's (null: the root) after at of them.

    nodes (conv_id, above, extent): the owner's edges, each from above (exclusive) to extent.
    ends (rep, owner, n): where each distinct sequence, known by its representative, ends.
    members (conv_id, rep); batches: their number.
    """

    owners: DataFrame
    nodes: DataFrame
    ends: DataFrame
    members: DataFrame
    batches: int


def edges(owners: DataFrame, extents: DataFrame) -> DataFrame:
    """(conv_id, above, extent) from the owners and their extents (conv_id, extent)."""
    path = Window.partitionBy("conv_id").orderBy("extent")
    return extents.join(owners.select("conv_id", "at"), "conv_id").select("conv_id", F.coalesce(F.lag("extent").over(path), "at").alias("above"), "extent")


def locate(outside: DataFrame, paths: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """(conv_id, n, owner, left): each conversation outside (conv_id, n) follows owner's path for left turns; null and 0 at the root.

    steps: the binary digits of the largest n.
    """
    own = durable(paths.join(outside.select("conv_id"), "conv_id", "left_semi").select("conv_id", "d", "fa", "fb"), "trie-outside")
    handle = nodes.withColumn("d", two_fattest(F.col("above"), F.col("extent"))).join(paths, ["conv_id", "d"])
    handle = durable(handle.select(F.col("conv_id").alias("h"), F.col("extent").alias("he"), F.col("d").alias("hd"), "fa", "fb"), "trie-handles")
    s = outside.select("conv_id", "n", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("known"), F.lit(0).cast("long").alias("extent"))
    for _ in range(steps):
        probe = s.withColumn("d", F.when(F.col("lo") < F.col("hi"), two_fattest(F.col("lo"), F.col("hi"))))
        seen = probe.join(own, ["conv_id", "d"], "left").join(handle, ["fa", "fb"], "left")
        hit = F.col("h").isNotNull()
        s = seen.select(
            "conv_id", "n", F.when(hit, F.least("he", "hi")).otherwise(F.col("lo")).alias("lo"), F.when(hit | F.col("d").isNull(), F.col("hi")).otherwise(F.col("d") - 1).alias("hi"),
            F.coalesce("h", "owner").alias("owner"), F.coalesce("hd", "known").alias("known"), F.coalesce("he", "extent").alias("extent"),
        )
    # the node found is the exit node or, if the next turn goes on, its parent
    name = nodes.withColumn("d", F.col("above") + 1).join(paths, ["conv_id", "d"]).select(F.col("conv_id").alias("c"), F.col("extent").alias("ce"), F.col("d").alias("cd"), "fa", "fb")
    s = s.withColumn("d", F.col("extent") + 1).join(own, ["conv_id", "d"], "left").join(name, ["fa", "fb"], "left")
    s = s.select("conv_id", "n", F.coalesce("c", "owner").alias("owner"), F.coalesce("cd", "known").alias("known"), F.coalesce("ce", "extent").alias("extent"))
    s = durable(s, "trie-exits")
    edge = s.where("owner is not null").select("conv_id", "owner", "known", F.least("extent", "n").alias("last")).join(own, "conv_id").where("d > known and d <= last")
    other = paths.select(F.col("conv_id").alias("owner"), "d", F.col("fa").alias("ga"), F.col("fb").alias("gb"))
    same = edge.join(other, ["owner", "d"]).where("fa = ga and fb = gb").groupBy("conv_id").agg(F.count("*").alias("more"))
    return s.join(same, "conv_id", "left").select("conv_id", "n", "owner", (F.col("known") + F.coalesce("more", F.lit(0))).alias("left"))


def build(paths: DataFrame, lengths: DataFrame) -> Trie:
    """The trie of the paths (conv_id, d, fa, fb), durable, of conversations of lengths (conv_id, n), n >= 0."""
    last = lengths.join(paths.withColumnRenamed("d", "n"), ["conv_id", "n"], "left")
    reps = last.groupBy("fa", "fb", "n").agg(F.min("conv_id").alias("rep"))
    same = (F.col("l.n") == F.col("r.n")) & F.col("l.fa").eqNullSafe(F.col("r.fa")) & F.col("l.fb").eqNullSafe(F.col("r.fb"))
    members = durable(last.alias("l").join(reps.alias("r"), same).select("l.conv_id", "r.rep"), "trie-members")
    reps = durable(reps.select("rep", "n"), "trie-sequences")
    spark = paths.sparkSession
    steps = int(reps.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]).bit_length()
    owners = spark.createDataFrame([], "conv_id long, n long, up long, at long, batch int")
    extents = spark.createDataFrame([], "conv_id long, extent long")
    ends = reps.where("n = 0").select("rep", F.lit(None).cast("long").alias("owner"), "n")
    outside = reps.where("n > 0").select(F.col("rep").alias("conv_id"), "n")
    batch = 0
    while not outside.isEmpty():
        if batch:
            found = locate(outside, paths, edges(owners, extents), steps)
        else:
            found = outside.select("conv_id", "n", F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("left"))
        batch += 1
        leaving = found.where("left < n").withColumn("d", F.col("left") + 1).join(paths, ["conv_id", "d"])
        first = leaving.groupBy("fa", "fb", "d").agg(F.min_by("conv_id", F.struct(F.xxhash64("conv_id"), "conv_id")).alias("conv_id")).select("conv_id", F.lit(True).alias("goes_in"))
        found = durable(found.join(first, "conv_id", "left"), f"trie-found{batch}")
        new = found.where("goes_in").select("conv_id", "n", F.col("owner").alias("up"), F.col("left").alias("at"), F.lit(batch).alias("batch"))
        inside = found.where("left = n")
        split = new.where("up is not null").select(F.col("up").alias("conv_id"), F.col("at").alias("extent")).unionByName(inside.select(F.col("owner").alias("conv_id"), F.col("n").alias("extent")))
        extents = durable(extents.unionByName(split).unionByName(new.select("conv_id", F.col("n").alias("extent"))).distinct(), f"trie-extents{batch}")
        owners = durable(owners.unionByName(new), f"trie-owners{batch}")
        ends = ends.unionByName(inside.select(F.col("conv_id").alias("rep"), "owner", "n"))
        outside = found.where("left < n and goes_in is null").select("conv_id", "n")
    ends = durable(ends.unionByName(owners.select(F.col("conv_id").alias("rep"), F.col("conv_id").alias("owner"), "n")), "trie-ends")
    return Trie(owners, durable(edges(owners, extents), "trie-nodes"), ends, members, batch)
