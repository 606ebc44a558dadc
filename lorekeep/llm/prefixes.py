"""Which beginnings conversations share: a row per distinct sequence of first turns, from a z-fast trie (``trie``).

A node of the trie stands for its whole edge, so counts are gathered per edge and then expanded to every depth of it. They
go up the owners' paths, the last batch first: what hangs on a path at depth at counts for all its nodes down to that depth.

Defined results: rows without conv_id belong to no conversation; null roles and texts are empty; turns without a number come
first, rows of one turn by role and SHA-256 of the text, repeated rows all count; an empty table has no node, not even a
root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan
from .base import durable
from .trie import EMPTY, ORDER, Trie, build, plain_turns, prefixes

#: Ids that are joined to one string before the strings of a node are hashed in order.
IDS = 4096


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d, role, sha, chars) and lengths (conv_id, n) of all conversations, rebuilt.

    The first h turns, h = crc32(conv_id) % 6, are those of conversation conv_id - conv_id % 100; the others its own.
    """
    own = durable(scan.running(plain_turns(conversations).drop("text"), ["conv_id"], ORDER, {"d": F.lit(1)}, "prefixes-turns").drop("turn"), "prefixes-own")
    sizes = own.groupBy("conv_id").agg(F.max("d").alias("turns"))
    ids = sizes.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"))
    ids = ids.join(sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("there")), "base", "left").withColumn("shared", F.least("h", F.coalesce("there", F.lit(0))))
    ids = durable(ids.select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("n")), "prefixes-ids")
    first = ids.where("shared > 0").select("conv_id", F.col("base"), F.explode(F.sequence(F.lit(1).cast("long"), "shared")).alias("d"))
    first = first.join(own.withColumnRenamed("conv_id", "base").where("d <= 5"), ["base", "d"]).select("conv_id", "d", "role", "sha", "chars")
    rest = own.join(ids, "conv_id").where("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("shared")).alias("d"), "role", "sha", "chars")
    return first.unionByName(rest), ids.select("conv_id", "n")


def _hashed(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A row for each (owner, extent) of rows sorted by it: SHA-256 of the strings in the last column, comma-joined."""
    at, running, out = None, None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for owner, extent, piece in zip(columns[0], columns[1], columns[-1]):
            if (owner, extent) != at:
                if at is not None:
                    out.append((*at, running.hexdigest()))
                at, running = (owner, extent), hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.encode())
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=list(names))
            out = []
    if at is not None:
        out.append((*at, running.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=list(names))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, extent, first, ids): runs of ids of one (owner, extent), of sorted rows (owner, extent, id)."""
    names, types = ["owner", "extent", "first", "ids"], (pa.int64(), pa.int64(), pa.int64(), pa.string())
    held, run = None, []
    for batch in batches:
        out = []
        for owner, extent, i in zip(*[c.to_pylist() for c in batch.columns]):
            if (owner, extent) != held or len(run) >= IDS:
                if run:
                    out.append((*held, run[0], ",".join(map(str, run))))
                held, run = (owner, extent), []
            run.append(i)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    if run:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held, run[0], ",".join(map(str, run))), types)], names=names)


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(owner, extent, ends_sha256): the SHA-256 of the ids that end at each node, ascending, of ends (owner, extent, id).

    The ids are joined in sorted runs first, in all tasks; only the hash of a node's runs is one after the other.
    """
    ends = ends.select("owner", "extent", "id")
    runs = ends.repartitionByRange("owner", "extent", "id").sortWithinPartitions("owner", "extent", "id").mapInArrow(_joined, "owner long, extent long, first long, ids string")
    sorted_ = runs.repartition("owner", "extent").sortWithinPartitions("owner", "extent", "first").select("owner", "extent", "ids")
    return sorted_.mapInArrow(lambda b: _hashed(b, ("owner", "extent", "ends_sha256")), "owner long, extent long, ends_sha256 string")


def gathered(tree: Trie, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of every node and of the root.

    values (owner, extent, n_convs, least, chars): what ends at each node, chars over all its members; (conv_id, brought) joined
    by the owner gives the characters that it brought into the trie. Returns (conv_id, above, extent, n_convs, least, chars,
    brought, n_leaves, n_children), brought and n_leaves without the edge's own owner, and one row of the same for the root.
    """
    ends, brought = values
    hung = tree.owners.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("extent")).agg(F.count("*").alias("hanging"))
    leaves = tree.owners.join(hung, (tree.owners["conv_id"] == hung["conv_id"]) & (tree.owners["n"] == hung["extent"]), "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    owners = durable(tree.owners.join(brought, "conv_id").join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0).cast("long"))), "prefixes-owners")
    zero = F.lit(0).cast("long")
    coming = ends.select(F.col("owner").alias("conv_id"), "extent", "n_convs", "least", "chars", zero.alias("brought"), zero.alias("n_leaves"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "chars", "brought", "n_leaves")] + [F.min("least").alias("least")]
    up = Window.partitionBy("conv_id").orderBy(F.col("extent").desc())
    done = None
    for batch in range(tree.batches, 0, -1):
        here = owners.where(F.col("batch") == batch)
        at = coming.join(here.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id", "extent").agg(*sums)
        full = tree.nodes.join(here.select("conv_id"), "conv_id", "left_semi").join(at, ["conv_id", "extent"], "left")
        full = full.select("conv_id", "above", "extent", *[F.sum(F.coalesce(c, zero)).over(up).alias(c) for c in ("n_convs", "chars", "brought", "n_leaves")], F.min("least").over(up).alias("least"))
        full = durable(full, f"prefixes-batch{batch}")
        top = full.join(here, "conv_id").where("above = at").select(F.col("up").alias("conv_id"), F.col("at").alias("extent"), "n_convs", "least", "chars", (full["brought"] + here["brought"]).alias("brought"), (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"))
        coming = durable(coming.unionByName(top), f"prefixes-coming{batch}")
        done = full if done is None else done.unionByName(full)
    root = coming.where("conv_id is null").agg(*sums, F.count("*").alias("_any")).where("_any > 0").drop("_any")
    root = root.crossJoin(hung.where("conv_id is null").agg(F.coalesce(F.sum("hanging"), zero).alias("n_children")))  # one row each
    if done is None:
        return tree.nodes.where("false"), root
    n_children = F.coalesce("hanging", zero) + (F.col("extent") < F.col("n")).cast("long")
    return done.join(hung, ["conv_id", "extent"], "left").join(owners.select("conv_id", "n", "leaf", "up", "at"), "conv_id").withColumn("n_children", n_children), root


def shared(conversations: DataFrame) -> DataFrame:
    """Every node of the rebuilt conversations' prefix tree: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt(conversations)
    paths = durable(prefixes(turns, "d", {"chars": F.col("chars")}).select("conv_id", "d", "fa", "fb", "chars"), "prefixes-paths")
    tree = build(paths, lengths)
    total = lengths.join(paths.withColumnRenamed("d", "n"), ["conv_id", "n"], "left").select("conv_id", F.coalesce("chars", F.lit(0).cast("long")).alias("total"))
    located = durable(tree.members.join(tree.ends, "rep").select("conv_id", "rep", "owner", F.col("n").alias("extent")), "prefixes-ends")
    size = total.withColumnRenamed("conv_id", "rep")
    values = located.groupBy("rep", "owner", "extent").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least")).join(size, "rep")
    values = durable(values.select("owner", "extent", "n_convs", "least", (F.col("n_convs") * F.col("total")).alias("chars")), "prefixes-values")
    before = paths.select("conv_id", F.col("d").alias("at"), F.col("chars").alias("before"))
    own = tree.owners.join(total, "conv_id").join(before, ["conv_id", "at"], "left").select("conv_id", "total", (F.col("total") - F.coalesce("before", F.lit(0))).alias("brought"))
    own = durable(own, "prefixes-brought")
    nodes, root = gathered(tree, (values, own.select("conv_id", "brought")))
    digests = digests_of_ends(located.select("owner", "extent", F.col("conv_id").alias("id")))
    root = root.select(
        F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"), (F.col("chars") - F.col("brought")).alias("saved_tokens"), F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("extent"),
    )
    if tree.batches == 0:
        out = root
    else:
        nodes = durable(nodes, "prefixes-nodes")
        least = nodes.select(F.when(F.col("n_convs") > 0, F.col("conv_id")).alias("p"), F.col("extent").alias("pe"), F.col("least").alias("parent_least"))
        above = nodes.withColumn("p", F.when(F.col("above") > F.col("at"), F.col("conv_id")).otherwise(F.col("up"))).withColumn("pe", F.col("above"))
        above = above.join(least, ["p", "pe"], "left").join(own.select("conv_id", "total"), "conv_id")
        top = root.select(F.col("conv_id").alias("root_least"))
        above = above.crossJoin(F.broadcast(top)).withColumn("parent_least", F.coalesce("parent_least", "root_least"))  # one row
        long = above.withColumn("depth", F.explode(F.sequence(F.col("above") + 1, F.col("extent"))))
        before = paths.select("conv_id", (F.col("d") + 1).alias("depth"), F.col("chars").alias("before"))
        long = long.join(before, ["conv_id", "depth"], "left").withColumn("before", F.coalesce("before", F.lit(0).cast("long")))
        last = F.col("depth") == F.col("extent")
        saved = F.col("chars") - F.col("brought") - F.col("total") - (F.col("n_convs") - 1) * F.col("before")
        out = long.select(
            F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("above") + 1, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), saved.alias("saved_tokens"), F.when(last, F.col("conv_id")).alias("owner"), F.when(last, F.col("extent")).alias("extent"),
        ).unionByName(root)
    same = (F.col("o.extent") == F.col("e.extent")) & F.col("o.owner").eqNullSafe(F.col("e.owner"))
    out = out.alias("o").join(digests.alias("e"), same, "left")
    return out.select("o.conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
