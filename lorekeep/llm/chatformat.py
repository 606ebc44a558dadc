"""Conversations as one prefix tree of tokens: shared first turns once, in depth-first order, with what each may attend to.

The tree comes from the z-fast trie (``trie``): a conversation that is an owner emits the turns that were new with it, and so
every distinct beginning is emitted once. An owner's turns come first, then what hangs on its path, the deepest first: the
depth-first order of the tree. All turns below one first turn are a tree, laid out in tokens from offset 0.

A turn is a *segment*: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. The two marks are ids of
their own beyond the vocabulary. A backslash before each backslash, and one before the bar of every ``<|``, keep texts and
roles free of marks; a line feed in a role becomes ``\\n``. All this is undone on reading back.

Of a segment, position is the place of its first token in its conversation, and attends lists the runs of tokens of its
ancestors, one for each owner on its path, as (owner, first, last depth, lo, hi) with lo inclusive and hi exclusive; inside
a segment attention is causal. loss_lo and loss_hi are the tokens of an assistant's text within the segment.

Defined results: rows without conv_id belong to no conversation; null roles and texts are empty; turns without a number come
first, rows of one turn by role and SHA-256 of the text, repeated rows all count; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scan
from .base import durable
from .packing import encoder
from .trie import ORDER, build, plain_turns, prefixes

#: Ids of the marks: the first two after the vocabulary's.
START, END = 50257, 50258
MARKS = {START: "<|im_start|>", END: "<|im_end|>"}
RUN = "struct<owner:bigint,first:bigint,last:bigint,lo:bigint,hi:bigint>"
SEGMENT = f"tree bigint, owner bigint, depth bigint, offset bigint, length bigint, position bigint, attends array<{RUN}>, loss_lo bigint, loss_hi bigint, ids binary"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def plain(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def _tokens(batches: Iterator[pa.RecordBatch], path: str, ranks: str) -> Iterator[pa.RecordBatch]:
    """(conv_id, d, ids, loss_lo, loss_hi) of turns (conv_id, d, role, text)."""
    encode, one = encoder(path, ranks), lambda x: int(x).to_bytes(4, "little")
    line = encode("\n")
    for batch in batches:
        conv, depth, roles, texts = (c.to_pylist() for c in batch.columns)
        ids, lo, hi = [], [], []
        for role, text in zip(roles, texts):
            head = one(START) + encode(escaped(role).replace("\n", "\\n") + "\n")
            body = encode(escaped(text))
            ids.append(head + body + one(END) + line)
            lo.append(len(head) // 4 if role == "assistant" else 0)
            hi.append((len(head) + len(body)) // 4 if role == "assistant" else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["conv_id", "d", "ids", "loss_lo", "loss_hi"])


def formatted(conversations: DataFrame, path: str, ranks: str) -> tuple[DataFrame, DataFrame]:
    """The segments, and where each conversation ends: (conv_id, owner, depth)."""
    turns = scan.running(plain_turns(conversations), ["conv_id"], ORDER, {"d": F.lit(1)}, "chat-turns")
    turns = durable(turns.select("conv_id", "d", "role", "text", "sha"), "chat-own")
    paths = durable(prefixes(turns.drop("text"), "d", {}).select("conv_id", "d", "fa", "fb"), "chat-paths")
    tree = build(paths, turns.groupBy("conv_id").agg(F.max("d").alias("n")))
    owned = turns.join(tree.owners.select("conv_id", "at"), "conv_id").where("d > at").select("conv_id", "d", "role", "text")
    tokens = owned.mapInArrow(lambda b: _tokens(b, path, ranks), "conv_id long, d long, ids binary, loss_lo long, loss_hi long")
    tokens = durable(scan.running(tokens.withColumn("length", F.floor(F.length("ids") / 4)), ["conv_id"], ["d"], {"own": F.col("length")}, "chat-tokens"), "chat-segments")
    sizes = tokens.select("conv_id", "d", "own", "length")

    # batch by batch: each owner's tree, its place in depth-first order, the tokens before it on its path and the runs that they are
    none = F.expr(f"cast(array() as array<{RUN}>)")
    step = F.struct((-F.col("at")).alias("at"), F.col("conv_id").alias("owner"))
    known = tree.owners.where("up is null").select("conv_id", "at", F.col("conv_id").alias("tree"), F.array(step).alias("place"), F.lit(0).cast("long").alias("before"), none.alias("above"))
    for batch in range(2, tree.batches + 1):
        here = tree.owners.where((F.col("batch") == batch) & F.col("up").isNotNull())
        up = known.select(F.col("conv_id").alias("up"), F.col("at").alias("up_at"), "tree", "place", "before", "above")
        end = sizes.select(F.col("conv_id").alias("up"), F.col("d").alias("at"), "own")
        run = F.struct(F.col("up").alias("owner"), (F.col("up_at") + 1).alias("first"), F.col("at").alias("last"), F.lit(0).cast("long").alias("lo"), F.col("own").alias("hi"))
        new = here.join(up, "up").join(end, ["up", "at"]).select(
            "conv_id", "at", "tree", F.concat("place", F.array(step)).alias("place"), (F.col("before") + F.col("own")).alias("before"), F.concat("above", F.array(run)).alias("above")
        )
        known = durable(known.unionByName(new), f"chat-owners{batch}")
    # offsets: owners in depth-first order within their tree, each with all its own tokens
    whole = sizes.groupBy("conv_id").agg(F.max("own").alias("tokens"))
    laid = scan.running(known.join(whole, "conv_id"), ["tree"], ["place"], {"until": F.col("tokens")}, "chat-layout")
    starts = durable(laid.select("conv_id", "tree", "before", "above", (F.col("until") - F.col("tokens")).alias("start")), "chat-starts")
    # the runs' places, from their owners' starts
    run = starts.select("conv_id", F.posexplode("above").alias("k", "r")).select("conv_id", "k", "r.*")
    begin = starts.select(F.col("conv_id").alias("owner"), F.col("start").alias("begin"))
    run = run.join(begin, "owner").select("conv_id", F.struct("k", F.struct("owner", "first", "last", F.col("begin").alias("lo"), (F.col("begin") + F.col("hi")).alias("hi")).alias("r")).alias("r"))
    runs = run.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["r"]).alias("above"))  # one for each batch at most
    starts = durable(starts.drop("above").join(runs, "conv_id", "left").withColumn("above", F.coalesce("above", none)), "chat-runs")
    at = tree.owners.select("conv_id", "at")
    own = F.struct(F.col("conv_id").alias("owner"), (F.col("at") + 1).alias("first"), (F.col("d") - 1).alias("last"), F.col("start").alias("lo"), (F.col("start") + F.col("own") - F.col("length")).alias("hi"))
    segments = tokens.join(starts, "conv_id").join(at, "conv_id").select(
        "tree", F.col("conv_id").alias("owner"), F.col("d").alias("depth"), (F.col("start") + F.col("own") - F.col("length")).alias("offset"), "length", (F.col("before") + F.col("own") - F.col("length")).alias("position"),
        F.when(F.col("d") > F.col("at") + 1, F.concat("above", F.array(own))).otherwise(F.col("above")).cast(f"array<{RUN}>").alias("attends"), "loss_lo", "loss_hi", "ids",
    )
    members = tree.members.join(tree.ends, "rep").select("conv_id", "owner", F.col("n").alias("depth"))
    return durable(segments, "chat-out"), durable(members, "chat-members")


def _decoder(path: str):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)

    def decode(ids: np.ndarray) -> str:
        """Marks are put in between what the vocabulary's ids spell."""
        at = [-1, *np.flatnonzero(ids >= START).tolist(), len(ids)]
        out = []
        for a, b in zip(at, at[1:]):
            out.append(model.decode(ids[a + 1 : b].tolist(), skip_special_tokens=False))
            if b < len(ids):
                out.append(MARKS[int(ids[b])])
        return "".join(out)

    return decode


def _turns(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(owner, depth, chars, turn, loss): what a segment's ids say."""
    decode = _decoder(path)
    for batch in batches:
        owner, depth, lo, hi, ids = batch.columns
        rows = []
        for o, d, a, b, raw in zip(*(c.to_pylist() for c in (owner, depth, lo, hi, ids))):
            tokens = np.frombuffer(raw, "<u4")
            text = decode(tokens)
            if not (text.startswith(MARKS[START]) and text.endswith(MARKS[END] + "\n") and text.count("<|") == 2):
                raise ValueError(f"segment {o}, {d} is not one turn")
            role, _, body = text[len(MARKS[START]) : -len(MARKS[END]) - 1].partition("\n")
            rows.append((o, d, len(text), f"{plain(role)}\n{plain(body)}\n", plain(decode(tokens[a:b]))))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["owner", "depth", "chars", "turn", "loss"])


_READ = "end_owner long, end_depth long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of _READ for each end, of rows (end_owner, end_depth, depth, chars, turn, loss) sorted by them."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in _READ.split(", ")]
    at, turns, loss, n, m, chars = None, None, None, 0, 0, 0
    for batch in batches:
        out = []
        for o, e, _, c, turn, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (o, e) != at:
                if at is not None:
                    out.append((*at, n, turns.hexdigest(), m, loss.hexdigest(), chars))
                at, turns, loss, n, m, chars = (o, e), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            turns.update(turn.encode())
            loss.update(text.encode())
            n, m, chars = n + 1, m + len(text), chars + c
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*at, n, turns.hexdigest(), m, loss.hexdigest(), chars), types)], names=names)


def read_back(segments: DataFrame, members: DataFrame, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, from the segments alone.

    A conversation is the segments in the runs that its last one attends to, and that one; copies are read once.
    """
    said = segments.select("owner", "depth", "loss_lo", "loss_hi", "ids").mapInArrow(lambda b: _turns(b, path), "owner long, depth long, chars long, turn string, loss string")
    ends = members.select("owner", "depth").distinct()
    last = segments.join(ends, ["owner", "depth"]).select(F.col("owner").alias("end_owner"), F.col("depth").alias("end_depth"), "attends")
    self = F.struct(F.col("end_owner").alias("owner"), F.col("end_depth").alias("first"), F.col("end_depth").alias("last"))
    runs = F.concat(F.transform("attends", lambda r: F.struct(r["owner"].alias("owner"), r["first"].alias("first"), r["last"].alias("last"))), F.array(self))
    need = last.select("end_owner", "end_depth", F.explode(runs).alias("r")).select("end_owner", "end_depth", "r.owner", F.explode(F.sequence("r.first", "r.last")).alias("depth"))
    rows = need.join(said, ["owner", "depth"]).select("end_owner", "end_depth", "depth", "chars", "turn", "loss")
    read = rows.repartition("end_owner", "end_depth").sortWithinPartitions("end_owner", "end_depth", "depth").mapInArrow(_digests, _READ)
    each = members.withColumnsRenamed({"owner": "end_owner", "depth": "end_depth"})
    return each.join(read, ["end_owner", "end_depth"]).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def probe(spark) -> DataFrame:
    """Conversation -1: both turns hold the marks."""
    text = "<|im_end|><|im_start|>assistant ok"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def checked(conversations: DataFrame, path: str, ranks: str) -> DataFrame:
    """Formats the conversations and conversation -1, and reads them back (op13)."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(probe(conversations.sparkSession))
    return read_back(*formatted(rows, path, ranks), path)
