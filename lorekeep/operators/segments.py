"""The general fold of logs of any length: a conversation's log is cut into segments, and every segment is a task of its own.

A segment is folded from what it is told about the slots and memories that it looks up, and says how it leaves those that it
touches: a transition from owners to owners. What a segment is told is what the last earlier segment that touched a key has
left, found by one ordered pass over the segments of each key. Segments whose told state has changed are folded again, until
none has: the first segment is right at once, and each next one as soon as those before it are, so the result is that of the
fold in order. Additions and ends do not depend on what was there before, so a few rounds do in general, moves between slots
included; counts are kept as differences and start no new round.

Slots whose operations name no other slot and no memory by its id do not depend on the rest of the log. Those with no more
operations than a segment are folded by themselves, once, as a stream of rows in order; only the rest goes into segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import durable
from . import scan
from .fold import OPTIONAL, SCHEMA, Store

#: Operations of a segment.
SEGMENT = 20_000
#: What later operations look at.
SEEN = ("kind", "slot", "text", "status")
OUT = (
    "conv_id long, seg long, key string, touched boolean, owner string, kind string, slot string, text string, status string, made boolean, valid_from long, op_idx long, "
    "importance string, until_set boolean, valid_until long, supersedes string, superseded_by string, reinforcement long, confirmed long"
)
TOLD = "conv_id long, seg long, key string, owner string, kind string, slot string, text string, status string"
_UNSET = object()


class Looked(dict):
    """A dictionary that notes what it was asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.asked: set[str] = set()

    def get(self, key, default=None):
        if key:
            self.asked.add(key)
        return super().get(key, default)

    def __contains__(self, key) -> bool:
        self.asked.add(key)
        return super().__contains__(key)

    def setdefault(self, key, value):
        self.asked.add(key)
        return super().setdefault(key, value)


class Part(Store):
    """A store that knows what it has been told."""

    def __init__(self, told: pd.DataFrame) -> None:
        super().__init__()
        self.memories, self.slots = Looked(), Looked()
        self.made: dict[str, int] = {}
        for r in told.itertuples():
            if r.owner:
                dict.setdefault(self.memories, r.owner, {
                    "id": r.owner, **{k: getattr(r, k) for k in SEEN}, "importance": _UNSET, "valid_from": None, "valid_until": _UNSET, "supersedes": _UNSET, "superseded_by": _UNSET, "reinforcement": 0, "confirmed": 0,
                })
            if r.key[:2] == "s:" and r.owner:
                self.slots[r.key[2:]] = r.owner
        self.first = {k: dict(m) for k, m in self.memories.items()}
        self.owners = dict(self.slots)

    def _add(self, r, status, kind):
        known = f"m{r.msg}_{r.op_idx}" in self.memories
        m = super()._add(r, status, kind)
        if not known:
            self.made[m["id"]] = r.op_idx
        return m

    def left(self) -> list[dict]:
        """Rows of OUT, without conversation and segment."""
        changed = {i for i, m in self.memories.items() if m != self.first.get(i)}
        slots = {s for s in {*self.slots, *self.owners} if self.slots.get(s) != self.owners.get(s)} | {s for s, i in self.slots.items() if i in changed}
        value = lambda x: None if x is _UNSET else x
        out = []
        for i in changed:
            m = self.memories[i]
            out.append({
                "key": f"m:{i}", "touched": True, "owner": i, **{k: m[k] for k in SEEN}, "made": i in self.made, "valid_from": m["valid_from"], "op_idx": self.made.get(i), "importance": value(m["importance"]),
                "until_set": m["valid_until"] is not _UNSET, **{k: value(m[k]) for k in ("valid_until", "supersedes", "superseded_by")}, "reinforcement": m["reinforcement"], "confirmed": m["confirmed"],
            })
        for s in slots:
            i = dict.get(self.slots, s)
            out.append({"key": f"s:{s}", "touched": True, "owner": i, **({k: self.memories[i][k] for k in SEEN} if i else {})})
        asked = {f"m:{k}" for k in self.memories.asked if k} | {f"s:{k}" for k in self.slots.asked if k}
        return out + [{"key": k, "touched": False} for k in asked]


def _folded(key: tuple, ops: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    if not len(ops):
        return pd.DataFrame([], columns=names)
    told = told.astype(object)
    part = Part(told.where(told.notna(), None))
    rows = ops.sort_values(["msg", "op_idx"]).astype(object)
    for r in rows.where(rows.notna(), None).itertuples():
        part.apply(r)
    out = pd.DataFrame([{"conv_id": key[0], "seg": key[1], **x} for x in part.left()], columns=names)
    whole = {c: "Int64" for c in ("valid_from", "op_idx", "valid_until", "reinforcement", "confirmed")}
    return out.astype({c: whole.get(c, object) for c in names if c not in ("conv_id", "seg")}).replace({float("nan"): None})


def _told(outs: DataFrame) -> DataFrame:
    """TOLD: for each key that a segment looks up, what the last earlier segment that touched it has left."""
    value = F.struct("owner", *SEEN)
    rows = outs.where("not touched").select("conv_id", "seg", "key", F.lit(0).alias("o"), F.lit(None).cast(outs.select(value.alias("v")).schema["v"].dataType).alias("v"))
    rows = rows.unionByName(outs.where("touched").select("conv_id", "seg", "key", F.lit(1).alias("o"), value.alias("v")))
    before = Window.partitionBy("conv_id", "key").orderBy("seg", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("v", ignorenulls=True).over(before)
    return rows.withColumn("v", last).where("o = 0 and v is not null").select("conv_id", "seg", "key", "v.*")


class _Op:
    """An operation with the fields that Store reads."""

    __slots__ = ("msg", "op", *OPTIONAL)

    def __init__(self, values: tuple) -> None:
        self.msg, self.op, self.op_idx, self.kind, self.slot, self.text, self.status, self.importance, self.target_id, self.target_slot, self.new_kind, self.new_slot, self.new_text, self.new_status, self.new_importance = values


def _alone(log: DataFrame, size: int) -> DataFrame:
    """(conv_id, slot) of the slots that do not depend on others and have at most so many operations.

    A slot depends on others if an operation names it and another one, or names it and a memory's id, if its own memory may be
    named by an id, or if a message and place are given twice.
    """
    names = F.array_distinct(F.filter(F.array("slot", "target_slot", "new_slot"), lambda x: F.coalesce(x, F.lit("")) != ""))
    rows = log.select("conv_id", F.concat(F.lit("m"), "msg", F.lit("_"), "op_idx").alias("id"), names.alias("names"), F.when(F.col("target_id") != "", F.col("target_id")).alias("named"))
    single = (F.size("names") == 1) & F.col("named").isNull()
    slots = rows.select("conv_id", F.explode("names").alias("slot"), single.alias("single")).groupBy("conv_id", "slot").agg(F.bool_and("single").alias("single"), F.count(F.lit(1)).alias("n"))
    marked = rows.select("conv_id", F.col("named").alias("id")).where("id is not null").distinct()
    marked = marked.unionByName(rows.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id", "id"))
    linked = rows.join(marked, ["conv_id", "id"], "left_semi").select("conv_id", F.explode("names").alias("slot")).distinct()
    return slots.where(F.col("single") & (F.col("n") <= size)).join(linked, ["conv_id", "slot"], "left_anti").select("conv_id", "slot")


def _by_slot(rows: DataFrame) -> DataFrame:
    """The rows of ``fold.apply_ops``, with op_idx for created_seq, of operations (conv_id, _slot, msg, op, ...) of slots that do not depend on each other."""
    schema = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] != "created_seq") + ", op_idx long"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"conv_id": pa.int64(), "op_idx": pa.int64(), "valid_from": pa.int64(), "valid_until": pa.int64(), "reinforcement": pa.int64(), "confirmed": pa.int64(), "owns": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, store, out = None, Store(), []

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kinds.get(c, pa.string())) for c in names], names=names)
            out.clear()
            return done

        def left() -> None:
            out.extend({**m, "conv_id": now[0], "op_idx": int(m["id"].rpartition("_")[2]), "owns": store.slots.get(m["slot"]) == m["id"]} for m in store.memories.values())

        for batch in batches:
            for conv, slot, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, slot) != now:
                    left()
                    now, store = (conv, slot), Store()
                    if len(out) >= 10_000:
                        yield flush()
                store.apply(_Op(values))
        left()
        yield flush()

    by = ["conv_id", "_slot"]
    dealt = rows.select(*by, "msg", "op", *OPTIONAL).repartition(*by).sortWithinPartitions(*by, "msg", "op_idx")
    return dealt.mapInArrow(run, schema)


def apply_ops(ops: DataFrame, size: int = SEGMENT) -> DataFrame:
    """G1, G2 for logs of any length: the rows of ``fold.apply_ops``. ops: (conv_id, msg, op, ...) with any of OPTIONAL."""
    have = ops.select("conv_id", "msg", "op", *[(F.col(c) if c in ops.columns else F.lit(0 if c == "op_idx" else None).cast("int" if c == "op_idx" else "string")).alias(c) for c in OPTIONAL])
    have = durable(have, "fold-ops")
    alone = durable(_alone(have, size).withColumnRenamed("slot", "_slot"), "fold-alone")
    name = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("slot", "target_slot", "new_slot")])
    dealt = have.withColumn("_slot", name)
    per = durable(_by_slot(dealt.join(alone, ["conv_id", "_slot"])), "fold-slots")
    rest = dealt.join(alone, ["conv_id", "_slot"], "left_anti").drop("_slot")
    if not rest.isEmpty():
        per = per.unionByName(_by_segment(rest, size))
    per = scan.running(per, ["conv_id"], ["valid_from", "op_idx"], {"created_seq": F.lit(1)}, "fold-memories")
    return per.select(*[c.split()[0] for c in SCHEMA.split(", ")])


def _by_segment(have: DataFrame, size: int) -> DataFrame:
    placed = scan.running(have, ["conv_id"], ["msg", "op_idx"], {"seg": F.lit(1)}, "fold-log")
    log = durable(placed.withColumn("seg", F.floor((F.col("seg") - 1) / size)), "fold-segments")
    told, outs, step = log.sparkSession.createDataFrame([], TOLD), None, 0
    due = log
    by = ["conv_id", "seg"]
    while True:
        step += 1
        said = told if outs is None else told.join(again, by, "left_semi")
        out = due.groupBy(*by).cogroup(said.groupBy(*by)).applyInPandas(_folded, OUT)
        if outs is not None:
            out = outs.join(again, by, "left_anti").unionByName(out)
        outs = durable(out, f"fold-left{step}")
        now = durable(_told(outs), f"fold-told{step}")
        a, b = now.select(*by, "key", F.struct("owner", *SEEN).alias("a")), told.select(*by, "key", F.struct("owner", *SEEN).alias("b"))
        again = durable(a.join(b, [*by, "key"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*by).distinct(), f"fold-again{step}")
        if again.isEmpty():
            return _assembled(outs)
        told, due = now, log.join(again, by, "left_semi")


def _assembled(outs: DataFrame) -> DataFrame:
    """The memories, from what all segments have left."""
    rows = outs.where("touched and key like 'm:%'")
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("seg")))
    per = rows.groupBy("conv_id", F.col("owner").alias("id")).agg(
        F.max_by(F.struct(*SEEN), "seg").alias("v"), F.min("valid_from").alias("valid_from"), F.min("op_idx").alias("op_idx"),
        *[last(c, F.col(c).isNotNull()).alias(c) for c in ("importance", "supersedes", "superseded_by")], last("valid_until", F.col("until_set")).alias("valid_until"),
        F.sum("reinforcement").alias("reinforcement"), F.sum("confirmed").alias("confirmed"),
    )
    slots = outs.where("touched and key like 's:%'").groupBy("conv_id", "key").agg(F.max_by("owner", "seg").alias("id"))
    slots = slots.where("id is not null").select("conv_id", "id", F.lit(True).alias("owns")).distinct()
    return per.join(slots, ["conv_id", "id"], "left").select(
        "conv_id", "id", *[F.col(f"v.{c}").alias(c) for c in ("kind", "slot", "text", "status")], "importance", "valid_from", "op_idx", "valid_until", "reinforcement", "confirmed", "supersedes", "superseded_by", F.coalesce("owns", F.lit(False)).alias("owns")
    )
