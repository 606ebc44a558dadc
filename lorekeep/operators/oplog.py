"""The operation log: validation, gates, provenance, versions of slots, the change spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_baseline
from ..sources.shared import durable

#: Fixed values of the record format.
OP_TYPES = ("add", "update", "close", "supersede", "reinforce", "invalidate", "noop")
MEMORY_KINDS = ("event", "state", "relation", "knowledge", "belief", "intention", "commitment", "ownership", "world_delta")
STATUSES = ("active", "closed", "superseded", "invalid")
IMPORTANCES = ("low", "medium", "high", "critical")
EPISTEMICS = ("fact", "observed", "belief", "rumor", "inference", "plan", "uncertain")
#: How hard a change of each kind is to take back.
IRREVERSIBILITY = {"commitment": 5, "ownership": 4, "relation": 4, "world_delta": 4, "knowledge": 3, "belief": 2, "state": 2, "intention": 2, "event": 1}
#: Phrases that announce a change.
CHANGE_PHRASES = (
    "搬到", "搬离", "迁居", "改为", "改成", "转为", "变为", "不再", "失去", "获得", "新增", "新建",
    "首次", "解除", "终止", "签订", "离开", "改修", "转专业", "开始知道", "得知", "确认了", "发现了",
    "卖掉", "卖出", "转让", "搬走", "去世", "离职", "辞职", "入学", "毕业", "结婚", "离婚", "破产",
    "损坏", "毁掉", "放弃", "改名", "换了", "停止", "恢复",
    "moved to", "moved from", "changed to", "switched to", "no longer", "lost ", "gained ", "newly ",
    "learned that", "discovered that", "confirmed that", "terminated", "signed ", "sold ", "quit ", "graduated",
)
DYNAMIC_SLOT = r"(?:\.location\.current|\.state\.(?:hunger|fatigue|pain|injury|mp|cooldown|temperature|mood)|\.travel\.|\.intention\.)"


def validate(op: Column) -> Column:
    """The errors of an operation struct, as an array."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = lambda field, names: F.when(op[field].isNotNull() & ~op[field].isin(*names), F.lit(f"invalid {field}"))
    long_list = lambda field: F.when(F.size(op[field]) > 20, F.lit(f"too many {field}"))
    checks = [
        F.when(op["op"].isNull() | ~op["op"].isin(*OP_TYPES), "invalid op"),
        bad("kind", MEMORY_KINDS), bad("status", STATUSES), bad("importance", IMPORTANCES), bad("epistemic", EPISTEMICS),
        F.when((op["op"] == "add") & blank(op["kind"]), "add needs kind"),
        F.when((op["op"] == "add") & blank(op["text"]), "add needs text"),
        F.when(op["op"].isin("update", "close", "supersede", "reinforce", "invalidate") & blank(op["target_id"]) & blank(op["target_slot"]), "needs target_id or target_slot"),
        F.when((op["op"] == "noop") & blank(op["reason"]), "noop needs reason"),
        F.when(F.length(op["text"]) > 1200, "text too long"), F.when(F.length(op["scope"]) > 200, "scope too long"),
        long_list("entities"), long_list("topics"), long_list("known_by"),
    ]
    return F.array_compact(F.array(*checks))


def has_change_signal(text: Column, phrases: tuple[str, ...] = CHANGE_PHRASES) -> Column:
    """The text announces a change."""
    plain = normalize_baseline(text)  # phrases are compared in that form too, so without blanks at their ends
    return F.greatest(*[F.contains(plain, F.lit(p.strip())) for p in phrases], F.lit(False))


def gate_eligible(op: Column, kind: Column, text: Column, slot: Column, indexable: Column) -> Column:
    """Additions that may be duplicates of the baseline."""
    dynamic = (kind == "state") & (~F.coalesce(indexable, F.lit(True)) | F.coalesce(F.lower(slot).rlike(DYNAMIC_SLOT), F.lit(False)))
    return (op == "add") & kind.isin("state", "relation", "commitment", "ownership") & ~has_change_signal(text) & ~dynamic


def irreversibility(kind: Column, explicit: Column | None = None) -> Column:
    """Rank of a kind, an explicit value first."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IRREVERSIBILITY.items() for x in kv]), kind), F.lit(1))
    return rank if explicit is None else F.coalesce(explicit, rank)


def is_never_drop(status: Column, text: Column, importance: Column, kind: Column) -> Column:
    """Active, with text, and critical or hard to take back."""
    return (status == "active") & (F.trim(text) != "") & ((importance == "critical") | (irreversibility(kind) >= 4))


def provenance_channel(explicit: Column, text: Column, epistemic: Column, kind: Column) -> Column:
    """How the holder came to know it: told, inferred, saw or heard."""
    low = F.lower(text)
    told = low.rlike(r"\b(told|said|explained|informed|confided|according to)\b")
    inferred = low.rlike(r"\b(inferred|guess(ed)?|suspects?|deduced|concluded)\b") | epistemic.isin("inference", "belief", "uncertain")
    return F.coalesce(F.when(explicit.isin("saw", "heard", "told", "inferred"), explicit), F.when(told, "told").when(inferred, "inferred").when(kind.isin("event", "state", "world_delta"), "saw").otherwise("heard"))


def is_indexable(indexable: Column, status: Column, text: Column, evidenced: Column, importance: Column, kind: Column) -> Column:
    """The evidence gate before a memory may be found by search."""
    weak = ~evidenced & F.coalesce(importance, F.lit("medium")).isin("low", "medium") & ~kind.isin("state", "intention")
    return F.coalesce(indexable, F.lit(False)) & status.isin("active", "closed") & (F.trim(F.coalesce(text, F.lit(""))) != "") & ~weak


def slot_log(ops: DataFrame) -> DataFrame:
    """Each operation with whether its slot has an owner, the owner's text, and what the operation does.

    ops: (conv_id, msg, op, slot, kind, importance, text), one per message; for logs whose updates change neither slot,
    status nor text. act: start (a new owner), end, confirm (an equal addition), none.
    """
    by = Window.partitionBy("conv_id", "slot").orderBy("msg")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    owned = F.coalesce(F.last(F.when(F.col("op") == "add", True).when(F.col("op").isin("close", "invalidate"), False), ignorenulls=True).over(before), F.lit(False))
    rows = ops.withColumn("owned", owned)
    value = F.when((F.col("op") == "add") | (F.col("op") == "supersede") & F.col("owned"), F.struct("kind", "text"))
    rows = rows.withColumn("owner", F.when(F.col("owned"), F.last(value, ignorenulls=True).over(before)))
    same = F.col("owned") & (F.col("owner.kind") == F.col("kind")) & (F.col("owner.text") == F.col("text"))
    act = (
        F.when((F.col("op") == "add") & same, "confirm")
        .when((F.col("op") == "add") | (F.col("op") == "supersede") & F.col("owned"), "start")
        .when(F.col("op").isin("close", "invalidate") & F.col("owned"), "end")
        .when(F.col("op").isin("update", "reinforce") & F.col("owned"), F.col("op"))
        .otherwise("none")
    )
    return rows.withColumn("act", act)


def slot_versions(ops: DataFrame) -> DataFrame:
    """One row per value of a slot: its interval, status, successor, and how often it was reinforced and confirmed.

    A value ends with the next start or end. Its status then: closed by an end; superseded by a supersede or by a new
    value of kind belief or knowledge; else closed. An event is closed from the start and owns no slot.
    """
    by = Window.partitionBy("conv_id", "slot").orderBy("msg")
    log = slot_log(ops).where("act <> 'none'")
    log = log.withColumn("v", F.sum((F.col("act") == "start").cast("long")).over(by))
    edge = F.lead(F.struct("msg", "act", "op", "kind")).over(by)
    edges = log.where("act in ('start', 'end')").withColumn("next", edge).where("act = 'start'")
    counts = log.groupBy("conv_id", "slot", "v").agg(F.count_if(F.col("act") == "reinforce").alias("reinforcement"), F.count_if(F.col("act") == "confirm").alias("confirmed"))
    n = F.col("next")
    status = F.when(n.isNull(), "active").when(n["act"] == "end", "closed").when((n["op"] == "supersede") | n["kind"].isin("belief", "knowledge"), "superseded").otherwise("closed")
    out = edges.select("conv_id", "slot", "v", "kind", "importance", "text", F.col("msg").alias("valid_from"), n["msg"].alias("valid_until"), F.when(n["act"] == "start", n["msg"]).alias("superseded_by"), status.alias("status"))
    return out.join(counts, ["conv_id", "slot", "v"]).withColumnRenamed("v", "version")


def change_spine(ops: DataFrame, keep: int = 300) -> DataFrame:
    """One node per applied operation, in order, with a mark on the first of its slot; the newest keep of each conversation."""
    log = slot_log(ops).where("act <> 'none'")
    by = Window.partitionBy("conv_id").orderBy("msg")
    first = F.row_number().over(Window.partitionBy("conv_id", "slot").orderBy("msg")) == 1
    rows = log.withColumns({"seq": F.row_number().over(by), "first_in_slot": first, "age": F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("msg")))})
    return rows.where(F.col("age") <= keep).select("conv_id", "msg", "seq", "op", "slot", "kind", "first_in_slot")


def spine_ledger(ops: DataFrame) -> DataFrame:
    """Per conversation and message: operations, created values, superseded ones and slots."""
    log = slot_log(ops).where("act <> 'none'")
    return log.groupBy("conv_id", "msg").agg(F.count(F.lit(1)).alias("n_ops"), F.count_if(F.col("act") == "start").alias("created"), F.count_if((F.col("act") == "start") & F.col("owned")).alias("supersedes"), F.count_distinct("slot").alias("slots"))


def fact_history(versions: DataFrame) -> DataFrame:
    """All values of a slot in order of creation, as one row."""
    entry = F.struct("valid_from", F.concat_ws("=", "text", "status").alias("e"))
    return versions.groupBy("conv_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), " > ").alias("history"))


def spine_trace(versions: DataFrame, seeds: DataFrame, rounds: int = 4) -> DataFrame:
    """From seed values (conv_id, slot, valid_from) along supersede links, both ways, up to so many rounds."""
    versions = durable(versions, "trace-versions")
    edge = versions.where("superseded_by is not null").select("conv_id", "slot", F.col("valid_from").alias("a"), F.col("superseded_by").alias("b"))
    edge = edge.unionByName(edge.select("conv_id", "slot", F.col("b").alias("a"), F.col("a").alias("b")))
    reached = seeds.select("conv_id", "slot", "valid_from", F.lit(0).alias("hops"))
    frontier = reached
    for k in range(1, rounds + 1):
        met = frontier.select("conv_id", "slot", F.col("valid_from").alias("a")).join(edge, ["conv_id", "slot", "a"]).select("conv_id", "slot", F.col("b").alias("valid_from"), F.lit(k).alias("hops")).distinct()
        reached = durable(reached.unionByName(met).groupBy("conv_id", "slot", "valid_from").agg(F.min("hops").alias("hops")), f"trace-{k}")
        frontier = reached.where(F.col("hops") == k)
    return reached
