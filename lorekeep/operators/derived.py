"""What is derived from turns and records: digests, summary trees, scenes, folded turns, evidence, visibility, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.shared import durable
from . import scan


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def digest(records: DataFrame, turns: DataFrame, max_rows: int = 40, max_chars: int = 4000) -> DataFrame:
    """A row per standing turn with a summary; the newest rows within both caps. records: (conv_id, turn, event_summary)."""
    rows = records.where("trim(coalesce(event_summary, '')) <> ''").join(turns.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    down = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = rows.withColumns({"n": F.row_number().over(down), "chars": F.sum(F.length("event_summary")).over(down)})
    return rows.where((F.col("n") <= max_rows) & (F.col("chars") <= max_chars)).drop("n", "chars")


def covering(turns: DataFrame, level1: DataFrame) -> DataFrame:
    """Turns with the summary that covers them: an assistant row of its sources and the user rows right before it. level1: (conv_id, summary_id, turn)."""
    nxt = F.first(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(by_turn().rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = turns.withColumn("assistant_turn", nxt)
    return rows.join(level1.withColumnRenamed("turn", "assistant_turn"), ["conv_id", "assistant_turn"])


def fold_turns(turns: DataFrame, level1: DataFrame, keep_recent: int = 1) -> DataFrame:
    """Turns that summaries stand in for, except the newest assistant turn and the last so many covered ones."""
    newest = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("newest"))
    floors = covering(turns, level1)
    age = F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.desc("assistant_turn")))
    rows = floors.withColumn("age", age).join(newest, "conv_id")
    return rows.where((F.col("age") > keep_recent) & (F.col("assistant_turn") < F.col("newest"))).select("conv_id", "turn", "summary_id", F.xxhash64("text").alias("fingerprint"))


def unfold(folded: DataFrame, level1: DataFrame) -> DataFrame:
    """Folded turns whose summary is gone."""
    return folded.join(level1.select("conv_id", "summary_id").distinct(), ["conv_id", "summary_id"], "left_anti")


def unfold_all(folded: DataFrame, turns: DataFrame) -> DataFrame:
    """All folded turns that are still what they were when folded; moved or edited ones stay out."""
    now = turns.select("conv_id", "turn", F.xxhash64("text").alias("fingerprint"))
    return folded.join(now, ["conv_id", "turn", "fingerprint"], "left_semi")


def fold_status(folded: DataFrame, turns: DataFrame) -> DataFrame:
    """Per conversation folded turns, and those that moved or changed since."""
    now = turns.select("conv_id", "turn", F.xxhash64("text").alias("now"))
    both = folded.join(now, ["conv_id", "turn"], "left")
    return both.groupBy("conv_id").agg(F.count(F.lit(1)).alias("folded"), F.count_if(F.coalesce(F.col("now") != F.col("fingerprint"), F.lit(True))).alias("stale"))


def summary_tree(turns: DataFrame, l1: int = 10, l2: int = 3, l3: int = 3) -> DataFrame:
    """(conv_id, level, node, first_turn, last_turn, n_turns): full batches of l1 turns, l2 of those, l3 of those; 0 ends it.

    Every level's sources are turns, so a parent's input is its descendants' turns, never their texts.
    """
    seq = turns.withColumn("i", F.row_number().over(by_turn()) - 1)
    out, width = None, 1
    for level, n in enumerate((l1, l2, l3), 1):
        if not n:
            break
        width *= n
        rows = seq.withColumn("node", F.floor(F.col("i") / width)).groupBy("conv_id", "node").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n_turns"))
        rows = rows.where(F.col("n_turns") == width).withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return out.select("conv_id", "level", "node", "first_turn", "last_turn", "n_turns")


def summary_pack(summaries: DataFrame, budget: int, shares: tuple[float, ...] = (0.42, 0.26, 0.24)) -> DataFrame:
    """Newest first within each level's share of the budget; level 1 has the first share. summaries: (conv_id, level, node, text)."""
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("level"))
    used = F.sum(F.length("text")).over(Window.partitionBy("conv_id", "level").orderBy(F.desc("node")))
    return summaries.withColumn("used", used).where(F.col("used") <= budget * share)


def tree_history(versions: DataFrame, keep: int = 3) -> DataFrame:
    """The newest distinct states of a tree. versions: (conv_id, at, signature)."""
    changed = F.coalesce(F.lag("signature").over(Window.partitionBy("conv_id").orderBy("at")) != F.col("signature"), F.lit(True))
    rows = versions.withColumn("c", changed).where("c").drop("c")
    return rows.withColumn("age", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("at")))).where(F.col("age") <= keep)


#: Records of one conversation whose next cuts are found in one task.
STRETCH = 4096


def _next_cuts(rows: DataFrame, most: int) -> DataFrame:
    """(conv_id, pos, next): where a scene ends that would begin at pos; rows: (conv_id, pos from 1, location or null, branch).

    A scene has at most so many records, so its end follows from the next ones; the last of a stretch see the first of the next.
    """
    own = F.floor((F.col("pos") - 1) / STRETCH)
    late = (F.col("pos") - 1) % STRETCH < most
    seen = rows.withColumn("_s", F.explode(F.when(late & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    after = Window.partitionBy("conv_id", "_s").orderBy("pos").rowsBetween(0, most)
    seen = seen.withColumn("_a", F.collect_list(F.struct("location", "branch")).over(after)).where(F.col("_s") == own)
    x = F.col("_a")
    ends = lambda k: ~F.element_at(x, k + 1)["branch"].eqNullSafe(F.element_at(x, k)["branch"]) | F.coalesce(
        F.element_at(x, k + 1)["location"] != F.get(F.reverse(F.filter(F.slice(x, F.lit(1), k), lambda y: y["location"].isNotNull())), F.lit(0))["location"], F.lit(False)
    )
    first = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))), lambda k: (k < F.size(x)) & ((k >= most) | ends(k))), F.lit(0))
    return seen.select("conv_id", "pos", (F.col("pos") + first).alias("next"))


def scene_sessions(records: DataFrame, most: int = 6, chars: int = 1400) -> DataFrame:
    """Scenes of at most so many records, cut where the place or the branch changes. records: (conv_id, turn, location, branch, summary).

    The size cap restarts the count at every cut, so each record points to the cut that would follow if a scene began there, and
    the cuts are what is reached from the first record. Pointers are doubled: after k rounds 2^k cuts are known.
    """
    told = records.where("trim(coalesce(summary, '')) <> ''").select("conv_id", "turn", F.when(F.col("location") != "", F.col("location")).alias("location"), "branch", "summary")
    rows = durable(scan.running(told, ["conv_id"], ["turn"], {"pos": F.lit(1)}, "scenes-records"), "scenes-rows")
    jump = durable(_next_cuts(rows, most).where("next is not null"), "scenes-next0")
    reached = rows.where("pos = 1").select("conv_id", "pos")
    step = 0
    while not jump.isEmpty():
        step += 1
        reached = durable(reached.unionByName(reached.join(jump, ["conv_id", "pos"]).select("conv_id", F.col("next").alias("pos"))), f"scenes-reached{step}")
        on = jump.select("conv_id", F.col("pos").alias("next"), F.col("next").alias("far"))
        jump = durable(jump.join(on, ["conv_id", "next"]).select("conv_id", "pos", F.col("far").alias("next")), f"scenes-next{step}")
    marked = rows.join(reached.withColumn("cut", F.lit(1)), ["conv_id", "pos"], "left")
    scenes = scan.running(marked, ["conv_id"], ["pos"], {"scene": F.coalesce("cut", F.lit(0))}, "scenes-numbered").withColumn("scene", (F.col("scene") - 1).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "summary")))  # at most so many
    located = F.max_by(F.when(F.col("location").isNotNull(), F.col("location")), F.when(F.col("location").isNotNull(), F.col("turn")))
    return scenes.groupBy("conv_id", "scene").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), located.alias("location"), F.left(F.array_join(F.transform(parts, lambda x: x["summary"]), " "), F.lit(chars)).alias("outcome"))


def select_scenes(scenes: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """The latest scene, then those that share most tokens with the query, newest first. scenes: (conv_id, scene, tokens), queries: (conv_id, tokens)."""
    rows = scenes.join(queries.select("conv_id", F.col("tokens").alias("q")), "conv_id").withColumn("shared", F.size(F.array_intersect("tokens", "q")))
    latest = F.col("scene") == F.max("scene").over(Window.partitionBy("conv_id"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(latest.desc(), F.desc("shared"), F.desc("scene")))
    return rows.withColumn("rank", rank).where((F.col("rank") <= k) & ((F.col("rank") == 1) | (F.col("shared") > 0))).select("conv_id", "scene", "shared", "rank")


def expand_evidence(memories: DataFrame, turns: DataFrame, cold: DataFrame) -> DataFrame:
    """A memory's source: the live turn if its hash still fits, else the cold copy, else missing. memories: (conv_id, id, turn, source_hash)."""
    live = turns.select("conv_id", "turn", F.col("text").alias("live"))
    kept = cold.select("conv_id", F.col("turn"), F.col("text").alias("cold"))
    rows = memories.join(live, ["conv_id", "turn"], "left").join(kept, ["conv_id", "turn"], "left")
    fits = F.coalesce(F.xxhash64("live") == F.col("source_hash"), F.lit(False)) & F.col("live").isNotNull()
    source = F.when(fits, "live").when(F.col("cold").isNotNull(), "cold").otherwise("missing")
    return rows.select("conv_id", "id", source.alias("source"), F.when(fits, F.col("live")).otherwise(F.col("cold")).alias("text"), (~fits & F.col("live").isNotNull()).alias("stale"))


def evidence_excerpt(texts: DataFrame, most: int = 360) -> DataFrame:
    """H9: (id, excerpt): the sentence that names most needles, with the next and perhaps the one before. texts: (id, text, needles)."""
    pieces = F.filter(F.transform(F.split("text", r"(?<=[。！？!?；;\n.])"), lambda x: F.trim(x, F.lit(" \n\t"))), lambda x: x != "")
    rows = texts.withColumn("p", pieces).select("id", "p", "needles", F.posexplode("p").alias("i", "piece"))
    low = F.lower("piece")
    worth = F.aggregate(F.filter(F.transform("needles", lambda x: F.lower(x)), lambda x: F.length(x) >= 2), F.lit(0.0), lambda s, x: s + F.when(F.contains(low, x), F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.length(x) / 2))).otherwise(0.0))
    best = rows.withColumn("s", worth).where("s > 0").groupBy("id").agg(F.max_by(F.struct("i", "p"), F.struct("s", -F.col("i"))).alias("b"))
    p, i = F.col("b.p"), F.col("b.i")
    two = F.concat_ws(" ", F.get(p, i), F.get(p, i + 1))
    all_ = F.when((i > 0) & (F.length(two) < 0.6 * most), F.concat_ws(" ", F.get(p, i - 1), two)).otherwise(two)
    return best.select("id", F.when(F.length(all_) <= most, all_).otherwise(F.concat(F.trim(F.left(all_, F.lit(most - 1))), F.lit("…"))).alias("excerpt"))


def visible(known_by: Column, known_by_ids: Column, actor_names: Column, actor_ids: Column, secret: Column | None = None) -> Column:
    """Public without an audience (unless secret), else the actor is in it by id or by name in any spelling."""
    names = F.transform(F.coalesce(known_by, F.array().cast("array<string>")), lambda x: normalize(x))
    ids = F.coalesce(known_by_ids, F.array().cast("array<string>"))
    public = (F.size(names) == 0) & (F.size(ids) == 0)
    if secret is not None:
        public = public & ~F.coalesce(secret, F.lit(False))
    return public | F.arrays_overlap(ids, actor_ids) | F.arrays_overlap(names, F.transform(actor_names, lambda x: normalize(x)))


def redact_records(ops: DataFrame, shown: Column, most: int = 12) -> DataFrame:
    """(conv_id, msg, summary, hidden): a record with a hidden operation gets a summary of its visible texts only; with none it goes."""
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("op_idx", "text")))), lambda x: x["text"]))
    rows = ops.groupBy("conv_id", "msg").agg(texts.alias("t"), F.count_if(~shown).alias("hidden"), F.max("summary").alias("whole"))
    return rows.where((F.col("hidden") == 0) | (F.size("t") > 0)).select("conv_id", "msg", F.when(F.col("hidden") == 0, F.col("whole")).otherwise(F.array_join(F.slice("t", 1, most), "；")).alias("summary"), "hidden")


def safe_summaries(tree: DataFrame, unsafe: DataFrame) -> DataFrame:
    """Nodes none of whose turns is unsafe: tree (conv_id, level, node, first_turn, last_turn), unsafe (conv_id, turn)."""
    bad = tree.join(unsafe.select(F.col("conv_id").alias("c"), "turn"), (F.col("conv_id") == F.col("c")) & F.col("turn").between(F.col("first_turn"), F.col("last_turn")))
    return tree.join(bad.select("conv_id", "level", "node").distinct(), ["conv_id", "level", "node"], "left_anti")


def resolve_entities(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Names (row, world_id, name, discriminator) to entity ids: with a discriminator only that one; without, only if the name is unique; else a new id."""
    reg = registry.select("world_id", normalize(F.col("alias")).alias("key"), "discriminator", "entity_id").distinct()
    exact = reg.groupBy("world_id", "key", "discriminator").agg(F.min("entity_id").alias("exact"))
    unique = reg.groupBy("world_id", "key").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("only")).where("n = 1").drop("n")
    rows = names.withColumn("key", normalize(F.col("name"))).join(exact, ["world_id", "key", "discriminator"], "left").join(unique, ["world_id", "key"], "left")
    made = F.concat(F.lit("e"), F.hex(F.xxhash64("world_id", F.coalesce("discriminator", F.lit("")), "key")))
    known = F.when(F.col("discriminator").isNotNull(), F.col("exact")).otherwise(F.col("only"))
    return rows.select("row", "name", F.coalesce(known, made).alias("entity_id"), known.isNull().alias("new"))


def provenance(sightings: DataFrame) -> DataFrame:
    """The branch that first showed a memory, and all that did. sightings: (conv_id, id, branch, seen_at)."""
    return sightings.groupBy("conv_id", "id").agg(F.min_by("branch", F.struct("seen_at", "branch")).alias("origin"), F.array_sort(F.collect_set("branch")).alias("seen_on"))


def plan_vector_sync(memories: DataFrame, stored: DataFrame) -> DataFrame:
    """What to do for each memory or vector. memories: (id, vector_hash, ready), stored: (id, vector_hash)."""
    m, s = memories.select("id", F.col("vector_hash").alias("want"), "ready"), stored.select("id", F.col("vector_hash").alias("have"))
    both = m.join(s, "id", "full_outer")
    ready = F.coalesce("ready", F.lit(False))
    action = F.when(~ready & F.col("have").isNotNull(), "delete").when(ready & F.col("have").isNull(), "insert").when(ready & (F.col("have") != F.col("want")), "replace").otherwise("keep")
    return both.select("id", action.alias("action"))
