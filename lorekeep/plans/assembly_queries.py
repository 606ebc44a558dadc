"""Queries over parsing, imports, assembly and index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as A, ingest as I, lexical, maintain as M, settings as S, turns as T
from .driver import OPS_SQL, ops, table, turns
from .oplog_queries import VERSIONS, versions
from .registry import query
from .settings_queries import chunks, entries


def messages(spark, d):
    """Operations of the log written into messages, three to a message."""
    o = ops(spark, d)
    one = F.struct("msg", F.to_json(F.struct("op", "kind", "text", "slot", "importance")).alias("j"))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]), "\n")
    return o.groupBy("conv_id", F.floor(F.col("msg") / 3).alias("msg")).agg(F.concat(F.lit("Prose {not json}\n<memory_ops>\n"), block, F.lit("\n{broken\n</memory_ops>")).alias("text"))


@query("s2_parse_ops", f"with {OPS_SQL} select conv_id, msg // 3 as msg, cast(row_number() over (partition by conv_id, msg // 3 order by msg) - 1 as integer) as op_idx, op, kind, text, slot, importance from ops")
def s2(spark, d):
    """All operations are read back; the broken line is an error of its own."""
    good, _ = I.parse_ops(messages(spark, d))
    return good.select("conv_id", "msg", "op_idx", "op.op", "op.kind", "op.text", "op.slot", "op.importance")


@query("s2_parse_errors", f"with {OPS_SQL} select distinct conv_id, msg // 3 as msg from ops")
def s2b(spark, d):
    return I.parse_ops(messages(spark, d))[1].select("conv_id", "msg")


@query("s3_parse_extraction", f"""with {OPS_SQL} select msg as id, k % 5 <> 4 as ok, case when k % 5 <> 4 then text else '' end as event_summary, cast(case when k % 5 = 4 then 0 else 1 end as integer) as n_ops, cast(case when k % 5 = 4 then 0 else 1 end as integer) as dropped, k % 7 = 0 and k % 5 <> 4 as importance_lost from ops""")
def s3(spark, d):
    """Replies plain, fenced, with prose and trailing commas, and starved ones."""
    o = ops(spark, d)
    level = F.when(F.col("k") % 7 == 0, "enormous").otherwise(F.col("importance"))
    good = F.to_json(F.struct(F.col("text").alias("event_summary"), F.lit("calm").alias("active_state"), F.array(F.struct(F.lit("add").alias("op"), "kind", "text", level.alias("importance")), F.struct(F.lit("dance").alias("op"), "kind", "text", level.alias("importance"))).alias("operations")))
    raw = F.when(F.col("k") % 5 == 0, good).when(F.col("k") % 5 == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(F.col("k") % 5 == 2, F.concat(F.lit("Here: "), F.regexp_replace(good, r"\]\}$", ",]}"), F.lit(" done"))).when(F.col("k") % 5 == 3, good).otherwise(F.left(good, F.lit(30)))
    r = I.parse_extractions(o.select(F.col("msg").alias("id"), raw.alias("raw")))
    lost = F.coalesce(F.get("operations", F.lit(0))["importance"].isNull() & (F.size("operations") > 0), F.lit(False))
    return r.select("id", "ok", "event_summary", F.size("operations").alias("n_ops"), "dropped", lost.alias("importance_lost"))


@query("s8_collect_sources", "select 'doc' as source_type, doc_id as source_id, md5(text) as h from documents where doc_id % 11 <> 0 and trim(text) <> '' union all select 'page', page_id, md5(html) from pages where trim(html) <> ''")
def s8(spark, d):
    """Documents (listed twice) and pages; every eleventh document is disabled."""
    doc = table(spark, d, "documents").select(F.lit("doc").alias("source_type"), F.col("doc_id").alias("source_id"), F.lit("").alias("title"), "text", (F.col("doc_id") % 11 == 0).alias("disabled"))
    page = table(spark, d, "pages").select(F.lit("page").alias("source_type"), F.col("page_id").alias("source_id"), F.col("url").alias("title"), F.col("html").alias("text"), F.lit(False).alias("disabled"))
    return I.collect_sources(doc, page, doc).select("source_type", "source_id", F.md5("text").alias("h"))


@query("s9_import_preview", "with s as (select source as world_id, text, min('d' || doc_id) as duplicate_of from documents where doc_id % 2 = 0 group by source, text) select d.doc_id, s.duplicate_of from documents d left join s on s.world_id = d.source and s.text = d.text")
def s9(spark, d):
    """All documents come in; those of even number are already there."""
    doc = table(spark, d, "documents")
    have = doc.where("doc_id % 2 = 0").select(F.col("source").alias("world_id"), F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("d"), "doc_id").alias("source_id"))
    return I.preview_import(doc.select("doc_id", F.col("source").alias("world_id"), F.concat("doc_id", F.lit(".txt")).alias("filename"), "text"), have).select("doc_id", "duplicate_of")


GROUP = "case when kind in ('commitment', 'intention') then 'commitment' when kind = 'knowledge' then 'knowledge' else 'condition' end"


@query("p12_classify_state", VERSIONS + f" select conv_id, slot, {GROUP} as \"group\" from versions where status = 'active'")
def p12(spark, d):
    return versions(spark, d).where("status = 'active'").select("conv_id", "slot", A.state_group(F.col("kind"), F.col("slot")).alias("group"))


def state_rows(spark, d):
    return versions(spark, d).where("status = 'active'").withColumn("mandatory", F.col("importance") == "critical")


BLOCK = VERSIONS + f", a as (select conv_id, '- ' || slot || ': ' || text as line, slot, importance <> 'critical' as m, case {GROUP} when 'condition' then 3 when 'commitment' then 4 else 5 end as p, -valid_from as v from versions where status = 'active'), b as (select conv_id, string_agg(line, chr(10) order by m, p, v, slot) as block from a group by conv_id)"


@query("t15_state_block", BLOCK + " select conv_id, block from b")
def t15(spark, d):
    return A.state_block(state_rows(spark, d), 5000)


@query("t17_pair_budget", "with b as (select conv_id, turn, length(text) as n, turn % 4 * 400 as tokens from conversations), t as (select *, case when tokens > 0 then least(1400, greatest(0, tokens - 300) * 2) else 1400 end as cap from b) select conv_id, turn, cast(cap as bigint) as cap, cast(least(n, 500, cap) as bigint) as state, cast(least(n, 900, cap - least(n, 500, cap)) as bigint) as reference from t")
def t17(spark, d):
    c = table(spark, d, "conversations")
    total, s, r = A.pair_budget(F.col("text"), F.col("text"), 900, 500, F.col("turn") % 4 * 400, 300)
    return c.select("conv_id", "turn", total.cast("long").alias("cap"), s.cast("long").alias("state"), r.cast("long").alias("reference"))


def last_rows(spark, d):
    t = turns(spark, d)
    side = lambda r: F.max_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn")))
    return t.groupBy("conv_id").agg(side("user").alias("user"), side("assistant").alias("assistant"))


@query("h15_generation_query")
def h15(spark, d):
    return A.generation_query(last_rows(spark, d), versions(spark, d).where("status = 'active'"))


@query("h16_query_views")
def h16(spark, d):
    return A.transport_views(A.generation_query(last_rows(spark, d), versions(spark, d).where("status = 'active'")))


@query("j16_scene_evidence", f"with {OPS_SQL}, s as (select conv_id, msg // 40 as scene, text, min(msg) as turn from ops where kind = 'event' group by all), r as (select *, row_number() over (partition by conv_id, scene order by turn, text) as r from s), l as (select conv_id, scene, r, '- [' || scene || '] ' || text as line from r where r <= 3), u as (select *, sum(length(line) + 1) over (partition by conv_id order by scene, r) as used from l) select conv_id, scene, line from u where used <= 1200")
def j16(spark, d):
    o = ops(spark, d).withColumnRenamed("msg", "turn")
    scenes = o.select("conv_id", F.floor(F.col("turn") / 40).alias("scene"), "turn")
    return A.scene_evidence(scenes, o.select("conv_id", "turn", "kind", "text"))


@query("j12_lookup_requests", f"with {OPS_SQL} select conv_id, msg, 0 as n, kind as object, slot as item from ops")
def j12(spark, d):
    o = ops(spark, d)
    return A.lookup_requests(o.select("conv_id", "msg", F.concat(F.lit("prose\n@lookup\nobject: "), "kind", F.lit("\nitem: "), "slot", F.lit("\n\nmore text")).alias("text")))


@query("j23_relevant_baseline", "with c as (select source as conv_id, doc_id as id, text, row_number() over (partition by source order by doc_id) as rank from documents qualify rank <= 3), s as (select source as conv_id, doc_id as id, text, row_number() over (partition by source order by n_chars, doc_id) as rank from documents qualify rank <= 6), a as (select *, 0 as part from c union all select *, 1 from s), o as (select *, row_number() over (partition by conv_id, id order by part, rank) as r from a qualify r = 1), u as (select *, sum(length(text)) over (partition by conv_id order by part, rank, id) as used from o) select conv_id, id, part from u where used <= 6000")
def j23(spark, d):
    from pyspark.sql import Window

    doc = table(spark, d, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("id"), "text", "n_chars")
    by = Window.partitionBy("conv_id")
    core = doc.withColumn("rank", F.row_number().over(by.orderBy("id"))).where("rank <= 3").drop("n_chars")
    similar = doc.withColumn("rank", F.row_number().over(by.orderBy("n_chars", "id"))).where("rank <= 6").drop("n_chars")
    return A.relevant_baseline(core, similar, 6000)


def reference_rows(spark, d, shares=A.SHARES):
    """The newest user turns (conv_id, text, dropped, ...) and their reference: constant settings, the six best earlier turns, the newest others.

    The constants are packed once for each world; dropped is the number of those that do not fit.
    """
    from pyspark.sql import Window

    from .conversation_queries import newest_queries

    q, docs = newest_queries(spark, d)
    q = q.select("conv_id", "text", F.col("conv_id").alias("query_id"), F.concat(F.lit("src"), F.col("conv_id") % 20).alias("world_id"))
    best = lexical.top_k(lexical.bm25(q.select("query_id", "conv_id", "text"), docs), 6).select("conv_id", "id", "rank")
    turn = lambda rows, layer: rows.select("conv_id", F.lit(layer).alias("layer"), F.col("rank").cast("long").alias("rank"), F.concat(F.lit("turn:"), "id").alias("id"), "text")
    newest = docs.join(best, ["conv_id", "id"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("id"))))
    fixed = chunks(spark, d).where("chunk = 0 and constant and not disabled and not secret")
    fixed = fixed.select("world_id", F.col("entry_id").alias("rank"), F.concat(F.lit("setting:"), "entry_id").alias("id"), F.col("retrieval_text").alias("text"))
    fixed, dropped = A.shared_constants(fixed, "world_id", 3000, shares)
    fixed = q.select("conv_id", "world_id").join(fixed, "world_id").drop("world_id")
    return q.join(dropped, "world_id", "left"), fixed.unionByName(turn(docs.join(best, ["conv_id", "id"]), 1)).unionByName(turn(newest, 2))


@query("t18_assemble")
def t18(spark, d):
    """State, constant settings of the conversation's world, the six best earlier turns and the newest others, in one row."""
    q, reference = reference_rows(spark, d)
    return A.assemble(q.select("conv_id", F.lit(4000).alias("context_tokens"), "dropped"), reference, A.state_block(state_rows(spark, d), 1200), 3000, 1200)


@query("t18_assemble_all")
def t18b(spark, d):
    """All layers in one row: besides those of t18 summaries, chosen scenes, their evidence and resolved lookups."""
    from pyspark.sql import Window

    from .derived_queries import scenes, summaries, t12

    shares = tuple(A.LAYERED.values())
    q, reference = reference_rows(spark, d, shares)
    layer = lambda rows, n, rank, id_, text: rows.select("conv_id", F.lit(n).alias("layer"), rank.cast("long").alias("rank"), id_.alias("id"), text.alias("text"))
    c = F.col
    told = layer(summaries(spark, d), 3, c("level") * 1_000_000 - c("node"), F.concat_ws("/", F.lit("summary"), "level", "node"), c("text"))
    seen = layer(scenes(spark, d).drop("n").join(t12(spark, d), ["conv_id", "scene"]), 4, c("rank"), F.concat_ws("/", F.lit("scene"), "scene"), c("outcome"))
    lines = j16(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("scene", "line")))
    proof = layer(lines, 5, c("r"), F.concat_ws("/", F.lit("evidence"), "r"), c("line"))
    found = layer(j12b(spark, d), 6, c("msg") * 1_000_000 + c("id"), F.concat_ws("/", F.lit("lookup"), "msg", "id"), c("text"))
    for rows in (told, seen, proof, found):
        reference = reference.unionByName(rows)
    return A.assemble(q.select("conv_id", F.lit(4000).alias("context_tokens"), "dropped"), reference.join(q.select("conv_id"), "conv_id"), A.state_block(state_rows(spark, d), 1200), 3000, 1200, shares)


@query("r9_verify_index", "select count(*) filter (e) as expected_entries, count(*) filter (not e) as foreign_entries from (select doc_id % 7 <> 0 as e from documents where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')")
def r9(spark, d):
    """An index of all entries against chunks of those that still stand."""
    c = chunks(spark, d)
    plan = S.diff_manifests(S.entry_manifest(c), S.entry_manifest(c.where("entry_id % 7 <> 0")))
    index = M.refresh_index(c, c.select("entry_id", "hash"), plan)
    kept = index.select("entry_id").distinct().agg(F.count(F.lit(1)).alias("expected_entries"))
    gone = c.join(index, "hash", "left_anti").select("entry_id").distinct().agg(F.count(F.lit(1)).alias("foreign_entries"))
    return kept.join(gone)


@query("r11_cascade", "select doc_id as entry_id from documents where source not like '%7'")
def r11(spark, d):
    e = entries(spark, d)
    w = e.select("world_id").distinct()
    s = w.select(F.col("world_id").alias("source_id"), "world_id")
    r = e.select("revision_id", F.col("world_id").alias("source_id")).distinct()
    return M.cascade(w.where("world_id like '%7'"), w, s, r, e)["entries"].select("entry_id")


@query("j12_resolve_lookups")
def j12b(spark, d):
    """Every assistant turn asks for what the first words of its user's turn name; earlier turns are the memories."""
    t = turns(spark, d)
    pairs = T.pair_turns(t)
    text = F.concat(F.lit("@lookup\nobject: "), F.substring_index("user_text", " ", 4), F.lit("\nitem: "), F.substring_index("user_text", " ", -4))
    requests = A.lookup_requests(pairs.where("user_text <> ''").select("conv_id", F.col("assistant_turn").alias("msg"), F.regexp_replace(text, r"\n(?!item:|object:)", " ").alias("text")))
    docs = t.select("conv_id", F.col("turn").alias("id"), "text", "turn", F.xxhash64("text").alias("source_hash"))
    return A.resolve_lookups(requests, docs, t, t.where("turn % 2 = 0")).withColumn("text", F.md5("text"))


@query("t14_budget_layers")
def t14b(spark, d):
    """Constants, relevant and older turns of each conversation within one budget."""
    from ..operators.rank import pack_layers

    t = turns(spark, d).select("conv_id", F.col("turn").alias("id"), (F.col("turn") % 3).cast("int").alias("layer"), F.length("text").alias("size"))
    return pack_layers(t, "conv_id", "layer", [F.desc("id")], "size", 1500)
