"""Queries over records of settings, budgets of layers, queries for extraction, merged state, rebuilt stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as A, dense, ingest as I, rank, settings as S
from ..streaming import turns as R
from .assembly_queries import last_rows
from .conversation_queries import TURNS
from .driver import table, turns
from .oplog_queries import VERSIONS, state_ops, versions
from .registry import query
from .settings_queries import NORM, TOK

_LAST = "l as (select conv_id, arg_max(text, turn) filter (role = 'user') as u, arg_max(text, turn) filter (role = 'assistant') as a, sum(length(text)) as n, count(*) as k from t group by conv_id)"


@query("t17_layer_budget", f"""with {TURNS}, {_LAST}, w as (select conv_id, greatest(0, 2000 - coalesce(length(u), 0) - coalesce(length(a), 0) - 300) as free, [n // 3, 200 * k, 0, n // 2] as want from l),
x as (select conv_id, free, i as place, want[i] as want, coalesce(list_sum(want[1:i - 1]), 0) as before from w, range(1, 5) r(i))
select conv_id, (['canonical_state','recent_context','relevant_settings','host_baseline'])[place] as layer, cast(least(before + want, free) - least(before, free) as bigint) as ceiling, want > 0 and before >= free as dropped from x""")
def t17(spark, d):
    """What each conversation's layers get beside its newest pair."""
    size = turns(spark, d).groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("k"))
    pair = last_rows(spark, d).select("conv_id", (F.coalesce(F.length("user"), F.lit(0)) + F.coalesce(F.length("assistant"), F.lit(0))).alias("pair_chars"))
    want = {"canonical_state": F.floor(F.col("n") / 3), "recent_context": 200 * F.col("k"), "relevant_settings": F.lit(None).cast("long"), "host_baseline": F.floor(F.col("n") / 2)}
    layers = F.explode(F.array(*[F.struct(F.lit(name).alias("layer"), c.cast("long").alias("chars")) for name, c in want.items()]))
    return A.layer_budget(size.join(pair, "conv_id").select("conv_id", "pair_chars", layers.alias("w")).select("conv_id", "pair_chars", "w.*"), limit=1500, reserve=300)


@query("t7_state_for_extraction", VERSIONS + """, x as (select *, case when status = 'active' then 0 when status = 'closed' and importance in ('high', 'critical') then 1 end as part from versions),
y as (select conv_id, part, case part when 0 then '- [' || kind || ' slot=' || slot || '] ' || text else '- [past:' || kind || '] ' || text end as line, row_number() over (partition by conv_id, part order by valid_from desc, slot || '/' || version desc) as r from x where part is not null)
select conv_id, substr(string_agg(line, chr(10) order by part, r), 1, 200) as state from y where part = 0 and r <= 28 or part = 1 and r <= 8 group by conv_id""")
def t7(spark, d):
    v = versions(spark, d).withColumn("id", F.concat_ws("/", "slot", "version"))
    return rank.state_for_extraction(v, chars=200)


@query("h15_extraction_query", VERSIONS.replace("with ", f"with {TURNS}, ", 1) + f""", {_LAST}, m as (select conv_id, slot || '/' || version as id, slot, kind, text from versions where status = 'active'),
e as (select m.conv_id, m.id, m.kind, r.n, (['ion', slot, 'the x' || conv_id % 3])[r.n] as entity from m, range(1, 4) r(n)),
h as (select e.*, case when length(replace({NORM.format('entity')}, ' ', '')) >= 2 and contains(replace({NORM.format("trim(substr(trim(coalesce(u, '')), 1, 5000)) || chr(10) || trim(substr(trim(coalesce(a, '')), 1, 7000))")}, ' ', ''), replace({NORM.format('entity')}, ' ', '')) then 0 when kind in ('state','commitment','intention','relation','knowledge') then 1 end as part from e join l using (conv_id)),
f as (select conv_id, entity, min((part, id, n)) as z from h where part is not null group by all), fr as (select *, row_number() over (partition by conv_id order by z) as r from f),
fe as (select conv_id, string_agg(entity, ' / ' order by r) as ents from fr where r <= 14 group by conv_id),
s as (select conv_id, slot || ': ' || text as line, min(id) as id from m group by all), sr as (select *, row_number() over (partition by conv_id order by id, line) as r from s),
sl as (select conv_id, string_agg(line, chr(10) order by r) as slots from sr where r <= 12 group by conv_id),
p as (select conv_id, substr(trim(coalesce(u, '')), 1, 5000) as us, substr(trim(coalesce(a, '')), 1, 7000) as ass, ents, slots from l left join fe using (conv_id) left join sl using (conv_id))
select conv_id, md5(trim(substr(concat_ws(chr(10) || chr(10), case when us <> '' then '[CURRENT USER]' || chr(10) || us end, case when ass <> '' then '[CURRENT ASSISTANT]' || chr(10) || ass end, case when ents <> '' then '[AFFECTED / CURRENT ENTITIES]' || chr(10) || ents end,
 case when slots <> '' then '[CURRENT STATE SLOTS]' || chr(10) || slots end, '[CURRENT STATE HINT]' || chr(10) || 'hint ' || conv_id), 1, 12000))) as h from p""")
def h15(spark, d):
    """A query for the newest pair of each conversation, with the active values of the log of the same number."""
    v = versions(spark, d).where("status = 'active'").withColumn("id", F.concat_ws("/", "slot", "version"))
    m = v.select("conv_id", "id", "slot", "kind", "text", F.array(F.lit("ion"), F.col("slot"), F.concat(F.lit("the x"), F.col("conv_id") % 3)).alias("entities"))
    hints = turns(spark, d).select("conv_id").distinct().withColumn("hint", F.concat(F.lit(" hint "), "conv_id"))
    return A.extraction_query(last_rows(spark, d), m, hints).select("conv_id", F.md5("text").alias("h"))


@query("p16_normalize_worlds", "select 'w' || doc_id as world_id, case when doc_id % 4 = 0 then 'Untitled World' else 'World ' || doc_id end as name, case when doc_id % 3 = 0 then 'r' || doc_id end as active_baseline_revision_id, case when doc_id % 2 = 0 then 'a,b' else '' end as extensions, case when doc_id % 5 = 0 then 1700000000000 else doc_id end as created_at, 1700000000000 as updated_at from documents")
def p16(spark, d):
    """Worlds with blanks, missing names, repeated revisions, stamps that are no numbers."""
    i = F.col("doc_id")
    text = F.lit(None).cast("string")
    raw = table(spark, d, "documents").select(
        F.concat(F.lit(" w"), i, F.lit(" ")).alias("world_id"), F.when(i % 4 == 0, F.when(i % 8 == 0, "  ")).otherwise(F.concat(F.lit(" World "), i)).alias("name"), F.when(i % 3 == 0, F.concat(F.lit("r"), i)).when(i % 3 == 1, " ").alias("active_baseline_revision_id"),
        F.when(i % 2 == 0, F.array(F.lit("a "), F.lit(" b"), text, F.lit("a"), F.lit(" "))).alias("active_extension_revision_ids"), F.when(i % 5 == 0, "soon").otherwise(F.concat(i, F.lit(".7"))).alias("created_at"), text.alias("updated_at"),
    )
    return S.normalize_worlds(raw, 1_700_000_000_000).withColumn("active_extension_revision_ids", F.array_join("active_extension_revision_ids", ",")).withColumnRenamed("active_extension_revision_ids", "extensions")


@query("p16_normalize_sources", "select 's' || doc_id as source_id, source as world_id, case doc_id % 4 when 0 then 'worldbook_json' when 1 then 'titled_txt' else 'unknown' end as format, case when doc_id % 2 = 0 then doc_id || '.txt' end as filename, '' as content_hash, md5(text) as h, 7 as imported_at from documents")
def p16b(spark, d):
    i = F.col("doc_id")
    form = F.when(i % 4 == 0, "worldbook_json").when(i % 4 == 1, "titled_txt").when(i % 4 == 2, "TITLED_TXT")
    raw = table(spark, d, "documents").select(F.concat(F.lit("s"), i).alias("source_id"), F.concat(F.lit(" "), "source").alias("world_id"), form.alias("format"), F.when(i % 2 == 0, F.concat(i, F.lit(".txt "))).otherwise("").alias("filename"), F.lit(None).cast("string").alias("content_hash"), F.col("text").alias("raw_payload"), F.lit("7.9").alias("imported_at"))
    return S.normalize_sources(raw, 1).select("source_id", "world_id", "format", "filename", "content_hash", F.md5("raw_payload").alias("h"), "imported_at")


@query("p16_normalize_revisions", "select 'v' || doc_id as revision_id, source as world_id, 's' || doc_id as source_id, case when doc_id % 3 = 0 then 'Imported revision' else 'L' || doc_id end as revision_label, case when doc_id % 2 = 0 then 'extension' else 'baseline' end as revision_kind, case when doc_id % 2 = 0 then 'v' || (doc_id - 1) end as parent_revision_id, null::varchar as base_revision_id, doc_id as created_at from documents")
def p16c(spark, d):
    i = F.col("doc_id")
    raw = table(spark, d, "documents").select(
        F.concat(F.lit("v"), i).alias("revision_id"), F.col("source").alias("world_id"), F.concat(F.lit("s"), i, F.lit(" ")).alias("source_id"), F.when(i % 3 != 0, F.concat(F.lit("L"), i)).alias("revision_label"), F.when(i % 2 == 0, "extension").otherwise("other").alias("revision_kind"),
        F.when(i % 2 == 0, F.concat(F.lit(" v"), i - 1)).alias("parent_revision_id"), F.lit(" ").alias("base_revision_id"), i.alias("created_at"),
    )
    return S.normalize_revisions(raw, 1)


@query("h12_baseline_records")
def h12(spark, d):
    """Documents as sources of three types; every third has no title, every fifth no id."""
    i = F.col("doc_id")
    raw = table(spark, d, "documents").select(F.when(i % 3 == 0, "persona").when(i % 3 == 1, " card ").alias("source_type"), F.when(i % 5 != 0, F.concat(F.lit("d"), i)).alias("source_id"), F.when(i % 3 != 0, F.concat(F.lit("Title "), i)).alias("title"), "text")
    r = S.baseline_records(raw)
    return r.select("id", "source_type", "source_id", "title", F.col("chunk_index").cast("int").alias("chunk_index"), F.md5("text").alias("h"), F.size("tokens").alias("n_tokens"))


H12 = f"""select 'b_' || substr(sha256(concat_ws('|', source_type, sid, chunk, norm)), 1, 16) as id, source_type, sid as source_id, coalesce(title, sid) as title, cast(chunk as integer) as chunk_index, md5(text) as h, len({TOK.format('norm')}) as n_tokens
from (select *, coalesce(case when doc_id % 5 <> 0 then 'd' || doc_id end, title, source_type) as sid, {NORM.format('text')} as norm from (select entry_id as doc_id, chunk, text, case entry_id % 3 when 0 then 'persona' when 1 then 'card' else 'unknown' end as source_type, case when entry_id % 3 <> 0 then 'Title ' || entry_id end as title from chunks)) where norm <> ''"""


@query("h8_packed_vectors", "select vec_id, len(embedding)::integer as n, 4 * len(embedding)::integer as n_bytes, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 6) as square, round(embedding[1]::double, 6) as first from embeddings")
def h8(spark, d):
    """Vectors packed into bytes, stored as base64 and read again."""
    packed = table(spark, d, "embeddings").select("vec_id", F.base64(dense.pack("embedding")).alias("b"))
    back = packed.select("vec_id", F.length(F.unbase64("b")).alias("n_bytes"), dense.unpack(F.unbase64("b")).alias("v"))
    return back.select("vec_id", F.size("v").alias("n"), "n_bytes", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 6).alias("square"), F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"))


@query("s10_merge_state", "select conv_id, key, value from (select distinct conv_id from conversations), (values ('summary', 'new'), ('folds', 'old'), ('audit', 'null'), ('fresh', 'new')) v(key, value) where conv_id % 2 = 0 union all select distinct conv_id, unnest(['summary', 'folds', 'audit']), 'old' from conversations where conv_id % 2 = 1")
def s10(spark, d):
    """Every second conversation is written by a copy that has some fields only: an explicit null counts, a missing field does not."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    rows = lambda pairs: F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in pairs]))
    stored = ids.select("conv_id", rows((("summary", "old"), ("folds", "old"), ("audit", "old"), ("memories", "old"))).alias("x")).select("conv_id", "x.*")
    written = ids.where("conv_id % 2 = 0").select("conv_id", rows((("summary", "new"), ("folds", None), ("audit", "null"), ("fresh", "new"))).alias("x")).select("conv_id", "x.*")
    return I.merge_state(stored, written, ["memories"])


@query("r4_rebuild", VERSIONS + " select conv_id, slot, kind, text, valid_from, valid_until, status from versions")
def r4(spark, d):
    """A fifth of the messages have no record; once their operations are extracted, the store is that of the whole log."""
    log = state_ops(spark, d).withColumn("target_slot", F.col("slot"))
    due = log.where("msg % 5 = 0").select("conv_id", "msg")
    return R.rebuild(log.where("msg % 5 <> 0"), due, lambda pairs: log.join(pairs, ["conv_id", "msg"], "left_semi")).select("conv_id", "slot", "kind", "text", "valid_from", "valid_until", "status")
