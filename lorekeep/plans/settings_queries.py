"""Queries over reference documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate, settings as S
from .driver import table
from .registry import query

ENTRIES = """entries as (select doc_id as entry_id, source as world_id, source || case when doc_id % 3 = 0 then '-ext' else '-base' end as revision_id, 'title ' || doc_id as title, text as content,
 doc_id % 17 = 0 as constant, doc_id % 11 = 0 as disabled, doc_id % 13 = 0 as secret, case when doc_id % 10 <> 9 then (doc_id % 10)::double end as ord from documents)"""


def entries(spark, d):
    doc = F.col("doc_id")
    revision = F.concat("source", F.when(doc % 3 == 0, "-ext").otherwise("-base"))
    return table(spark, d, "documents").select(
        doc.alias("entry_id"), F.col("source").alias("world_id"), revision.alias("revision_id"), F.concat(F.lit("title "), doc).alias("title"), F.col("text").alias("content"),
        (doc % 17 == 0).alias("constant"), (doc % 11 == 0).alias("disabled"), (doc % 13 == 0).alias("secret"), F.when(doc % 10 != 9, (doc % 10).cast("double")).alias("ord"),
    )


def worlds(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("world_id")).distinct().select("world_id", F.concat("world_id", F.lit("-base")).alias("baseline_id"), F.array(F.concat("world_id", F.lit("-ext"))).alias("extension_ids"))


def revisions(spark, d):
    """Every world has a baseline and an extension; those of worlds that end in 7 build on nothing."""
    w = worlds(spark, d)
    base = w.select(F.col("baseline_id").alias("revision_id"), "world_id", F.col("world_id").alias("source_id"), F.lit("baseline").alias("kind"), F.lit(None).cast("string").alias("base_id"))
    ext = w.select(F.col("extension_ids")[0].alias("revision_id"), "world_id", F.col("world_id").alias("source_id"), F.lit("extension").alias("kind"), F.when(~F.col("world_id").endswith("7"), F.col("baseline_id")).otherwise("none").alias("base_id"))
    return base.unionByName(ext)


@query("j6_active_scope", f"with {ENTRIES} select entry_id, world_id, revision_id, case when revision_id like '%-ext' then 1 else 0 end as place from entries where not disabled and not (revision_id like '%-ext' and world_id like '%7')")
def j6(spark, d):
    return S.active_scope(worlds(spark, d), revisions(spark, d), entries(spark, d)).select("entry_id", "world_id", "revision_id", "place")


@query("p15_integrity", f"with {ENTRIES} select distinct 'extension without a baseline' as rule, world_id || '-ext' as id from entries where world_id like '%7' union all select 'empty content', entry_id::varchar from entries where trim(content) = ''")
def p15(spark, d):
    w = worlds(spark, d)
    sources = w.select(F.col("world_id").alias("source_id"), "world_id")
    return S.integrity(w, sources, revisions(spark, d), entries(spark, d))


@query("j8_apply_overlays", f"with {ENTRIES} select entry_id, case when entry_id % 5 = 0 then 'new ' || entry_id when entry_id % 7 = 0 then null else title end as title, case when entry_id % 7 = 0 and entry_id % 5 <> 0 then 'gone' else 'kept' end as note from entries")
def j8(spark, d):
    e = entries(spark, d).select("entry_id", "title").withColumn("note", F.lit("kept"))
    some = e.where("entry_id % 5 = 0 or entry_id % 7 = 0")
    five = F.col("entry_id") % 5 == 0
    over = some.select("entry_id", F.when(five, F.concat(F.lit("new "), "entry_id")).alias("title"), F.lit(True).alias("set_title"), F.lit("gone").alias("note"), (~five).alias("set_note"))
    return S.apply_overlays(e, over, ["title", "note"])


@query("j7_bind_chat_world", "with w as (select distinct source as world_id from documents), c as (select distinct conv_id, 'src' || (conv_id % 30) as world_id from conversations) select c.conv_id, coalesce(w.world_id, (select min(world_id) from w)) as world_id, w.world_id is not null as own from c left join w using (world_id)")
def j7(spark, d):
    chats = table(spark, d, "conversations").select("conv_id").distinct().withColumn("world_id", F.concat(F.lit("src"), F.col("conv_id") % 30))
    return S.bind(chats, worlds(spark, d))


@query("s6_segment_untitled", r"""with p as (select doc_id as id, list_filter(list_transform(regexp_split_to_array(text, '\n{2,}'), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))), lambda x: x <> '') as para,
list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))), lambda x: x <> '') as sent from documents),
u as (select id, case when len(para) > 1 then para else sent end as part from p)
select id, cast(i - 1 as integer) as "index", cast(length(part) as integer) as length, substr(part, 1, 180) as preview from (select id, unnest(part[1:8]) as part, unnest(range(1, least(len(part), 8) + 1)) as i from u)""")
def s6(spark, d):
    """Every document, by paragraphs if it has several, else by sentences."""
    return S.segment_untitled(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


#: Entries of a file, at most: a file is one value of a row, so its size is bounded and the number of files grows instead.
PER_FILE = 100


@query("s5_ingest_titled_text", f"select source || '/' || (doc_id // {PER_FILE}) as path, cast(row_number() over (partition by source, doc_id // {PER_FILE} order by doc_id) - 1 as integer) as \"index\", 'Doc ' || doc_id as title, md5(trim(regexp_replace(text, '(^|\\n)#', '\\1 #', 'g'), chr(32) || chr(10) || chr(9) || chr(13))) as h from documents")
def s5(spark, d):
    """Each source's documents under headings, a file for each hundred ids, taken apart again; their own headings are indented."""
    docs = table(spark, d, "documents")
    text = F.regexp_replace("text", r"(^|\n)#", "$1 #")
    part = F.struct("doc_id", F.concat(F.lit("# Doc "), "doc_id", F.lit("\n"), text, F.lit("\n")).alias("t"))
    path = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / PER_FILE))
    files = docs.groupBy(path.alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("text"))
    return S.titled_entries(files).select("path", "index", "title", F.md5("content").alias("h"))


@query("s4_ingest_worldbook", f"with {ENTRIES} select entry_id // {PER_FILE} as book, title, md5(content) as h, constant, disabled, secret, ord, 1 as extra from entries")
def s4(spark, d):
    """Entries written as world-info JSON, a book for each hundred ids, and read again."""
    e = entries(spark, d)
    one = F.struct("title", "content", "constant", F.col("disabled").alias("disable"), "secret", F.col("ord").alias("order"), F.lit("x").alias("vendor"))
    books = e.groupBy(F.floor(F.col("entry_id") / PER_FILE).alias("book")).agg(F.to_json(F.struct(F.collect_list(one).alias("entries"))).alias("text"))
    out = S.worldbook_entries(books.select(F.col("book").cast("string").alias("path"), "text"))
    return out.select(F.col("path").cast("long").alias("book"), "title", F.md5("content").alias("h"), "constant", "disabled", "secret", "ord", F.size("raw_extra").alias("extra"))


@query("s7_route_format", "select page_id, case when page_id % 3 = 0 then 'json' when page_id % 3 = 1 then 'text' else 'text' end as format from pages")
def s7(spark, d):
    p = table(spark, d, "pages")
    name = F.concat("page_id", F.when(F.col("page_id") % 3 == 0, ".JSON").when(F.col("page_id") % 3 == 1, ".md").otherwise(".bin"))
    return p.select("page_id", S.route_format(name, F.col("html")).alias("format"))


def chunks(spark, d):
    return S.build_chunks(entries(spark, d))


@query("h10_split_chunks")
def h10(spark, d):
    return chunks(spark, d).select("entry_id", "chunk", F.length("text").alias("length"), F.md5("text").alias("h"))


@query("g9_entry_manifest")
def g9(spark, d):
    return S.entry_manifest(chunks(spark, d)).select("entry_id", "chunks", "signature")


@query("g10_corpus_fingerprint")
def g10(spark, d):
    return S.corpus_fingerprint(chunks(spark, d))


@query("g26_index_summary")
def g26(spark, d):
    return S.index_summary(chunks(spark, d))


@query("j18_diff_manifests", "select doc_id as entry_id, case when doc_id % 5 = 0 then 'added' when doc_id % 7 = 0 then 'removed' when doc_id % 3 = 0 and trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' then 'changed' else 'unchanged' end as change from documents where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def j18(spark, d):
    """Some entries came, some went, some have another title since."""
    e = entries(spark, d).where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")
    old = S.entry_manifest(S.build_chunks(e.where("entry_id % 5 <> 0")))
    new = S.entry_manifest(S.build_chunks(e.where("entry_id % 5 = 0 or entry_id % 7 <> 0").withColumn("title", F.when(F.col("entry_id") % 3 == 0, "other").otherwise(F.col("title")))))
    return S.diff_manifests(old, new).select("entry_id", "change")


@query("g8_collapse_to_entry", """with s as (select source as query_id, doc_id // 4 as entry_id, (n_chars % 97) / 97.0 as score from documents), r as (select *, row_number() over (partition by query_id, entry_id order by score desc) as r from s)
select query_id, cast(entry_id as bigint) as entry_id, round(sum(score * case r when 1 then 1 when 2 then 0.25 when 3 then 0.1 else 0 end), 6) as score, count(*) as chunks from r group by query_id, entry_id""")
def g8(spark, d):
    s = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.floor(F.col("doc_id") / 4).alias("entry_id"), ((F.col("n_chars") % 97) / 97.0).alias("score"))
    return S.collapse_to_entry(s).withColumn("score", F.round("score", 6))


@query("t8_setting_order", f"with {ENTRIES} select entry_id, world_id, cast(row_number() over (partition by world_id order by ord asc nulls last, entry_id) as integer) as place from entries")
def t8(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("world_id").orderBy(F.col("ord").asc_nulls_last(), S.natural_key(F.concat(F.lit("e"), "entry_id")))
    return entries(spark, d).select("entry_id", "world_id", F.row_number().over(order).alias("place"))


@query("t2_setting_lexical")
def t2(spark, d):
    """The newest user turns against the entries of one world each."""
    from .conversation_queries import newest_queries

    q = newest_queries(spark, d)[0].withColumn("world_id", F.concat(F.lit("src"), F.col("conv_id") % 20))
    c = chunks(spark, d).where("not disabled")
    return S.lexical_topk(q, c).select("query_id", "entry_id", "chunk", F.round("score", 6).alias("score"), "rank")


TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_][a-z0-9_.:/+-]*'))"
NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


@query("j9_baseline_gate", f"""with o as (select doc_id, {NORM.format('text')} as x, {TOK.format('text')} as t from documents), b as (select item_id, {NORM.format('text')} as x, {TOK.format('text')} as t from benchmark),
p as (select doc_id, item_id, o.x as ox, b.x as bx, len(o.t) as m, len(b.t) as n, len(list_intersect(o.t, b.t)) as i from o, b),
s as (select doc_id, item_id, case when ox = bx then 1.0 when least(length(ox), length(bx)) >= 8 and (contains(ox, bx) or contains(bx, ox)) then least(0.99, 0.88 + 0.11 * least(length(ox), length(bx)) / greatest(length(ox), length(bx))) when least(m, n) = 0 then 0.0 else greatest(i / (m + n - i), 0.92 * i / least(m, n)) end as score from p),
r as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, item_id) as r from s where score >= 0.78) select doc_id, item_id, round(score, 6) as score from r where r = 1""")
def j9(spark, d):
    """Texts that restate a benchmark passage, with the best match; a text of many tokens contains most short passages."""
    ops = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    records = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return gate.best_match(ops, records).select(F.col("op_id").alias("doc_id"), F.col("record_id").alias("item_id"), F.round("score", 6).alias("score"))


@query("p10_filter_for_actor", f"with {ENTRIES} select world_id as query_id, count(*) as n_hidden from entries where secret group by world_id")
def p10(spark, d):
    """Secret entries without an audience are hidden from everyone."""
    rows = entries(spark, d).withColumnRenamed("world_id", "query_id")
    return S.for_actor(rows, ~F.col("secret"), "query_id")[1].select("query_id", F.size("hidden").cast("long").alias("n_hidden"))


@query("p16_normalize_entries", f"with {ENTRIES} select entry_id, title, md5(trim(content)) as h, constant, ord from entries")
def p16(spark, d):
    raw = entries(spark, d).withColumns({"title": F.concat(F.lit("  "), "title", F.lit(" ")), "constant": F.when(F.col("constant"), True), "ord": F.col("ord").cast("string")})
    return S.normalize_entries(raw).select("entry_id", "title", F.md5("content").alias("h"), "constant", "ord")


@query("r8_retrieve_settings")
def r8(spark, d):
    """The newest user turns against one world each; secret entries are hidden."""
    from .conversation_queries import newest_queries

    q = newest_queries(spark, d)[0].withColumn("world_id", F.concat(F.lit("src"), F.col("conv_id") % 20))
    return S.retrieve(q, chunks(spark, d).where("not disabled"), ~F.col("secret")).withColumn("score", F.round("score", 6))


@query("h4_lexical_similarity", f"""with o as (select doc_id, {NORM.format('text')} as x, {TOK.format('text')} as t from documents), b as (select item_id, {NORM.format('text')} as x, {TOK.format('text')} as t from benchmark),
p as (select doc_id, item_id, o.x as ox, b.x as bx, len(o.t) as m, len(b.t) as n, len(list_intersect(o.t, b.t)) as i from o join b on b.item_id = o.doc_id % 40)
select doc_id, item_id, round(case when ox = '' or bx = '' then 0.0 when ox = bx then 1.0 when least(length(ox), length(bx)) >= 8 and (contains(ox, bx) or contains(bx, ox)) then least(0.99, 0.88 + 0.11 * least(length(ox), length(bx)) / greatest(length(ox), length(bx))) when least(m, n) = 0 then 0.0 else greatest(i / (m + n - i), 0.92 * i / least(m, n)) end, 6) as score from p""")
def h4(spark, d):
    """Each document against one benchmark passage."""
    from ..functions.text import lexical_similarity

    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("b"))
    rows = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40).join(b, "item_id")
    return rows.select("doc_id", "item_id", F.round(lexical_similarity(F.col("text"), F.col("b")), 6).alias("score"))


@query("h3_tokens_baseline", f"select doc_id, cast(len({TOK.format('text')}) as integer) as n from documents")
def h3(spark, d):
    from ..functions.text import tokens_baseline

    return table(spark, d, "documents").select("doc_id", F.size(tokens_baseline(F.col("text"))).alias("n"))


@query("h13_retrieval_text", "select doc_id, md5(trim('{' || source || '} [' || lang || ' — ' || source || '] ' || trim(text))) as h from documents")
def h13(spark, d):
    from ..functions.text import retrieval_text

    return table(spark, d, "documents").select("doc_id", F.md5(retrieval_text(F.col("source"), F.array("lang", "lang"), F.array("source"), F.col("text"))).alias("h"))
