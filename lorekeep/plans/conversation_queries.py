"""Queries over turns and their words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lexical, turns as T
from .driver import table, turns
from .registry import query

TURNS = "t as (select conv_id, turn, role, text from conversations where role <> 'system')"
#: tokens of a text: lower case, words of two or more of a-z, 0-9 and _
TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9_]{{2,}}')"
EST = "case when length({0}) = 0 then 0 else greatest(1, cast(ceil(0.2441 * length({0})) as bigint)) end"


@query("s1_scan_turns", f"with {TURNS} select * from t")
def s1(spark, d):
    return turns(spark, d)


@query("p1_strip_summary", "select conv_id, turn, trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), chr(32)) as clean from conversations")
def p1(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_summary(F.col("text")).alias("clean"))


PAIRS = f"""with {TURNS}, w as (select *, lag(role) over z as br, lag(turn) over z as bt, lag(text) over z as bx from t window z as (partition by conv_id order by turn)),
pairs as (select conv_id, turn as assistant_turn, case when br = 'user' then bt end as user_turn, case when br = 'user' then bx else '' end as user_text, text as assistant_text from w where role = 'assistant')"""


@query("j1_pair_turns", PAIRS + " select * from pairs")
def j1(spark, d):
    return T.pair_turns(turns(spark, d))


@query("j2_match_extractions", PAIRS + """ select p.conv_id, p.assistant_turn, length(p.user_text) as user_len, length(p.assistant_text) as assistant_len, e.event_summary
from pairs p join (select conv_id, assistant_turn, user_text, assistant_text, substr(assistant_text, 1, 40) as event_summary from pairs where assistant_turn % 4 <> 3) e using (conv_id, assistant_turn, user_text, assistant_text)""")
def j2(spark, d):
    pairs = T.pair_keys(T.pair_turns(turns(spark, d)))
    records = pairs.where("assistant_turn % 4 <> 3").select("conv_id", "assistant_turn", "pair_key", F.substring("assistant_text", 1, 40).alias("event_summary"))
    return pairs.join(records, ["conv_id", "assistant_turn", "pair_key"]).select("conv_id", "assistant_turn", F.length("user_text").cast("long").alias("user_len"), F.length("assistant_text").cast("long").alias("assistant_len"), "event_summary")


@query("j3_prune_stale", PAIRS + " select conv_id, assistant_turn from (select conv_id, assistant_turn, case when assistant_turn % 4 = 3 then 'edited' else assistant_text end as a, user_text from pairs) r where exists (select 1 from pairs p where p.conv_id = r.conv_id and p.user_text = r.user_text and p.assistant_text = r.a)")
def j3(spark, d):
    pairs = T.pair_keys(T.pair_turns(turns(spark, d)))
    stale = T.pair_turns(turns(spark, d)).withColumn("assistant_text", F.when(F.col("assistant_turn") % 4 == 3, "edited").otherwise(F.col("assistant_text")))
    return T.pair_keys(stale).join(pairs.select("conv_id", "pair_key"), ["conv_id", "pair_key"], "left_semi").select("conv_id", "assistant_turn")


@query("g12_completed_turns", f"""with {TURNS}, i as (select *, coalesce(sum((role = 'assistant')::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as island from t)
select conv_id, cast(island as bigint) as island, max(turn) as assistant_turn, count(*) as n_rows, string_agg(text, chr(10) order by turn) as turn_text from i group by conv_id, island having bool_or(role = 'assistant')""")
def g12(spark, d):
    return T.completed_turns(turns(spark, d))


@query("w2_latest", f"with {TURNS} select conv_id, max(turn) filter (role = 'user') as last_user, max(turn) filter (role = 'assistant') as last_assistant, arg_max(text, turn) as last_text from t group by conv_id")
def w2(spark, d):
    return T.latest(turns(spark, d))


@query("w3_query_views", f"""with {TURNS}, r as (select *, row_number() over (partition by conv_id order by turn desc) as r from t where trim(text) <> ''),
b as (select conv_id, trim(right(arg_max(text, turn), 3200)) as f, trim(right(string_agg(text, chr(10) order by turn), 8000)) as c from r where r <= 3 group by conv_id)
select conv_id, 'focus' as view, f as text, 1.0::double as weight from b union all select conv_id, 'context', c, 0.82::double from b where f <> c""")
def w3(spark, d):
    return T.query_views(turns(spark, d))


@query("g15_branch_rows", f"with {TURNS} select conv_id, count(*) as n_rows, true as stable from t group by conv_id")
def g15(spark, d):
    a, b = T.branch_ids(turns(spark, d)), T.branch_ids(turns(spark, d).repartition(5, "text"))
    return a.join(b.select("conv_id", F.col("branch_id").alias("other")), "conv_id").select("conv_id", "n_rows", (F.col("branch_id") == F.col("other")).alias("stable"))


@query("g16_is_prefix", f"""with {TURNS}, o as (select conv_id, turn, role, case when conv_id % 7 = 0 and turn = 1 then 'edited' else text end as text from t where turn < 3)
select conv_id, bool_and(case when o.turn is not null then t.turn is not null and o.text = t.text and o.role = t.role else true end) as "prefix", count(*) filter (o.turn is null) as appended from t full join o using (conv_id, turn) group by conv_id""")
def g16(spark, d):
    new = turns(spark, d)
    old = new.where("turn < 3").withColumn("text", F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), "edited").otherwise(F.col("text")))
    return T.is_prefix(old, new)


@query("g23_compression", f"""with {TURNS}, e as (select conv_id, turn, {EST.format('text')} as raw, case when role = 'assistant' then {EST.format('substr(text, 1, 80)')} end as mem from t),
r as (select conv_id, turn, row_number() over z as n, sum(raw) over z as raw_tokens, coalesce(sum(mem) over z, 0) as memory_tokens from e window z as (partition by conv_id order by turn))
select conv_id, turn, cast(n as integer) as n, cast(raw_tokens as bigint) as raw_tokens, cast(memory_tokens as bigint) as memory_tokens, round(memory_tokens / raw_tokens, 6) as ratio from r where n % 4 = 0""")
def g23(spark, d):
    t = turns(spark, d)
    memory = t.where("role = 'assistant'").select("conv_id", "turn", X.estimate_tokens(F.substring("text", 1, 80)).alias("tokens"))
    return T.compression_series(t, memory, every=4)


# Earlier turns as memories, the newest user turn of each conversation as the query, its own recent turns protected.
DOCS = f"""{TURNS}, last as (select conv_id, max(turn) as q from t where role = 'user' group by conv_id), size as (select conv_id, max(turn) + 1 as n from t group by conv_id),
query as (select t.conv_id, t.text from t join last on t.conv_id = last.conv_id and t.turn = last.q),
docs as (select t.conv_id, t.turn as id, t.text from t join last using (conv_id) join size using (conv_id) where t.turn < last.q and t.turn < size.n - 1)"""
BM25 = f"""with {DOCS}, tok as (select conv_id, id, {TOKENS.format('text')} as k from docs), p as (select conv_id, id, len(k) as dl, unnest(k) as token from tok),
post as (select conv_id, id, token, count(*) as tf, max(dl) as dl from p group by all), per as (select conv_id, count(*) as n, avg(greatest(1, len(k))) as al from tok group by conv_id),
q as (select conv_id, token, count(*) as qtf from (select conv_id, unnest({TOKENS.format('text')}) as token from query) group by all), df as (select conv_id, token, count(*) as df from post group by all),
s as (select post.conv_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(1.0, al))) * least(2, qtf)) as score
from post join df using (conv_id, token) join per using (conv_id) join q using (conv_id, token) group by post.conv_id, id)"""


def newest_queries(spark, d):
    t = turns(spark, d)
    last = t.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("q"), (F.max("turn") + 1).alias("n")).where("q is not null")
    rows = t.join(last, "conv_id")
    queries = rows.where("turn = q").select(F.col("conv_id").alias("query_id"), "conv_id", "text")
    docs = rows.where("turn < q and turn < n - 1").select("conv_id", F.col("turn").alias("id"), "text")  # P5: the newest row is protected
    return queries, docs


@query("t1_bm25_topk", BM25 + " select conv_id, id, round(score, 6) as score, cast(r - 1 as integer) as rank from (select *, row_number() over (partition by conv_id order by round(score, 9) desc, id desc) as r from s) where r <= 6")
def t1(spark, d):
    """The newest user turn of each conversation against its earlier turns: the six best by BM25."""
    out = lexical.top_k(lexical.bm25(*newest_queries(spark, d)), 6)
    return out.select("conv_id", "id", F.round("score", 6).alias("score"), "rank")


@query("g3_corpus_stats", f"""with {DOCS}, tok as (select conv_id, id, {TOKENS.format('text')} as k from docs), p as (select conv_id, id, unnest(k) as token from tok),
per as (select conv_id, count(*) as n_docs, avg(greatest(1, len(k))) as avg_len from tok group by conv_id)
select conv_id, token, count(distinct id) as df, count(*) as cf, n_docs, round(avg_len, 6) as avg_len from p join per using (conv_id) group by conv_id, token, n_docs, avg_len""")
def g3(spark, d):
    return lexical.corpus_stats(newest_queries(spark, d)[1]).select("conv_id", "token", "df", "cf", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("p5_protect_recent", f"with {TURNS}, n as (select conv_id, max(turn) + 1 as n from t group by conv_id) select conv_id, turn from t join n using (conv_id) where turn < n - 2")
def p5(spark, d):
    t = turns(spark, d)
    return t.join(t.groupBy("conv_id").agg((F.max("turn") + 1).alias("n")), "conv_id").where("turn < n - 2").select("conv_id", "turn")


@query("p4_is_settled", f"with {TURNS}, n as (select conv_id, max(turn) + 1 as n from t group by conv_id) select conv_id, turn, turn <= n - 1 - 3 as settled from t join n using (conv_id)")
def p4(spark, d):
    t = turns(spark, d)
    return t.join(t.groupBy("conv_id").agg((F.max("turn") + 1).alias("n")), "conv_id").select("conv_id", "turn", (F.col("turn") <= F.col("n") - 1 - 3).alias("settled"))


@query("h2_tokens_hybrid", f"select conv_id, turn, array_to_string({TOKENS.format('text')}, ' ') as tokens from conversations")
def h2(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.tokens_hybrid(F.col("text")), " ").alias("tokens"))


@query("h6_estimate_tokens", f"select doc_id, {EST.format('text')} as tokens from documents")
def h6(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("h1_normalize_text", "select doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as h from documents")
def h1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalize(F.col("text"))).alias("h"))


@query("h7_fnv1a32")
def h7(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.fnv1a32(F.regexp_replace("text", "[^ -~]", "")).alias("fnv"))


@query("h17_xml_escape", "select page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as url from pages")
def h17(spark, d):
    return table(spark, d, "pages").select("page_id", X.xml_escape(F.col("url")).alias("url"))


@query("h5_word_coverage")
def h5(spark, d):
    queries, docs = newest_queries(spark, d)
    both = docs.join(queries.select("conv_id", F.col("text").alias("q")), "conv_id")
    q = X.words(F.col("q"))
    return both.select("conv_id", "id", F.round(X.word_coverage(q, X.words(F.col("text"))), 6).alias("coverage"), X.phrase_hits(q, F.col("text")).alias("phrases"))


@query("g22_injection_breakdown", f"with {TURNS}, e as (select conv_id, sum({EST.format('text')}) filter (role = 'user') as u, sum({EST.format('text')}) filter (role = 'assistant') as a from t group by conv_id) select conv_id, cast(coalesce(u, 0) as bigint) as user_tokens, cast(coalesce(a, 0) as bigint) as assistant_tokens, cast(coalesce(u, 0) + coalesce(a, 0) as bigint) as total_tokens from e")
def g22(spark, d):
    e = turns(spark, d).withColumn("n", X.estimate_tokens(F.col("text")))
    layer = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0))
    return e.groupBy("conv_id").agg(layer("user").alias("user_tokens"), layer("assistant").alias("assistant_tokens")).withColumn("total_tokens", F.col("user_tokens") + F.col("assistant_tokens"))


@query("g25_cost_metering", f"select role as kind, count(*) as calls, cast(sum(length(text)) as bigint) as characters, cast(sum({EST.format('text')}) as bigint) as tokens from conversations group by role")
def g25(spark, d):
    return table(spark, d, "conversations").groupBy(F.col("role").alias("kind")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("text")).alias("characters"), F.sum(X.estimate_tokens(F.col("text"))).alias("tokens"))


@query("p13_provider_error", "select doc_id, doc_id % 9 = 0 as is_error from documents")
def p13(spark, d):
    """Summaries of which every ninth is a failed call's message."""
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("[API error] HTTP "), 400 + F.col("doc_id") % 200, F.lit(": quota exceeded"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.is_provider_error(text).alias("is_error"))


@query("p14_starved_json", "select doc_id, doc_id % 4 = 1 as starved from documents")
def p14(spark, d):
    """Whole objects, objects cut short, and prose."""
    whole = F.to_json(F.struct("doc_id", "lang"))
    text = F.when(F.col("doc_id") % 4 == 0, whole).when(F.col("doc_id") % 4 == 1, F.left(whole, F.length(whole) - 3)).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.is_starved_json(text).alias("starved"))
