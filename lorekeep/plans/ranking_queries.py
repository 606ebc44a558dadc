"""Queries over dense search, fusion, re-ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dense, evaluate, lexical, rank
from .conversation_queries import BM25, newest_queries
from .driver import IMPORTANCE, pick, table
from .oplog_queries import VERSIONS, versions
from .registry import query

VEC = "v as (select vec_id, embedding::double[] as e, label from embeddings)"
COS = VEC + """, s as (select q.vec_id as query_id, v.vec_id as id, list_cosine_similarity(q.e, v.e) as score from v q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
dense as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) - 1 as rank from s)"""


def dense_hits(spark, d, k=5, threshold=0.25):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    hits = dense.cosine_topk(q, v, k + 1, -1.0).where("query_id <> id")
    again = F.row_number().over(rank.Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")) - 1
    return hits.withColumn("rank", again).where((F.col("rank") < k) & (F.col("score") >= threshold))


@query("t3_cosine_topk", f"with {COS} select query_id, id, round(score, 6) as score, cast(rank as integer) as rank from dense where rank < 5 and score >= 0.25")
def t3(spark, d):
    """Every fiftieth vector against all others."""
    return dense_hits(spark, d).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("h8_vector_norm", "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm from embeddings")
def h8(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(dense.norm(F.col("embedding")), 6).alias("norm"))


@query("j5_map_dense_hits", f"with {COS} select query_id, id // 2 as id, cast(min(rank) as integer) as rank from dense where rank < 5 and score >= 0.25 group by query_id, id // 2")
def j5(spark, d):
    """Hits are known by hash if even, else by place; two vectors belong to one memory."""
    hits = dense_hits(spark, d).select("query_id", F.xxhash64("id").alias("hash"), F.col("id").alias("index"), "rank")
    ids = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 2).alias("id"))
    return dense.map_hits(hits, ids.where("vec_id % 2 = 0").select(F.xxhash64("vec_id").alias("hash"), "id"), ids.select(F.col("vec_id").alias("index"), "id"))


@query("r10_space_guard", f"with {COS} select query_id, id from dense where rank < 5 and score >= 0.25 and id % 3 = query_id % 3 and id % 7 <> 0")
def r10(spark, d):
    hits = dense_hits(spark, d).withColumns({"space_fp": F.col("id") % 3, "stale": F.col("id") % 7 == 0})
    queries = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 3).alias("space_fp"))
    return dense.same_space(hits, queries).select("query_id", "id")


FUSE = BM25 + """, lex as (select conv_id as query_id, id, row_number() over (partition by conv_id order by round(score, 9) desc, id desc) - 1 as rank from s qualify rank < 24),
rec as (select conv_id as query_id, id, row_number() over (partition by conv_id order by id desc) - 1 as rank from docs qualify rank < 8),
ch as (select query_id, id, 0.9 / (60 + rank + 1) as part, 'lexical' as channel from lex union all select query_id, id, 0.8 / (60 + rank + 1), 'structured' from rec),
fused as (select query_id, id, sum(part) as score, count(distinct channel) as n from ch group by query_id, id)"""


def channels(spark, d):
    queries, docs = newest_queries(spark, d)
    lex = lexical.top_k(lexical.bm25(queries, docs), 24).select("query_id", "id", "rank", F.lit("lexical").alias("channel"))
    newest = F.row_number().over(rank.Window.partitionBy("conv_id").orderBy(F.desc("id"))) - 1
    recent = docs.select(F.col("conv_id").alias("query_id"), "id", newest.alias("rank"), F.lit("structured").alias("channel")).where("rank < 8")
    return queries, docs, lex.unionByName(recent)


def fused(spark, d):
    queries, docs, ch = channels(spark, d)
    return queries, docs, rank.rrf(ch, {"lexical": 0.9, "structured": 0.8})


@query("g6_rrf_fuse", FUSE + " select query_id, id, round(score, 6) as score, cast(n as integer) as n_channels from fused")
def g6(spark, d):
    return fused(spark, d)[2].select("query_id", "id", F.round("score", 6).alias("score"), F.size("channels").alias("n_channels"))


@query("g6_dense_gate", FUSE + " select query_id, id, cast(rank as integer) as rank from lex where id % 5 = 0 or (query_id, id) in (select query_id, id from rec where rank < 3)")
def g6_gate(spark, d):
    """Lexical rows pass if the dense channel (here the three newest) has them or an entity matches (here every fifth)."""
    _, _, ch = channels(spark, d)
    rows = ch.where("channel = 'lexical' or rank < 3").withColumn("channel", F.when(F.col("channel") == "structured", "dense1").otherwise(F.col("channel"))).withColumn("entity", F.col("id") % 5 == 0)
    return rank.dense_gate(rows).where("channel = 'lexical'").select("query_id", "id", "rank")


@query("g7_fuse_views", f"with {COS}, views as (select query_id, id, rank, 1.0 as w from dense where rank < 5 union all select query_id, id, rank, 0.72 from (select query_id, id, row_number() over (partition by query_id order by id) - 1 as rank from dense where rank < 9) where rank < 5) select query_id, id, round(sum(w / (60 + rank + 1)), 6) as score from views group by query_id, id")
def g7(spark, d):
    hits = dense_hits(spark, d, k=9, threshold=-1.0)
    other = hits.withColumn("rank", F.row_number().over(rank.Window.partitionBy("query_id").orderBy("id")) - 1).where("rank < 5").withColumn("channel", F.lit("assistant"))
    both = hits.where("rank < 5").withColumn("channel", F.lit("focus")).select("query_id", "id", "rank", "channel").unionByName(other.select("query_id", "id", "rank", "channel"))
    return rank.rrf(both, {"focus": 1.0, "assistant": 0.72}).select("query_id", "id", F.round("score", 6).alias("score"))


RERANK = FUSE + r""", fw as (select f.query_id, f.id, f.score, f.n, list_distinct(regexp_extract_all(lower(query.text), '[\p{L}\p{N}_]+')) as q, regexp_extract_all(lower(docs.text), '[\p{L}\p{N}_]+') as d from fused f join query on query.conv_id = f.query_id join docs on docs.conv_id = f.query_id and docs.id = f.id),
f as (select query_id, id, score, case when len(q) > 0 then coalesce(list_sum(list_transform(list_intersect(q, d), lambda w: length(w))), 0) / list_sum(list_transform(q, lambda w: length(w))) else 0 end as coverage, exp(-ln(2) * (50 - id) / 120.0) as recency, n / 3.0 as breadth, ([0.3, 0.6, 1.0, 0.6])[(id // 2) % 4 + 1] as importance from fw),
m as (select *, min(score) over w as s0, max(score) over w as s1, min(coverage) over w as c0, max(coverage) over w as c1, min(recency) over w as r0, max(recency) over w as r1, min(breadth) over w as b0, max(breadth) over w as b1, min(importance) over w as i0, max(importance) over w as i1 from f window w as (partition by query_id)),
n as (select query_id, id, score, case when s1 - s0 < 1e-9 then 0.5 else (score - s0) / (s1 - s0) end as s, case when c1 - c0 < 1e-9 then 0.5 else (coverage - c0) / (c1 - c0) end as c, case when r1 - r0 < 1e-9 then 0.5 else (recency - r0) / (r1 - r0) end as r, case when b1 - b0 < 1e-9 then 0.5 else (breadth - b0) / (b1 - b0) end as b, case when i1 - i0 < 1e-9 then 0.5 else (importance - i0) / (i1 - i0) end as i from m),
rr as (select query_id, id, score, 0.45 * s + 0.55 * least(1, greatest(0, 0.5 + 0.6 * (c - 0.5) + 0.24 * (r - 0.5) + 0.16 * (b - 0.5) + 0.16 * (i - 0.5))) as rerank_score from n)"""


def reranked(spark, d):
    """Coverage from the texts, importance by a rule on the id; r7_recall has all features."""
    queries, docs, f = fused(spark, d)
    rows = f.join(docs.select(F.col("conv_id").alias("query_id"), "id", "text"), ["query_id", "id"]).join(queries.select("query_id", F.col("text").alias("q")), "query_id")
    level = rank.lookup(rank.RERANK_IMPORTANCE, pick(IMPORTANCE, F.floor(F.col("id") / 2)), 0.6)
    rows = rows.withColumns({"coverage": X.word_coverage(X.words(F.col("q")), X.words(F.col("text"))), "phrase": F.lit(0.0), "slot": F.lit(0.0), "entity": F.lit(0), "recency": rank.recency(50 - F.col("id")), "importance": level, "breadth": F.size("channels") / 3.0})
    return queries, docs, rank.rerank(rows.drop("text", "q"))


@query("t9_rerank", RERANK + " select query_id, id, round(rerank_score, 6) as rerank_score, cast(row_number() over (partition by query_id order by round(rerank_score, 9) desc, round(score, 9) desc, id) as integer) as rank from rr")
def t9(spark, d):
    return reranked(spark, d)[2].select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query("t10_mmr_select")
def t10(spark, d):
    _, docs, rows = reranked(spark, d)
    rows = rows.select("query_id", "id", F.col("rerank_score").alias("score"))
    terms = docs.select(F.col("conv_id").alias("query_id"), "id", rank.similarity_terms(F.col("text"), F.array().cast("array<string>")).alias("terms"))
    return rank.mmr(rows.join(terms, ["query_id", "id"])).withColumn("mmr", F.round("mmr", 6))


GRAPH = FUSE + """, terms as (select distinct conv_id, id, token as term from post where length(token) >= 5), tdf as (select conv_id, term, count(*) as df from terms group by all), nn as (select conv_id, count(*) as n from docs group by conv_id),
rare as (select conv_id, term, ln(1 + n / df) as w from tdf join nn using (conv_id) where df / n <= 0.6), own as (select f.query_id, f.id, t.term, r.w from fused f join terms t on f.query_id = t.conv_id and f.id = t.id join rare r on r.conv_id = t.conv_id and r.term = t.term),
edges as (select a.query_id, a.id as a, b.id as b, sum(least(a.w, b.w)) as w from own a join own b on a.query_id = b.query_id and a.term = b.term and a.id < b.id group by all)"""


def graph(spark, d):
    _, docs, f = fused(spark, d)
    terms = lexical.postings(docs).where(F.length("token") >= 5).select("conv_id", "id", F.lit("t").alias("type"), F.col("token").alias("term"))
    n = docs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return f, rank.candidate_edges(f.withColumn("conv_id", F.col("query_id")), terms, n)


@query("j21_candidate_edges", GRAPH + " select query_id, a, b, round(w, 6) as w from edges")
def j21(spark, d):
    return graph(spark, d)[1].withColumn("w", F.round("w", 6))


def _diffuse_sql(rounds: int = 5) -> str:
    sql = GRAPH + """, both_ as (select query_id, a, b, w from edges union all select query_id, b, a, w from edges), share as (select query_id, a, b, w / sum(w) over (partition by query_id, a) as share from both_),
p0 as (select f.query_id, f.id, f.score, f.score / sum(f.score) over (partition by f.query_id) as base, f.score / sum(f.score) over (partition by f.query_id) as p, exists (select 1 from share s where s.query_id = f.query_id and s.a = f.id) as linked from fused f)"""
    for k in range(rounds):
        sql += f""", g{k} as (select s.query_id, s.b as id, sum(p.p * s.share) as got from p{k} p join share s on s.query_id = p.query_id and s.a = p.id group by all),
p{k + 1} as (select p.query_id, p.id, p.score, p.base, 0.82 * p.base + 0.18 * case when p.linked then coalesce(g.got, 0) else p.p end as p, p.linked from p{k} p left join g{k} g using (query_id, id))"""
    return sql + f" select query_id, id, round(0.88 * score + 0.12 * max(score) over w * p / max(p) over w, 6) as score from p{rounds} window w as (partition by query_id)"


@query("t11_graph_diffuse", _diffuse_sql())
def t11(spark, d):
    f, edges = graph(spark, d)
    return rank.diffuse(f.select("query_id", "id", "score"), edges).select("query_id", "id", F.round("score", 6).alias("score"))


@query("t14_budget_skip")
def t14(spark, d):
    docs = newest_queries(spark, d)[1].withColumn("size", F.length("text"))
    return rank.pack_skip(docs, "conv_id", [F.desc("id")], "size", 600)


CASES = BM25 + """, top as (select conv_id as query_id, id, row_number() over (partition by conv_id order by round(score, 9) desc, id desc) - 1 as rank from s qualify rank < 3), gold as (select conv_id as query_id, id from docs where id % 4 = 0),
c as (select q.query_id, coalesce(t.n, 0) as n, coalesce(t.h, 0) as h, t.first, coalesce(g.w, 0) as w from (select conv_id as query_id from query) q
 left join (select t.query_id, count(*) as n, count(g.id) as h, min(case when g.id is not null then rank end) as first from top t left join gold g using (query_id, id) group by t.query_id) t using (query_id) left join (select query_id, count(*) as w from gold group by query_id) g using (query_id)),
sc as (select query_id, case when w = 0 then 1.0 else h / w end as recall, case when w = 0 then (n = 0)::int::double when n > 0 then h / n else 0 end as "precision", case when w = 0 or first is null then 0 else 1 / (first + 1) end as reciprocal_rank, w > 0 and h > 0 as hit from c)"""


def cases(spark, d, k=3):
    queries, docs = newest_queries(spark, d)
    top = lexical.top_k(lexical.bm25(queries, docs), k).select("query_id", "id", "rank")
    return evaluate.case_scores(queries, top, docs.where("id % 4 = 0").select(F.col("conv_id").alias("query_id"), "id"), k)


@query("g18_ranked_metrics", CASES + ' select query_id, round(recall, 6) as recall, round("precision", 6) as "precision", round(reciprocal_rank, 6) as reciprocal_rank, hit from sc')
def g18(spark, d):
    return cases(spark, d).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")], "hit")


@query("g20_compare_runs", CASES + ', m as (select avg(recall) as a, avg("precision") as b, avg(reciprocal_rank) as c, avg(hit::int) as e from sc), m2 as (select avg(recall) as a, avg("precision") as b, avg(reciprocal_rank) as c, avg(hit::int) as e from sc where query_id % 2 = 0) select round(m2.a - m.a, 6) as delta_recall, round(m2.b - m.b, 6) as delta_precision, round(m2.c - m.c, 6) as delta_reciprocal_rank, round(m2.e - m.e, 6) as delta_hit_rate from m, m2')
def g20(spark, d):
    c = cases(spark, d)
    out = evaluate.compare_runs(evaluate.mean_scores(c), evaluate.mean_scores(c.where("query_id % 2 = 0")))
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


SAMPLES = "s0 as (select least(1.0, (n_chars // 8) / 1000.0)::double as score, quality = 1 as label from documents join labels using (doc_id))"


def samples(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.least(F.lit(1.0), F.floor(F.col("n_chars") / 8) / 1000.0).alias("score"), (F.col("quality") == 1).alias("label"))


THRESHOLDS = f"""with {SAMPLES}, x as (select distinct score from s0 union select 0.0 union select 1.0), k as (select x.score as threshold, count(*) filter (s0.label and s0.score >= x.score) as tp, count(*) filter (not s0.label and s0.score >= x.score) as fp, count(*) filter (s0.label and s0.score < x.score) as fn, count(*) filter (not s0.label and s0.score < x.score) as tn from x cross join s0 group by x.score),
t as (select *, case when tp + fp > 0 then tp / (tp + fp) else 1 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 1 end as re from k), u as (select *, case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end as f1 from t)"""


@query("g19_threshold_table", THRESHOLDS + ' select threshold::double as threshold, tp, fp, fn, tn, round(pr, 6) as "precision", round(re, 6) as recall, round(f1, 6) as f1 from u')
def g19(spark, d):
    t = evaluate.threshold_table(samples(spark, d))
    return t.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("g19_calibrate", THRESHOLDS + ' select threshold::double as threshold, round(pr, 6) as "precision", round(re, 6) as recall, round(f1, 6) as f1 from u order by (re >= 0.98) desc, pr desc, f1 desc, threshold desc limit 1')
def g19b(spark, d):
    c = evaluate.calibrate(samples(spark, d))
    return c.select("threshold", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("g24_causal_probes", VERSIONS + """, p as (select conv_id, slot, arg_max(text, valid_from) filter (status = 'active') as current, arg_max(text, valid_from) filter (superseded_by is not null) as superseded, arg_min(text, valid_from) as first from versions group by conv_id, slot)
select conv_id, slot, probe, text from (unpivot p on current, superseded, first into name probe value text)""")
def g24(spark, d):
    return evaluate.causal_probes(versions(spark, d))


@query("g24_score_probes", VERSIONS + """, p as (select conv_id, slot, arg_max(text, valid_from) filter (status = 'active') as current, arg_max(text, valid_from) filter (superseded_by is not null) as superseded, arg_min(text, valid_from) as first from versions group by conv_id, slot),
r as (select conv_id, slot, probe, text from (unpivot p on current, superseded, first into name probe value text)), b as (select conv_id, string_agg(text, chr(10)) as block from versions where status = 'active' group by conv_id)
select probe, count(*) as n, round(avg(coalesce(contains(block, substr(text, 1, 32)), false)::int), 6) as score from r left join b using (conv_id) group by probe""")
def g24b(spark, d):
    v = versions(spark, d)
    block = v.where("status = 'active'").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("block"))
    return evaluate.score_probes(evaluate.causal_probes(v), block).withColumn("score", F.round("score", 6))


@query("g21_key_retention", VERSIONS + """, must as (select conv_id, text from versions where status = 'active' and (importance = 'critical' or kind in ('commitment', 'relation'))), b as (select conv_id, string_agg(text, chr(10)) as block from versions where status = 'active' and conv_id % 5 <> 0 and version > 1 group by conv_id)
select conv_id, round(avg(case when block is not null then contains(block, substr(text, 1, 32))::int end), 6) as retention, count(*) as mandatory from must left join b using (conv_id) group by conv_id""")
def g21(spark, d):
    v = versions(spark, d)
    must = v.where("status = 'active' and (importance = 'critical' or kind in ('commitment', 'relation'))")
    block = v.where("status = 'active' and conv_id % 5 <> 0 and version > 1").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("block"))
    return evaluate.key_retention(must, block).withColumn("retention", F.round("retention", 6))


MODELS = ["org/e5-large", "BAAI/bge-m3", "text-embedding-3", "other-model"]


@query("h14_role_text", "select conv_id, turn, (['e5','bge','openai','generic'])[turn % 4 + 1] as family, md5(case when turn % 4 = 0 and trim(text) <> '' then case role when 'user' then 'query: ' else 'passage: ' end else '' end || trim(text)) as h from conversations")
def h14(spark, d):
    """Each turn as input of some model: users' turns are queries, the others documents."""
    c = table(spark, d, "conversations")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("turn") % 4 + 1).cast("int"))
    role = F.when(F.col("role") == "user", "query").otherwise("document")
    return c.select("conv_id", "turn", dense.family(model).alias("family"), F.md5(dense.role_text(F.col("text"), model, role)).alias("h"))
