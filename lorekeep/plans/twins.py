"""SQL twins of queries that need more than a line: ordered passes as recursive queries, greedy choices unrolled."""

from __future__ import annotations

from ..operators.assemble import CUT
from ..operators.settings import CONDITION_LEADERS
from .assembly_queries import BLOCK
from .conversation_queries import BM25, DOCS, TOKENS, TURNS
from .oplog_queries import VERSIONS
from . import recall_queries, record_queries  # noqa: F401
from .ranking_queries import RERANK
from .registry import ORACLE_SQL, QUERIES
from .settings_queries import ENTRIES, NORM, TOK


def twin(name: str, sql: str) -> None:
    assert name in QUERIES and name not in ORACLE_SQL, name
    ORACLE_SQL[name] = sql


# H7: the hash as a fold over code points.
twin("h7_fnv1a32", """select conv_id, turn, list_reduce(list_transform(list_filter(string_split(regexp_replace(text, '[^ -~]', '', 'g'), ''), lambda c: c <> ''), lambda c: ascii(c)::bigint),
  lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::bigint) as fnv from conversations""")

SQUEEZE = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
WORDS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+')"
#: coverage and phrases of T9 over a table x (conv_id, id, q, n: both texts in normal form)
TEXT_FEATURES = f"""y as (select *, list_distinct({WORDS.format('q')}) as qd, {WORDS.format('q')} as qw, {WORDS.format('n')} as nw from x),
fx as (select conv_id, id, len(qw) as n_words, case when len(qd) > 0 then list_sum(list_transform(list_intersect(qd, nw), lambda w: length(w))) / list_sum(list_transform(qd, lambda w: length(w))) else 0 end as coverage,
 len(list_filter(list_distinct(list_transform(range(1, len(qw)), lambda i: qw[i] || '[^\\p{{L}}\\p{{N}}]{{0,2}}' || qw[i + 1])), lambda p: regexp_matches(n, p))) as phrases from y)"""

twin("h5_word_coverage", f"""with {DOCS}, x as (select docs.conv_id, docs.id, {SQUEEZE.format('query.text')} as q, {SQUEEZE.format('docs.text')} as n from docs join query using (conv_id)), {TEXT_FEATURES}
select conv_id, id, round(coalesce(coverage, 0), 6) as coverage, cast(phrases as integer) as phrases from fx""")

# Sentences of lines, packed in order, then conditions glued to what they are about.
_leaders = "|".join(CONDITION_LEADERS)
CHUNKS = f"""recursive {ENTRIES}, ln as (select entry_id, unnest(list_filter(regexp_split_to_array(content, '\\n+'), lambda x: trim(x) <> '')) as line, generate_subscripts(list_filter(regexp_split_to_array(content, '\\n+'), lambda x: trim(x) <> ''), 1) as j from entries),
sn as (select entry_id, j, unnest(s) as s, generate_subscripts(s, 1) as k from (select entry_id, j, list_filter(list_transform(regexp_extract_all(trim(line), '[^.!?;。！？；]*[.!?;。！？；]\\s*|[^.!?;。！？；]+$'), lambda x: trim(regexp_replace(x, '([.!?;。！？；])\\s*$', '\\1'))), lambda x: x <> '') as s from ln)),
pc as (select entry_id, j, k, unnest(c) as s, generate_subscripts(c, 1) as m from (select entry_id, j, k, regexp_extract_all(s, '.{{1,420}}', 0, 's') as c from sn)),
pieces as (select entry_id, s, length(s) as n, row_number() over (partition by entry_id order by j, k, m) as i from pc),
pack as (select entry_id, i, 0 as c, n as now from pieces where i = 1 union all select p.entry_id, x.i, case when p.now + 1 + x.n <= 420 then p.c else p.c + 1 end, case when p.now + 1 + x.n <= 420 then p.now + 1 + x.n else x.n end from pack p join pieces x on x.entry_id = p.entry_id and x.i = p.i + 1),
c0 as (select entry_id, c, string_agg(s, ' ' order by i) as s from pack join pieces using (entry_id, i) group by entry_id, c),
c1 as (select entry_id, case when c > 0 and c = max(c) over (partition by entry_id) and length(s) < 18 then c - 1 else c end as c, c as o, s from c0),
c2 as (select entry_id, c, string_agg(s, ' ' order by o) as s from c1 group by entry_id, c),
c3 as (select entry_id, s, length(s) as n, regexp_matches(lower(trim(s)), '^(?:{_leaders})') as leads, row_number() over (partition by entry_id order by c) as i from c2),
glue as (select entry_id, i, 0 as c, n as now from c3 where i = 1 union all select g.entry_id, x.i, case when x.leads and g.now + 1 + x.n <= 630 then g.c else g.c + 1 end, case when x.leads and g.now + 1 + x.n <= 630 then g.now + 1 + x.n else x.n end from glue g join c3 x on x.entry_id = g.entry_id and x.i = g.i + 1),
body as (select entry_id, c as chunk, string_agg(s, ' ' order by i) as text from glue join c3 using (entry_id, i) group by entry_id, c),
chunks as (select *, ('0x' || substr(md5(concat_ws(chr(31), entry_id, chunk, retrieval_text)), 1, 15))::bigint as hash from (select e.*, chunk, text, '[' || coalesce(title, '') || '] ' || text as retrieval_text from body join entries e using (entry_id)))"""

twin("h10_split_chunks", f"with {CHUNKS} select entry_id, cast(chunk as integer) as chunk, cast(length(text) as integer) as length, md5(text) as h from chunks")
twin("g9_entry_manifest", f"with {CHUNKS} select entry_id, count(*) as chunks, ('0x' || substr(md5(string_agg(hash::varchar, ',' order by chunk)), 1, 15))::bigint as signature from chunks group by entry_id")
twin("g10_corpus_fingerprint", f"with {CHUNKS} select bit_xor(hash) as fingerprint, count(*) as n from chunks")
twin("g26_index_summary", f"with {CHUNKS} select world_id, count(distinct entry_id) as entries, count(*) as chunks, count(*) filter (constant) as constant_chunks from chunks group by world_id")

# One world for each of the newest user turns.
_like = "case when least({n}, {m}) = 0 and q <> {t} and not (least(length(q), length({t})) >= 8 and (contains(q, {t}) or contains({t}, q))) then 0.0 when length(q) = 0 or length({t}) = 0 then 0.0 when q = {t} then 1.0 when least(length(q), length({t})) >= 8 and (contains(q, {t}) or contains({t}, q)) then least(0.99, 0.88 + 0.11 * least(length(q), length({t})) / greatest(length(q), length({t}))) else greatest({i} / ({n} + {m} - {i}), 0.92 * {i} / least({n}, {m})) end"
SETTING = f"""with {CHUNKS}, {DOCS}, sq as (select conv_id as query_id, 'src' || (conv_id % 20) as world_id, {NORM.format('text')} as q, {TOK.format('text')} as qt from query),
sc as (select world_id, entry_id, chunk, constant, secret, ord, {NORM.format('text')} as b, {NORM.format('retrieval_text')} as r, {TOK.format('text')} as bt, {TOK.format('retrieval_text')} as rt from chunks where not disabled),
sp as (select *, len(qt) as n, len(bt) as mb, len(rt) as mr, len(list_intersect(qt, bt)) as ib, len(list_intersect(qt, rt)) as ir from sq join sc using (world_id)),
ss as (select *, greatest({_like.format(n='n', m='mb', t='b', i='ib')}, 0.88 * {_like.format(n='n', m='mr', t='r', i='ir')}) + case when constant then 0.015 else 0 end as score from sp where ib + ir > 0),
sr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, constant desc, ord asc nulls last, entry_id, chunk) - 1 as rank from ss where score >= 0.05)"""
twin("t2_setting_lexical", SETTING + " select query_id, entry_id, cast(chunk as integer) as chunk, round(score, 6) as score, cast(rank as integer) as rank from sr where rank < 12")

# Scenes end where the place changes; four turns to a place leave no scene too long.
SCENES = f"""with {TURNS}, sc0 as (select conv_id, turn, turn // 4 as place, left(text, 30) as summary from t where role = 'assistant' and trim(left(text, 30)) <> ''),
scn as (select conv_id, dense_rank() over (partition by conv_id order by place) - 1 as scene, turn, 'p' || place as location, summary from sc0),
scenes as (select conv_id, scene, count(*) as n, min(turn) as first_turn, max(turn) as last_turn, arg_max(location, turn) as location, left(string_agg(summary, ' ' order by turn), 1400) as outcome from scn group by conv_id, scene)"""
twin("g11_scene_sessions", SCENES + " select conv_id, cast(scene as integer) as scene, n, first_turn, last_turn, location, outcome from scenes")
twin("t12_select_scenes", SCENES + """, lq as (select conv_id, list_distinct(regexp_extract_all(lower(arg_max(text, turn)), '[a-z0-9_]{2,}')) as q from t group by conv_id),
sh as (select conv_id, scene, len(list_intersect(list_distinct(regexp_extract_all(lower(outcome), '[a-z0-9_]{2,}')), q)) as shared, scene = max(scene) over (partition by conv_id) as latest from scenes join lq using (conv_id)),
rk as (select *, row_number() over (partition by conv_id order by latest desc, shared desc, scene desc) as rank from sh) select conv_id, cast(scene as integer) as scene, cast(shared as integer) as shared, cast(rank as integer) as rank from rk where rank <= 3 and (rank = 1 or shared > 0)""")

# H9: the sentence that names most of a text's first words.
twin("h9_evidence_excerpt", f"""with d as (select doc_id as id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;\\n.]*[。！？!?；;\\n.]|[^。！？!?；;\\n.]+$'), lambda x: trim(x, chr(32) || chr(10) || chr(9))), lambda x: x <> '') as p, list_distinct_ordered as needles from
 (select *, list_transform(list_sort(list_transform(list_distinct(tk), lambda w: {{'i': list_position(tk, w), 'w': w}})), lambda z: z.w)[1:4] as list_distinct_ordered from (select *, {TOKENS.format('text')} as tk from documents))),
x as (select id, p, needles, unnest(p) as piece, generate_subscripts(p, 1) as i from d), s as (select *, list_sum(list_transform(needles, lambda w: case when contains(lower(piece), w) then least(4.0, greatest(1.0, length(w) / 2)) else 0.0 end)) as s from x),
b as (select id, arg_max({{'p': p, 'i': i}}, {{'s': s, 'i': -i}}) as b from s where s > 0 group by id), c as (select id, b.p as p, b.i as i, concat_ws(' ', b.p[b.i], b.p[b.i + 1]) as two from b),
a as (select id, case when i > 1 and length(two) < 216 then p[i - 1] || ' ' || two else two end as a from c) select id, case when length(a) <= 360 then a else trim(left(a, 359)) || '…' end as excerpt from a""")

# Labelled queries and their views.
LABELLED = VERSIONS + """, lt as (select conv_id, arg_max(text, turn) filter (role = 'user') as u, arg_max(text, turn) filter (role = 'assistant') as a from conversations where role <> 'system' group by conv_id),
st as (select conv_id, string_agg(distinct slot || ': ' || text, chr(10) order by slot || ': ' || text) filter (kind in ('commitment', 'intention')) as g, string_agg(distinct slot, ', ' order by slot) as s from versions where status = 'active' group by conv_id),
lq as (select lt.conv_id, u, a, s, g, concat_ws(chr(10) || chr(10), case when trim(coalesce(u, '')) <> '' then '[LAST USER]' || chr(10) || u end, case when trim(coalesce(a, '')) <> '' then '[PREVIOUS ASSISTANT]' || chr(10) || a end,
 case when trim(coalesce(s, '')) <> '' then '[CURRENT STATE SLOTS]' || chr(10) || s end, case when trim(coalesce(g, '')) <> '' then '[OPEN COMMITMENTS / OBJECTIVES]' || chr(10) || g end) as text from lt left join st using (conv_id))"""
twin("h15_generation_query", LABELLED + " select conv_id, text from lq")
twin("h16_query_views", LABELLED + """, v as (select conv_id, unnest([{'i': 0, 'view': 'focus', 't': u, 'w': 1.0}, {'i': 1, 'view': 'assistant_context', 't': a, 'w': 0.72}, {'i': 2, 'view': 'entity_scene', 't': s, 'w': 0.88}, {'i': 3, 'view': 'state_objective', 't': g, 'w': 0.66}]) as v from lq),
w as (select conv_id, v.i as i, v.view as view, trim(v.t, chr(32) || chr(10)) as text, v.w as weight from v where trim(coalesce(v.t, ''), chr(32) || chr(10)) <> '')
select conv_id, view, text, weight::double as weight from w qualify row_number() over (partition by conv_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) order by i) = 1""")

# Both blocks within one budget of 4200 characters; the layers' shares of 3000 are 750, 1350 and 900.
_est = lambda c: f"case when length({c}) = 0 then 0 else greatest(1, ceil(0.2441 * length({c}))) end"
_ASSEMBLED = f"with {CHUNKS}, {BM25.removeprefix('with ')}, {BLOCK.removeprefix('with ')}" + f""", best as (select conv_id, id, row_number() over (partition by conv_id order by round(score, 9) desc, id desc) - 1 as rank from s qualify rank < 6),
rw as (select query.conv_id, 0 as layer, entry_id as rank, 'setting:' || entry_id as id, retrieval_text as text from query join chunks on world_id = 'src' || (query.conv_id % 20) and chunk = 0 and constant and not disabled and not secret
 union all select conv_id, 1, rank, 'turn:' || id, text from best join docs using (conv_id, id) union all select conv_id, 2, row_number() over (partition by conv_id order by id desc), 'turn:' || id, text from docs where (conv_id, id) not in (select conv_id, id from best) /* more */),
ro as (select *, length(text) + 1 as z, ([750, 2100, 3000])[layer + 1] as share, row_number() over (partition by conv_id order by layer, rank, id) as r from rw),
rp as (select conv_id, r, z <= share as fits, case when z <= share then z else 0 end as used from ro where r = 1 union all select rp.conv_id, o.r, rp.used + o.z <= o.share, rp.used + case when rp.used + o.z <= o.share then o.z else 0 end from rp join ro o on o.conv_id = rp.conv_id and o.r = rp.r + 1),
rf as (select conv_id, coalesce(string_agg(text, chr(10) order by r) filter (fits), '') as ref, coalesce(string_agg(id, ',' order by r) filter (fits), '') as chosen, count(*) filter (not fits) as dropped from rp join ro using (conv_id, r) group by conv_id),
bb as (select query.conv_id, coalesce(case when length(block) > 1200 then left(block, 1200 - length('{CUT}') - 1) || chr(10) || '{CUT}' else block end, '') as blk, coalesce(ref, '') as ref, coalesce(chosen, '') as chosen, coalesce(dropped, 0) as dropped from query left join rf using (conv_id) left join b using (conv_id)),
oo as (select conv_id, left(blk, least(length(blk), 1200)) as state_block, left(ref, least(length(ref), 3000, 4200 - least(length(blk), 1200))) as reference_block, chosen, dropped, 4200 as cap from bb)
select *, ({_est('state_block')} + {_est('reference_block')})::bigint as tokens from oo"""
twin("t18_assemble", _ASSEMBLED.replace(" /* more */", ""))

# Greedy with what is left as the state of an ordered pass.
twin("t14_budget_skip", f"""with recursive {DOCS}, o as (select conv_id, id, length(text) as n, row_number() over (partition by conv_id order by id desc) as r from docs),
p as (select conv_id, id, r, n, n <= 600 as fits, case when n <= 600 then n else 0 end as used from o where r = 1 union all select p.conv_id, o.id, o.r, o.n, p.used + o.n <= 600, p.used + case when p.used + o.n <= 600 then o.n else 0 end from p join o on o.conv_id = p.conv_id and o.r = p.r + 1)
select conv_id, id, cast(r as integer) as rank, n as size from p where fits""")
twin("t14_budget_layers", f"""with recursive {TURNS}, o as (select conv_id, turn as id, turn % 3 as layer, length(text) as n, ([375, 1050, 1500])[turn % 3 + 1] as cap, row_number() over (partition by conv_id order by turn % 3, turn desc) as r from t),
p as (select conv_id, id, layer, r, n, n <= cap as fits, case when n <= cap then n else 0 end as used from o where r = 1 union all select p.conv_id, o.id, o.layer, o.r, o.n, p.used + o.n <= o.cap, p.used + case when p.used + o.n <= o.cap then o.n else 0 end from p join o on o.conv_id = p.conv_id and o.r = p.r + 1)
select conv_id, cast(layer as integer) as layer, id, n as size from p where fits""")


def _mmr(k: int = 6) -> str:
    """T10 unrolled: a choice a round."""
    sql = RERANK + f""", mt as (select rr.query_id, rr.id, rr.rerank_score as s, list_distinct({TOKENS.format('docs.text')}) as tk from rr join docs on docs.conv_id = rr.query_id and docs.id = rr.id),
mm as (select *, s / greatest(max(s) over (partition by query_id), 1e-9) as rel from mt),
sim as (select a.query_id, a.id as a, b.id as b, case when len(a.tk) > 0 and len(b.tk) > 0 then len(list_intersect(a.tk, b.tk)) / (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk))) else 0 end as j from mm a join mm b on a.query_id = b.query_id and a.id <> b.id),
k0 as (select query_id, id, 0 as rank, 0.0 as mmr from mm where false)"""
    for i in range(1, k + 1):
        sql += f""", v{i} as (select m.query_id, m.id, m.s, round(0.78 * m.rel - 0.22 * coalesce(max(s.j), 0), 12) as v from mm m left join (select sim.* from sim join k{i - 1} k on k.query_id = sim.query_id and k.id = sim.b) s on s.query_id = m.query_id and s.a = m.id
 where not exists (select 1 from k{i - 1} k where k.query_id = m.query_id and k.id = m.id) group by m.query_id, m.id, m.s, m.rel),
k{i} as (select * from k{i - 1} union all (select query_id, id, {i}, v from v{i} qualify row_number() over (partition by query_id order by v desc, s desc, id) = 1))"""
    return sql + f" select query_id, id, cast(rank as integer) as rank, round(mmr, 6) as mmr from k{k}"


twin("t10_mmr_select", _mmr())

# chunks' ranks fused and collapsed to entries.
twin("r8_retrieve_settings", SETTING + """, rp as (select query_id, entry_id, 0.9 / (61 + rank) as part, secret, row_number() over (partition by query_id, entry_id order by rank) as r from sr where rank < 12),
re as (select query_id, entry_id, sum(part * case r when 1 then 1 when 2 then 0.25 when 3 then 0.1 else 0 end) as score, count(*) as chunks from rp where not secret group by query_id, entry_id)
select query_id, entry_id, round(score, 6) as score, chunks, cast(row_number() over (partition by query_id order by round(score, 9) desc, entry_id) as integer) as rank from re qualify rank <= 5""")

# The first and last four words of the user's turn as a lookup over all turns of the conversation.
twin("j12_resolve_lookups", f"""with {TURNS}, lw as (select *, lag(role) over z as br, lag(text) over z as bx from t window z as (partition by conv_id order by turn)),
rq as (select conv_id, turn as msg, string_split(bx, ' ') as w from lw where role = 'assistant' and br = 'user' and bx <> ''),
qt as (select conv_id, msg, regexp_extract_all(lower(array_to_string(w[1:4], ' ') || ' ' || array_to_string(w[greatest(1, len(w) - 3):], ' ')), '[a-z0-9_]{{2,}}') as k from rq),
tok as (select conv_id, turn as id, {TOKENS.format('text')} as k from t), p as (select conv_id, id, len(k) as dl, unnest(k) as token from tok), post as (select conv_id, id, token, count(*) as tf, max(dl) as dl from p group by all),
per as (select conv_id, count(*) as n, avg(greatest(1, len(k))) as al from tok group by conv_id), df as (select conv_id, token, count(*) as df from post group by all), q as (select conv_id, msg, token, count(*) as qtf from (select conv_id, msg, unnest(k) as token from qt) group by all),
s as (select q.conv_id, msg, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(1.0, al))) * least(2, qtf)) as score from post join df using (conv_id, token) join per using (conv_id) join q using (conv_id, token) group by all),
b as (select * from s qualify row_number() over (partition by conv_id, msg order by round(score, 9) desc, id desc) <= 2) select b.conv_id, msg, 0 as n, id, 'live' as source, md5(text) as text from b join t on t.conv_id = b.conv_id and t.turn = b.id""")


def _recall(k: int = 6, rounds: int = 5, docs: str = DOCS, tail: str = "") -> str:
    """Channels, fusion, diffusion, features, re-ranking and diversity of the newest user turns' memories."""
    first = lambda text, rx: f"list_transform(list_sort(list_transform(list_distinct(regexp_extract_all({text}, '{rx}')), lambda w: {{'i': list_position(regexp_extract_all({text}, '{rx}'), w), 'w': w}})), lambda z: z.w)[1:4]"
    tight = lambda c: f"replace({SQUEEZE.format(c)}, ' ', '')"
    scaled = ", ".join(f"case when max({c}) over w - min({c}) over w < 1e-9 then 0.5 else ({c} - min({c}) over w) / (max({c}) over w - min({c}) over w) end as n_{c}" for c in ("score", "coverage", "phrase", "slot", "entity", "recency", "importance", "breadth"))
    sql = f"""with {docs}, nw as (select conv_id, max(id) + 1 as as_of from docs group by conv_id), qq as (select conv_id, text as q, as_of from query join nw using (conv_id)),
me as (select conv_id, id, text, (['state','knowledge','commitment','relation','event'])[id % 5 + 1] as kind, (['low','medium','high','critical'])[(id // 2) % 4 + 1] as importance, 'slot.' || (id % 5) as slot_name,
 {first('text', '\\p{Lu}[\\p{L}\\p{N}]{3,}')} as es, {first('lower(text)', '\\p{L}{9,}')} as ts, case when id % 7 = 3 then 'closed' else 'active' end as status, id % 3 as reinforcement, id % 8 <> 5 as evidenced, case when id % 9 = 4 then id + 1 end as recalled from docs),
op as (select * from me where trim(text) <> '' and (evidenced or importance not in ('low', 'medium') or kind = 'state')),
tok as (select conv_id, id, {TOKENS.format("concat_ws(' ', text, array_to_string(es, ' '), array_to_string(ts, ' '))")} as k from op), pt as (select conv_id, id, len(k) as dl, unnest(k) as token from tok),
post as (select conv_id, id, token, count(*) as tf, max(dl) as dl from pt group by all), per as (select conv_id, count(*) as n, avg(greatest(1, len(k))) as al from tok group by conv_id), dfr as (select conv_id, token, count(*) as df from post group by all),
qt as (select conv_id, token, count(*) as qtf from (select conv_id, unnest({TOKENS.format('q')}) as token from qq) group by all),
bm as (select post.conv_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(1.0, al))) * least(2, qtf)) as score from post join dfr using (conv_id, token) join per using (conv_id) join qt using (conv_id, token) group by post.conv_id, id),
mn as (select conv_id, id, len(list_filter(list_distinct(list_transform(es, lambda e: {tight('e')})), lambda e: length(e) >= 2 and contains({tight('q')}, e))) as ne, len(list_filter(list_distinct(list_transform(ts, lambda e: {SQUEEZE.format('e')})), lambda e: length(e) >= 2 and contains({SQUEEZE.format('q')}, e))) as nt from op join qq using (conv_id)),
lx as (select conv_id, id, coalesce(score, 0) + case when ne > 0 then 3.2 + 0.8 * least(3, ne - 1) else 0 end + least(2.4, 0.8 * nt) as s, ne > 0 as named from mn left join bm using (conv_id, id)),
lr as (select *, row_number() over (partition by conv_id order by round(s, 9) desc, id desc) - 1 as rank from lx where s > 0 qualify rank < 24),
bonus as (select * from (values ('low', 0.0, 0.3), ('medium', 0.012, 0.6), ('high', 0.026, 1.0), ('critical', 0.045, 0.6)) v(importance, plus, level)),
sr as (select conv_id, id, row_number() over (partition by conv_id order by round(0.3 + 0.5 * greatest(0, 1 - (as_of - id) / 512) + plus, 9) desc, id desc) - 1 as rank from me join qq using (conv_id) join bonus using (importance) where status = 'active' and id <= as_of qualify rank < 8),
ve as (select embedding::double[] as e, row_number() over (order by vec_id) as n from embeddings), nv as (select count(*) as size from embeddings),
dp as (select me.conv_id, me.id, list_cosine_similarity(a.e, b.e) as s from me join qq using (conv_id) cross join nv join ve a on a.n = (me.conv_id * 31 + as_of * 7) % size + 1 join ve b on b.n = (me.conv_id * 31 + me.id * 7) % size + 1),
dn as (select dp.conv_id, dp.id, dp.rank from (select *, row_number() over (partition by conv_id order by round(s, 9) desc, id) - 1 as rank from dp qualify rank < 18 and s >= -0.1) dp semi join op on op.conv_id = dp.conv_id and op.id = dp.id),
ch as (select conv_id, id, 'dense1' as channel, 1.0 / (61 + rank) as part, false as named from dn union all select conv_id, id, 'structured', 0.8 / (61 + rank), false from sr
 union all select conv_id, id, 'lexical', 0.9 / (61 + rank), named from lr where named or (conv_id, id) in (select conv_id, id from dn)),
fu as (select conv_id, id, sum(part) as part, string_agg(channel, ',' order by channel) as channels, count(*) as nch, (bool_or(named) and not bool_or(channel = 'dense1'))::int as entity from ch group by conv_id, id),
f as (select conv_id as query_id, id, channels, nch, entity, (part + 0.006 * entity + plus + least(0.025, 0.003 * reinforcement)) * case when evidenced then 1 else 0.82 end * case when as_of - recalled between 1 and 4 then 0.42 + 0.58 * (as_of - recalled) / 5 else 1 end as score from fu join me using (conv_id, id) join bonus using (importance) join qq using (conv_id)),
tm as (select distinct conv_id, id, kd, {SQUEEZE.format('term')} as term from (select conv_id, id, 'e' as kd, unnest(es) as term from me union all select conv_id, id, 't', unnest(ts) from me)),
sz as (select conv_id, count(*) as n from me group by conv_id), ra as (select conv_id, kd, term, case when kd = 'e' and df / n <= 0.45 then 1.25 * ln(1 + n / df) when kd = 't' and df / n <= 0.6 then ln(1 + n / df) end as w from (select conv_id, kd, term, count(*) as df from tm where term <> '' group by all) join sz using (conv_id)),
ow as (select f.query_id, f.id, tm.kd, tm.term, ra.w from f join tm on tm.conv_id = f.query_id and tm.id = f.id join ra on ra.conv_id = tm.conv_id and ra.kd = tm.kd and ra.term = tm.term where ra.w is not null),
ed as (select a.query_id, a.id as a, b.id as b, sum(least(a.w, b.w)) as w from ow a join ow b on a.query_id = b.query_id and a.kd = b.kd and a.term = b.term and a.id < b.id group by all),
bo as (select query_id, a, b, w from ed union all select query_id, b, a, w from ed), sh as (select query_id, a, b, w / sum(w) over (partition by query_id, a) as share from bo),
p0 as (select f.query_id, f.id, f.score, f.score / sum(f.score) over (partition by f.query_id) as base, f.score / sum(f.score) over (partition by f.query_id) as p, exists (select 1 from sh where sh.query_id = f.query_id and sh.a = f.id) as linked from f)"""
    for i in range(rounds):
        sql += f""", g{i} as (select s.query_id, s.b as id, sum(p.p * s.share) as got from p{i} p join sh s on s.query_id = p.query_id and s.a = p.id group by all),
p{i + 1} as (select p.query_id, p.id, p.score, p.base, 0.82 * p.base + 0.18 * case when p.linked then coalesce(g.got, 0) else p.p end as p, p.linked from p{i} p left join g{i} g using (query_id, id))"""
    sql += f""", ds as (select query_id, id, 0.88 * score + 0.12 * greatest(max(score) over w, 1e-9) * p / greatest(max(p) over w, 1e-9) as score from p{rounds} window w as (partition by query_id)),
x as (select ds.query_id as conv_id, ds.id, {SQUEEZE.format('q')} as q, lower(trim(case when len(es) + len(ts) > 0 then '[' || concat_ws(' — ', nullif(array_to_string(es, ', '), ''), nullif(array_to_string(ts, ', '), '')) || '] ' else '' end || trim(me.text))) as n0, slot_name from ds join me on me.conv_id = ds.query_id and me.id = ds.id join qq on qq.conv_id = ds.query_id),
y as (select conv_id, id, slot_name, trim(regexp_replace(n0, '\\s+', ' ', 'g')) as n, list_distinct({WORDS.format('q')}) as qd, {WORDS.format('q')} as qw from x),
ft as (select conv_id as query_id, id, case when len(qd) > 0 then coalesce(list_sum(list_transform(list_intersect(qd, {WORDS.format('n')}), lambda w: length(w))), 0) / list_sum(list_transform(qd, lambda w: length(w))) else 0 end as coverage,
 case when len(qd) > 0 then coalesce(list_sum(list_transform(list_intersect(qd, {WORDS.format('slot_name')}), lambda w: length(w))), 0) / list_sum(list_transform(qd, lambda w: length(w))) else 0 end as slot,
 case when len(qw) > 1 then least(1.0, len(list_filter(list_distinct(list_transform(range(1, len(qw)), lambda i: qw[i] || '[^\\p{{L}}\\p{{N}}]{{0,2}}' || qw[i + 1])), lambda p: regexp_matches(n, p))) / (len(qw) - 1)) else 0 end as phrase from y),
fz as (select ds.query_id, ds.id, ds.score, f.channels, f.entity, coverage, slot, phrase, exp(-ln(2) * greatest(as_of - ds.id, 0) / 120.0) as recency, level as importance, least(1.0, nch / 3.0) as breadth from ds join f using (query_id, id) join ft using (query_id, id) join me on me.conv_id = ds.query_id and me.id = ds.id join bonus using (importance) join qq on qq.conv_id = ds.query_id),
nz as (select *, {scaled} from fz window w as (partition by query_id)),
rr as (select *, 0.45 * n_score + 0.55 * least(1, greatest(0, 0.5 + 2 * (0.30 * (n_coverage - 0.5) + 0.18 * (n_phrase - 0.5) + 0.12 * (n_slot - 0.5) + 0.12 * (n_entity - 0.5) + 0.12 * (n_recency - 0.5) + 0.08 * (n_importance - 0.5) + 0.08 * (n_breadth - 0.5)))) + case when entity > 0 then 0.05 else 0 end as rerank_score from nz),
rk as (select *, row_number() over (partition by query_id order by round(rerank_score, 9) desc, round(score, 9) desc, id) as place from rr qualify place <= 30),
mm as (select rk.query_id, rk.id, rk.score, rk.rerank_score, rk.channels, rk.place, rk.score / greatest(max(rk.score) over (partition by rk.query_id), 1e-9) as rel, list_distinct(list_concat(list_transform(ts, lambda z: 't:' || {SQUEEZE.format('z')}), list_transform({TOKENS.format('text')}, lambda z: 'x:' || z))) as tk from rk join me on me.conv_id = rk.query_id and me.id = rk.id),
sim as (select a.query_id, a.id as a, b.id as b, case when len(a.tk) > 0 and len(b.tk) > 0 then len(list_intersect(a.tk, b.tk)) / (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk))) else 0 end as j from mm a join mm b on a.query_id = b.query_id and a.id <> b.id),
k0 as (select query_id, id, 0 as rank, 0.0 as mmr from mm where false)"""
    for i in range(1, k + 1):
        sql += f""", v{i} as (select m.query_id, m.id, m.place, round(0.78 * m.rel - 0.22 * coalesce(max(s.j), 0), 12) as v from mm m left join (select sim.* from sim join k{i - 1} k on k.query_id = sim.query_id and k.id = sim.b) s on s.query_id = m.query_id and s.a = m.id
 where not exists (select 1 from k{i - 1} k where k.query_id = m.query_id and k.id = m.id) group by m.query_id, m.id, m.place, m.rel),
k{i} as (select * from k{i - 1} union all (select query_id, id, {i}, v from v{i} qualify row_number() over (partition by query_id order by v desc, place) = 1))"""
    if tail:
        return sql + tail.format(k=k)
    return sql + f" select query_id, id, cast(rank as integer) as rank, round(score, 6) as score, round(rerank_score, 6) as rerank_score, round(mmr, 6) as mmr, channels from k{k} join mm using (query_id, id)"


twin("r7_recall", _recall())

# The same path over three questions of each conversation.
_OWN = _recall(docs=DOCS.replace("docs as", "docs0 as").replace("query as", "query0 as") + """,
pl as (select *, row_number() over (partition by conv_id order by id) as place, count(*) over (partition by conv_id) as n, regexp_extract_all(text, '[\\p{L}\\p{N}]+') as w from docs0),
docs as (select conv_id * 3 + k as conv_id, id, text from docs0, range(3) r(k)),
asked as (select conv_id * 3 + k as conv_id, id as gold, case k when 0 then substr(text, 1, 60) when 1 then array_to_string(list_filter(w[1:30], lambda x, i: i % 3 = 1), ' ')
 else array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'n': -length(x), 'x': x}))[1:3], lambda z: z.x), ' ') end as text
 from pl, range(3) r(k) where place = case k when 0 then 1 when 1 then (n + 1) // 2 else n end),
query as (select conv_id, text from asked)""", tail=""" select asked.conv_id as query_id, gold, r.rank is not null as hit, round(coalesce(1.0 / r.rank, 0), 6) as reciprocal_rank
 from asked left join k{k} r on r.query_id = asked.conv_id and r.id = asked.gold""")
for _a, _b in (("(['low','medium','high','critical'])[(id // 2) % 4 + 1] as importance", "'medium' as importance"), ("case when id % 7 = 3 then 'closed' else 'active' end as status", "'active' as status"), ("id % 3 as reinforcement", "0 as reinforcement"),
               ("id % 8 <> 5 as evidenced", "true as evidenced"), ("case when id % 9 = 4 then id + 1 end as recalled", "null::bigint as recalled")):
    assert _a in _OWN, _a
    _OWN = _OWN.replace(_a, _b)
twin("g27_selfcheck", _OWN)

# Records of sources, from the same chunks.
twin("h12_baseline_records", "with " + CHUNKS.split("\nc3 as")[0] + "\nchunks as (select entry_id, c as chunk, s as text from c2) " + record_queries.H12)

# All layers; cumulated shares of 3000.
_MORE = f""" union all select conv_id, 3, level * 1000000 - node, concat_ws('/', 'summary', level, node), 'summary of ' || first_turn || ' to ' || last_turn from ({ORACLE_SQL['t16_summary_pack']}) join ({ORACLE_SQL['g13_summary_tree']}) using (conv_id, level, node)
 union all select conv_id, 4, rank, 'scene/' || scene, outcome from ({ORACLE_SQL['t12_select_scenes']}) join ({ORACLE_SQL['g11_scene_sessions']}) using (conv_id, scene)
 union all select conv_id, 5, row_number() over (partition by conv_id order by scene, line), 'evidence/' || row_number() over (partition by conv_id order by scene, line), line from ({ORACLE_SQL['j16_scene_evidence']})
 union all select conv_id, 6, msg * 1000000 + id, concat_ws('/', 'lookup', msg, id), text from ({ORACLE_SQL['j12_resolve_lookups']})"""
twin("t18_assemble_all", _ASSEMBLED.replace(" /* more */", _MORE).replace("([750, 2100, 3000])", "([600, 1500, 2100, 2400, 2640, 2820, 3000])"))

# R7 with two views, for one actor.
_VIEWS = _recall(docs=DOCS.replace("docs as", "docs0 as") + ", docs as (select * from docs0 where id % 11 <> 6 and id % 13 <> 7)")
_DN2 = """dp2 as (select me.conv_id, me.id, list_cosine_similarity(a.e, b.e) as s from me join qq using (conv_id) join (select conv_id from ({views}) where view = 'context') using (conv_id) cross join nv join ve a on a.n = (me.conv_id * 31 + (as_of + 3) * 7) % size + 1 join ve b on b.n = (me.conv_id * 31 + me.id * 7) % size + 1),
dn2 as (select dp2.conv_id, dp2.id, dp2.rank from (select *, row_number() over (partition by conv_id order by round(s, 9) desc, id) - 1 as rank from dp2 qualify rank < 18 and s >= -0.1) dp2 semi join op on op.conv_id = dp2.conv_id and op.id = dp2.id),
ch as (select conv_id, id, 'dense2' as channel, 0.82 / (61 + rank) as part, false as named from dn2 union all """.replace("{views}", ORACLE_SQL["w3_query_views"])
_VIEWS = _VIEWS.replace("ch as (", _DN2, 1).replace("(select conv_id, id from dn)", "(select conv_id, id from dn union select conv_id, id from dn2)").replace("bool_or(channel = 'dense1')", "bool_or(channel like 'dense%')")
twin("r7_recall_views", _VIEWS)
