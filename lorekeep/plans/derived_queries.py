"""Queries over digests, trees, scenes, evidence, visibility, identities and incremental plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import derived as D, fold, turns as T
from ..streaming import turns as R
from .conversation_queries import PAIRS, TURNS
from .driver import OPS_SQL, table, turns
from .oplog_queries import VERSIONS, state_ops, versions
from .registry import query


def records(spark, d):
    """A summary for each assistant turn but every fourth."""
    t = turns(spark, d).where("role = 'assistant'")
    return t.select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.left("text", F.lit(40))).otherwise("").alias("event_summary"))


RECORDS = "records as (select conv_id, turn, case when turn % 4 <> 3 then substr(text, 1, 40) else '' end as event_summary from t where role = 'assistant')"
LEVEL1 = "level1 as (select conv_id, turn, 's' || turn as summary_id from t where role = 'assistant')"


def level1(spark, d):
    return turns(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("s"), "turn").alias("summary_id"))


@query("j10_digest", f"with {TURNS}, {RECORDS}, r as (select *, row_number() over w as n, sum(length(event_summary)) over w as chars from records where trim(event_summary) <> '' window w as (partition by conv_id order by turn desc)) select conv_id, turn, event_summary from r where n <= 3 and chars <= 90")
def j10(spark, d):
    return D.digest(records(spark, d), turns(spark, d), max_rows=3, max_chars=90)


FOLD = f"""with {TURNS}, {LEVEL1}, n as (select *, first_value(case when role = 'assistant' then turn end ignore nulls) over (partition by conv_id order by turn rows between current row and unbounded following) as a from t),
c as (select n.conv_id, n.turn, n.a, l.summary_id from n join level1 l on l.conv_id = n.conv_id and l.turn = n.a), g as (select *, dense_rank() over (partition by conv_id order by a desc) as age, max(a) over (partition by conv_id) as newest from c),
folded as (select conv_id, turn, summary_id from g where age > 1 and a < newest)"""


@query("j13_fold_turns", FOLD + " select * from folded")
def j13(spark, d):
    return D.fold_turns(turns(spark, d), level1(spark, d)).drop("fingerprint")


@query("j14_unfold", FOLD + " select * from folded where cast(substr(summary_id, 2) as bigint) % 3 = 0")
def j14(spark, d):
    folded = D.fold_turns(turns(spark, d), level1(spark, d)).drop("fingerprint")
    return D.unfold(folded, level1(spark, d).where("turn % 3 <> 0")).select("conv_id", "turn", "summary_id")


@query("j14_fold_status", FOLD + " select conv_id, count(*) as folded, count(*) filter (turn % 5 = 0) as stale from folded group by conv_id")
def j14b(spark, d):
    now = turns(spark, d).withColumn("text", F.when(F.col("turn") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return D.fold_status(D.fold_turns(turns(spark, d), level1(spark, d)), now)


@query("j14_unfold_all", FOLD + " select * from folded where turn % 5 <> 0")
def j14c(spark, d):
    now = turns(spark, d).withColumn("text", F.when(F.col("turn") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return D.unfold_all(D.fold_turns(turns(spark, d), level1(spark, d)), now).select("conv_id", "turn", "summary_id")


TREE = f"""with {TURNS}, q as (select *, row_number() over (partition by conv_id order by turn) - 1 as i from t),
tree as (select conv_id, 1 as level, i // 2 as node, min(turn) as first_turn, max(turn) as last_turn, count(*) as n_turns from q group by conv_id, i // 2 having count(*) = 2
 union all select conv_id, 2, i // 4, min(turn), max(turn), count(*) from q group by conv_id, i // 4 having count(*) = 4 union all select conv_id, 3, i // 8, min(turn), max(turn), count(*) from q group by conv_id, i // 8 having count(*) = 8)"""


@query("g13_summary_tree", TREE + " select * from tree")
def g13(spark, d):
    return D.summary_tree(turns(spark, d), 2, 2, 2)


def summaries(spark, d):
    """The summaries of each conversation that fit 100 characters."""
    tree = D.summary_tree(turns(spark, d), 2, 2, 2).withColumn("text", F.concat(F.lit("summary of "), "first_turn", F.lit(" to "), "last_turn"))
    return D.summary_pack(tree, 100)


@query("t16_summary_pack", TREE + ", x as (select conv_id, level, node, 'summary of ' || first_turn || ' to ' || last_turn as text from tree), u as (select *, sum(length(text)) over (partition by conv_id, level order by node desc) as used from x) select conv_id, level, node, cast(used as bigint) as used from u where used <= 100 * case level when 1 then 0.42 when 2 then 0.26 else 0.24 end")
def t16(spark, d):
    return summaries(spark, d).select("conv_id", "level", "node", "used")


@query("j17_safe_summaries", TREE + " select * from tree where not exists (select 1 from t where t.conv_id = tree.conv_id and t.turn between first_turn and last_turn and (t.conv_id + t.turn) % 9 = 0)")
def j17(spark, d):
    unsafe = turns(spark, d).where("(conv_id + turn) % 9 = 0").select("conv_id", "turn")
    return D.safe_summaries(D.summary_tree(turns(spark, d), 2, 2, 2), unsafe).select("conv_id", "level", "node", "first_turn", "last_turn", "n_turns")


@query("g14_tree_history", f'with {TURNS}, c as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as p from t), k as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as age from c where p is distinct from role) select conv_id, turn as "at", role as signature, cast(age as integer) as age from k where age <= 3')
def g14(spark, d):
    return D.tree_history(turns(spark, d).select("conv_id", F.col("turn").alias("at"), F.col("role").alias("signature")))


def scenes(spark, d):
    r = turns(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("p"), F.floor(F.col("turn") / 4)).alias("location"), F.lit("b").alias("branch"), F.left("text", F.lit(30)).alias("summary"))
    return D.scene_sessions(r)


@query("g11_scene_sessions")
def g11(spark, d):
    return scenes(spark, d)


@query("t12_select_scenes")
def t12(spark, d):
    s = scenes(spark, d).select("conv_id", "scene", X.tokens_scene(F.col("outcome")).alias("tokens"))
    q = T.latest(turns(spark, d)).select("conv_id", X.tokens_scene(F.col("last_text")).alias("tokens"))
    return D.select_scenes(s, q)


@query("j11_expand_evidence", f"with {TURNS}, m as (select conv_id, turn, case when turn % 3 = 0 then 'edited' else text end as seen from t) select m.conv_id, m.turn as id, case when m.seen = t.text then 'live' when m.turn % 2 = 0 then 'cold' else 'missing' end as source, case when m.seen = t.text then t.text when m.turn % 2 = 0 then t.text end as text, m.seen <> t.text as stale from m join t using (conv_id, turn)")
def j11(spark, d):
    t = turns(spark, d)
    m = t.select("conv_id", F.col("turn").alias("id"), "turn", F.xxhash64(F.when(F.col("turn") % 3 == 0, "edited").otherwise(F.col("text"))).alias("source_hash"))
    return D.expand_evidence(m, t, t.where("turn % 2 = 0"))


@query("h9_evidence_excerpt")
def h9(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return D.evidence_excerpt(t.withColumn("needles", F.slice(F.array_distinct(X.tokens_hybrid(F.col("text"))), 1, 4)))


@query("p9_visible_to", f"with {OPS_SQL} select conv_id, msg, (k % 4 <> 0 and k % 13 <> 0) or (k % 4 = 0 and k % 3 = 1) as shown from ops")
def p9(spark, d):
    o = state_ops(spark, d)
    none = F.array().cast("array<string>")
    audience = F.when(F.col("k") % 4 == 0, F.array(F.concat(F.lit(" Actor"), F.col("k") % 3))).otherwise(none)
    shown = D.visible(audience, none, F.array(F.lit("ACTOR1")), F.array(F.lit("id9")), F.col("k") % 13 == 0)
    return o.select("conv_id", "msg", shown.alias("shown"))


@query("p11_redact_records", f"""with {OPS_SQL}, o as (select *, msg // 3 as rec, k % 4 <> 0 as shown from ops), f as (select conv_id, rec, text, min(msg) filter (shown) as m from o group by all)
select r.conv_id, r.rec as msg, case when hidden = 0 then 'whole' else s end as summary, hidden from (select conv_id, rec, count(*) filter (not shown) as hidden from o group by all) r left join (select conv_id, rec, string_agg(text, '；' order by m) as s from f where m is not null group by all) x using (conv_id, rec) where hidden = 0 or s is not null""")
def p11(spark, d):
    o = state_ops(spark, d).select("conv_id", F.floor(F.col("msg") / 3).alias("msg"), F.col("msg").alias("op_idx"), "text", F.lit("whole").alias("summary"), "k")
    return D.redact_records(o, F.col("k") % 4 != 0)


@query("j15_resolve_entities", f"""with {OPS_SQL}, reg as (select distinct 'Name' || (k % 30) as alias, k % 30 as n, case when k % 30 < 20 then k % 2 end as disc from ops), u as (select n, count(distinct coalesce(disc, 9)) as c from reg group by n)
select msg as row, 'name' || (k % 40) as name, not coalesce((select c = 1 from u where u.n = ops.k % 40), false) as new from ops""")
def j15(spark, d):
    """Names without a discriminator: known if they are unique in the registry."""
    o = state_ops(spark, d)
    n, disc = F.col("k") % 30, F.when(F.col("k") % 30 < 20, F.col("k") % 2)
    reg = o.select(F.lit("w").alias("world_id"), F.concat(F.lit("Name"), n).alias("alias"), disc.cast("string").alias("discriminator"), F.concat_ws("/", F.lit("id"), n.cast("string"), F.coalesce(disc, F.lit(9)).cast("string")).alias("entity_id"))
    names = o.select(F.col("msg").alias("row"), F.lit("w").alias("world_id"), F.concat(F.lit("name"), F.col("k") % 40).alias("name"), F.lit(None).cast("string").alias("discriminator"))
    return D.resolve_entities(names, reg).drop("entity_id")


@query("j20_provenance", f"with {OPS_SQL}, s as (select conv_id, slot as id, 'b' || (k % 3) as branch, msg from ops) select conv_id, id, arg_min(branch, msg) as origin, array_to_string(list_sort(list_distinct(list(branch))), ',') as seen_on from s group by conv_id, id")
def j20(spark, d):
    s = state_ops(spark, d).select("conv_id", F.col("slot").alias("id"), F.concat(F.lit("b"), F.col("k") % 3).alias("branch"), F.col("msg").alias("seen_at"))
    return D.provenance(s).withColumn("seen_on", F.array_join("seen_on", ","))


@query("j19_plan_vector_sync", VERSIONS + ", m as (select conv_id || '/' || slot || '/' || version as id, valid_from, status in ('active', 'closed') and valid_from <= 9000 as ready from versions) select id, case when not ready and valid_from % 2 = 0 then 'delete' when ready and valid_from % 2 <> 0 then 'insert' when ready and valid_from % 3 = 0 then 'replace' else 'keep' end as action from m")
def j19(spark, d):
    """Half of the vectors are stored, every third of those from an older text; values of the newest messages aren't settled."""
    v = versions(spark, d)
    m = v.select(F.concat_ws("/", "conv_id", "slot", "version").alias("id"), F.xxhash64("text").alias("vector_hash"), (F.col("status").isin("active", "closed") & (F.col("valid_from") <= 9000)).alias("ready"), "valid_from")
    stored = m.where("valid_from % 2 = 0").select("id", F.when(F.col("valid_from") % 3 == 0, F.lit(0)).otherwise(F.col("vector_hash")).alias("vector_hash"))
    return D.plan_vector_sync(m, stored)


@query("r1_missing_pairs", PAIRS + ", n as (select *, row_number() over (partition by conv_id order by assistant_turn) as nth from pairs) select conv_id, assistant_turn from n where nth % 2 = 0 and not (conv_id % 3 = 0 and exists (select 1 from pairs p where p.conv_id = n.conv_id and p.user_text = n.user_text and p.assistant_text = n.assistant_text))")
def r1(spark, d):
    """Every second pair is due; a third of the conversations have their records."""
    t = turns(spark, d)
    have = T.pair_keys(T.pair_turns(t)).where("conv_id % 3 = 0")
    return R.missing_pairs(t, have, every=2).select("conv_id", "assistant_turn")


@query("r3_reconcile", VERSIONS + " select conv_id, slot, text, valid_from, valid_until, status from versions where conv_id in (select conv_id from ops where op = 'close')")
def r3(spark, d):
    """Conversations with a changed row are folded anew; here those that hold a closing operation."""
    o = state_ops(spark, d).withColumn("target_slot", F.col("slot"))
    return R.refold(o, o.where("op = 'close'")).select("conv_id", "slot", "text", "valid_from", "valid_until", "status")


@query("r6_recall_counters", f"with {OPS_SQL} select conv_id, slot as id, count(*) as recalled_count, max(msg) as last_recalled from ops where op = 'reinforce' group by conv_id, slot")
def r6(spark, d):
    return R.recall_counters(state_ops(spark, d).where("op = 'reinforce'").select("conv_id", F.col("slot").alias("id"), "msg"))


@query("r12_purge", f"with {TURNS} select conv_id, turn from t where conv_id not in (select conv_id from t where role = 'user' group by conv_id having count(*) > 3)")
def r12(spark, d):
    t = turns(spark, d)
    return R.purge(t, t.where("role = 'user'").groupBy("conv_id").count().where("count > 3")).select("conv_id", "turn")


@query("g2_replay", PAIRS + """, live as (select conv_id, assistant_turn as msg, 'slot' || (assistant_turn % 3) as slot, 'note ' || assistant_turn as text from pairs where assistant_turn % 4 <> 3)
select conv_id, slot, text, msg as valid_from, lead(msg) over w as valid_until, case when lead(msg) over w is null then 'active' else 'closed' end as status from live window w as (partition by conv_id, slot order by msg)""")
def g2(spark, d):
    """An addition per pair; records of every fourth turn belong to a text that was replaced, so they are out."""
    pairs = T.pair_keys(T.pair_turns(turns(spark, d)))
    key = F.when(F.col("assistant_turn") % 4 == 3, F.lit("stale")).otherwise(F.col("pair_key"))
    ex = pairs.select("conv_id", key.alias("pair_key"), "assistant_turn")
    o = ex.select("conv_id", "pair_key", F.col("assistant_turn").alias("msg"), F.lit("add").alias("op"), F.lit("state").alias("kind"), F.concat(F.lit("slot"), F.col("assistant_turn") % 3).alias("slot"), F.concat(F.lit("note "), "assistant_turn").alias("text"))
    return fold.replay(pairs, ex, o).select("conv_id", "slot", "text", "valid_from", "valid_until", "status")


@query("u2_distinct_ordered", "with w as (select conv_id, turn, unnest(string_split(text, ' ')) as w, unnest(range(1, len(string_split(text, ' ')) + 1)) as i from conversations), f as (select conv_id, turn, trim(w) as w, min(i) as i from w where trim(w) <> '' group by conv_id, turn, trim(w)), r as (select *, row_number() over (partition by conv_id, turn order by i) as r from f) select conv_id, turn, string_agg(w, ' ' order by r) as words from r where r <= 5 group by conv_id, turn")
def u2(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.distinct_ordered(F.split("text", " "), 5), " ").alias("words")).where("words <> ''")


TOKS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]{{2,}}'))"


@query("u3_set_sizes", PAIRS + f", s as (select conv_id, assistant_turn, {TOKS.format('user_text')} as a, {TOKS.format('assistant_text')} as b from pairs) select conv_id, assistant_turn, cast(len(list_intersect(a, b)) as integer) as both, cast(len(a) + len(b) - len(list_intersect(a, b)) as integer) as either from s")
def u3(spark, d):
    p = T.pair_turns(turns(spark, d))
    a, b = F.array_distinct(X.tokens_hybrid(F.col("user_text"))), F.array_distinct(X.tokens_hybrid(F.col("assistant_text")))
    return p.select("conv_id", "assistant_turn", F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either"))


@query("u4_except", f"with {TURNS} select distinct conv_id from t where role = 'user' except select conv_id from t where role = 'assistant' and turn > 4")
def u4(spark, d):
    t = turns(spark, d)
    return t.where("role = 'user'").select("conv_id").subtract(t.where("role = 'assistant' and turn > 4").select("conv_id"))
