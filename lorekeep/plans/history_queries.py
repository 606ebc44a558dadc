"""Queries over histories: identities of branches, first changed rows, stale records; logs of one long conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H, segments
from .driver import turns
from .oplog_queries import VERSIONS, state_ops
from .registry import query

_PIECE = "list_reduce(list_transform(string_split(substr(h, {0}, 8), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, b: a * 16 + b, 0::bigint)"
#: Chained digests of a table rows_ (conv_id, turn, role, text), for DuckDB.
CHAIN = f"""rowed as (select conv_id, turn, role, sha256(length(role) || ':' || role || ':' || text) as d from rows_),
placed as (select *, row_number() over (partition by conv_id order by turn, d) as pos from rowed),
hashed as (select conv_id, pos, sha256(pos || ':' || d) as h from placed),
sums as (select conv_id, count(*) as n_rows, {', '.join(f"sum({_PIECE.format(8 * k + 1)})::bigint % 4294967296 as s{k}" for k in range(4))} from hashed group by conv_id)"""


@query("g15_branch_id", f"with rows_ as (select conv_id, turn, role, text from conversations where role <> 'system'), {CHAIN} select conv_id, n_rows, printf('%08x%08x%08x%08x', s0, s1, s2, s3) as branch_id from sums")
def g15(spark, d):
    return H.branch_ids(H.chain(turns(spark, d)))


def two_histories(spark, d):
    """Histories that differ by a rule on the conversation's number: nothing, later rows, an edit, a deletion, another reply, an insertion."""
    t = turns(spark, d)
    c, turn = F.col("conv_id") % 6, F.col("turn")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("last"))
    both = t.join(last, "conv_id")
    old = both.where(~((c == 1) & (turn > 2)) & ~((c == 5) & (turn == 1)))
    changed = (c == 2) & (turn == 1) | (c == 4) & (turn == F.col("last"))
    old = old.withColumn("text", F.when(changed, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))).drop("last")
    return old, t.where(~((c == 3) & (turn == 1)))


_CHANGES = """t as (select conv_id, turn, role, text, max(turn) over (partition by conv_id) as last from conversations where role <> 'system'),
o as (select conv_id, turn, role, case when conv_id % 6 = 2 and turn = 1 or conv_id % 6 = 4 and turn = last then 'old ' || text else text end as text from t where not (conv_id % 6 = 1 and turn > 2) and not (conv_id % 6 = 5 and turn = 1)),
n as (select conv_id, turn, role, text from t where not (conv_id % 6 = 3 and turn = 1)),
ol as (select conv_id, list((role, text) order by turn) as x, list(turn order by turn) as ot from o group by conv_id),
nl as (select conv_id, list((role, text) order by turn) as y, list(turn order by turn) as nt from n group by conv_id),
b as (select conv_id, coalesce(len(x), 0) as n_old, coalesce(len(y), 0) as n_new, coalesce(x, []) as x, coalesce(y, []) as y, ot, nt from ol full join nl using (conv_id)),
p as (select *, list_min(list_filter(range(1, greatest(n_old, n_new) + 1), lambda i: i > n_old or i > n_new or x[i] <> y[i])) as pos from b),
changes as (select conv_id, n_old, n_new, pos, case when pos <= n_new then nt[pos] else ot[pos] end as turn,
  case when n_old = 0 then 'new' when n_new = 0 then 'gone' when pos is null then 'same' when pos > n_old then 'append' when pos > n_new then 'delete'
       when pos = n_old and n_old = n_new and x[pos][1] = 'assistant' and y[pos][1] = 'assistant' then 'swipe' when pos < n_old and x[pos + 1] = y[pos] then 'delete' when pos < n_new and y[pos + 1] = x[pos] then 'insert' else 'edit' end as kind from p)"""


@query("r3_first_change", f"with {_CHANGES} select conv_id, kind, pos, turn, n_old, n_new from changes")
def r3(spark, d):
    """Where each conversation's two histories part, and how."""
    old, new = two_histories(spark, d)
    return H.first_change(H.chain(old), H.chain(new), size=4)


@query("r3_stale_records", f"with {_CHANGES} select o.conv_id, o.turn from o join changes c using (conv_id) where o.role = 'assistant' and c.kind not in ('same', 'append', 'new') and o.turn >= c.turn")
def r3b(spark, d):
    """The records of old assistant rows that a replay must not use."""
    old, new = two_histories(spark, d)
    return H.stale(old.where("role = 'assistant'").select("conv_id", "turn"), H.first_change(H.chain(old), H.chain(new), size=4))


@query("g1_one_long_log", VERSIONS + " select 0::bigint as conv_id, conv_id || '/' || slot as slot, kind, text, valid_from, valid_until, status, reinforcement, confirmed, status = 'active' as owns from versions")
def g1(spark, d):
    """The operations of all conversations as one log, folded in segments by many tasks."""
    o = state_ops(spark, d).withColumns({"slot": F.concat_ws("/", "conv_id", "slot"), "conv_id": F.lit(0).cast("long")}).withColumn("target_slot", F.col("slot"))
    return segments.apply_ops(o, size=2000).select("conv_id", "slot", "kind", "text", "valid_from", "valid_until", "status", "reinforcement", "confirmed", "owns")
