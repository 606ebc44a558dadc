"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a word target by water-filling: weights 3, 1, 2 (repeating over the sources by code point, null last)
share ``budget`` times all words, no source above ``cap`` times its own words. Every document of a source then expects
target / source_size copies. The whole part is granted; the fractional parts are rounded by a pivotal scheme: two open
documents exchange word mass (chance decides the direction, so each keeps its expected mass) until one is integral.
The words of all documents of a block thus stay as they were, but for one open document. Blocks hold documents of a source and
a size class (a power of two). The open ones of all blocks of a class meet again in fewer blocks, level by level, which is the
reduction tree. Its last step joins the open documents of a source's classes and about ``RESERVE`` of each class that waited
for it, from the largest to the smallest, so that the document that stays open is a small one, as a rule; it goes to the nearer
end, so a source misses its target by half of that document at most.

Defined results: null text or text without words has size 0 and takes 0 words; null sources form one source of their
own; repeated rows are told apart by their rank among equals; an empty table gives an empty result; extra columns of the
input are ignored. Chance comes from hashes of the document's id, rank and level, so reruns agree on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import durable, n_words

WEIGHTS = (3, 1, 2)
#: Documents that meet in one block of a level, about.
FAN_IN = 64
#: Documents of each size class that wait for the last step, about.
RESERVE = 32
#: Rows (of two numbers) that are broadcast at most; beyond that they are joined.
BROADCAST_ROWS = 1_000_000
ITEM = "struct<h:bigint,doc:bigint,nth:bigint,size:bigint,base:bigint,p:double,take:bigint,open:boolean,u:double>"


def source_targets(sizes: DataFrame, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): water-filling over the table of sources."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # the table of sources: one row each, so windows over all of it stay small
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((rank - 1) % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    total = F.sum("source_size").over(every) * F.lit(float(budget))
    # with the sources below this one at their cap, the level that this and the rest would share
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") > F.col("most"))
    shared = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("w"), F.col("level")))).over(every).getField("level")
    target = F.least(F.col("most"), F.coalesce(shared, F.lit(float("inf"))) * F.col("w"))
    return per.select("source", "source_size", target.alias("target"))


def _uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))).cast("double")


def _pivotal(items: str) -> Column:
    """SQL for a sorted array of open items: the same items, all decided but at most one."""
    # A: the carried item gains what the next one loses; B: the other way round. Each keeps its expected mass.
    fixed = "named_struct('h',{0}.h,'doc',{0}.doc,'nth',{0}.nth,'size',{0}.size,'base',{0}.base,'p',{1},'take',({0}.base+{2})*{0}.size,'open',false,'u',{0}.u)"
    still = "named_struct('h',{0}.h,'doc',{0}.doc,'nth',{0}.nth,'size',{0}.size,'base',{0}.base,'p',{1},'take',{0}.take,'open',true,'u',{0}.u)"
    gain_i, loss_i = "((1-s.c.p)*s.c.size)", "(s.c.p*s.c.size)"
    gain_j, loss_j = "((1-x.p)*x.size)", "(x.p*x.size)"
    a, b = f"least({gain_i},{loss_j})", f"least({loss_i},{gain_j})"

    def move(amount, up, up_room, down, down_room):
        """up gains and down loses the amount: whichever reaches its end is decided, the other is carried on."""
        up_p, down_p = f"{up}.p+{amount}/{up}.size", f"{down}.p-{amount}/{down}.size"
        one = f"named_struct('done',array({fixed.format(up, '1D', '1')}),'c',{still.format(down, down_p)})"
        two = f"named_struct('done',array({fixed.format(down, '0D', '0')}),'c',{still.format(up, up_p)})"
        none = f"cast(null as {ITEM})"
        both = f"named_struct('done',array({fixed.format(up, '1D', '1')},{fixed.format(down, '0D', '0')}),'c',{none})"
        return f"case when {up_room}={down_room} then {both} when {up_room}<{down_room} then {one} else {two} end"

    step = f"case when x.u*({a}+{b})<{b} then {move(a, 's.c', gain_i, 'x', loss_j)} else {move(b, 'x', gain_j, 's.c', loss_i)} end"
    state = f"struct<done:array<{ITEM}>,c:{ITEM}>"
    start = f"cast(named_struct('done',cast(array() as array<{ITEM}>),'c',cast(null as {ITEM})) as {state})"
    merge = (
        f"(s,x)->case when s.c is null then cast(named_struct('done',s.done,'c',x) as {state}) else "
        f"transform(array({step}),t->cast(named_struct('done',concat(s.done,t.done),'c',t.c) as {state}))[0] end"
    )
    return F.expr(f"aggregate({items},{start},{merge},s->case when s.c is null then s.done else concat(s.done,array(s.c)) end)")


def mix(documents: DataFrame, budget: float = 1.5, cap: float = 2.0, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """Rows (doc_id, nth, source, size, source_size, target, taken): taken = copies x size; nth: rank among equal rows."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    # equal rows are one item with a count, told apart again by nth
    rows = rows.groupBy("doc", "source", "size").agg(F.count(F.lit(1)).alias("m")).select("doc", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("nth"))
    rows = durable(rows, "mix-sizes")
    targets = durable(source_targets(rows, budget, cap), "mix-targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(share + 1e-12).cast("long")
    per_source = targets.select(F.col("source").alias("s"), whole.alias("base"), F.greatest(share - whole, F.lit(0.0)).alias("p"), "source_size", "target")
    at = rows.join(F.broadcast(per_source), rows["source"].eqNullSafe(per_source["s"])).drop("s")
    at = at.withColumn("open", (F.col("size") > 0) & (F.col("p") > 1e-12)).withColumn("take", F.col("base") * F.col("size"))
    cols = ["source", "class", "doc", "nth", "size", "base", "p", "take"]
    at = at.withColumn("class", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int"))
    done, left = [at.where(~F.col("open")).select(*cols)], at.where("open").select(*cols)
    counts = durable(left.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n")), "mix-classes")  # some twenty rows a source
    sized = left.join(F.broadcast(counts.select(F.col("source").alias("s"), F.col("class").alias("c"), "n")), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).drop("s", "c")
    waits = _uniform(F.lit(seed + 4), F.col("doc"), F.col("nth"), F.col("size")) * F.col("n") < RESERVE
    reserve, left = sized.where(waits).select(*cols), sized.where(~waits).select(*cols)

    def meet(dealt: DataFrame, by: list[str], level: int) -> DataFrame:
        order = F.shiftleft(-F.col("size"), 20) + F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(level), "doc", "nth", "size"), F.lit(1 << 20))
        chance = _uniform(F.lit(seed + 2), F.lit(level), F.col("doc"), F.col("nth"), F.col("size"))
        item = F.struct(order.alias("h"), "doc", "nth", "size", "base", "p", "take", F.lit(True).alias("open"), chance.alias("u"))
        met = dealt.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items")).select("source", F.col("class") if "class" in by else F.lit(0).alias("class"), F.explode(_pivotal("items")).alias("i"))
        met = durable(met.select("source", "class", "i.doc", "i.nth", "i.size", "i.base", "i.p", "i.take", "i.open"), f"mix-level{level}")
        done.append(met.where(~F.col("open")).select(*cols))
        return met.where("open").select(*cols)

    level, most = 0, counts.agg(F.max("n")).first()[0] or 0
    while most > 1:
        n = counts if not level else left.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"))
        n = n.select(F.col("source").alias("s"), F.col("class").alias("c"), "n")
        blocks = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc", "nth", "size"), F.ceil(F.col("n") / fan_in).cast("long"))
        dealt = left.join(F.broadcast(n), left["source"].eqNullSafe(n["s"]) & (left["class"] == n["c"])).withColumn("block", blocks)
        left = meet(dealt, ["source", "class", "block"], level)
        level, most = level + 1, -(-most // fan_in)
    left = meet(left.unionByName(reserve), ["source"], level)  # some RESERVE + 1 of each class
    done.append(left.withColumn("take", (F.col("base") + (F.col("p") >= 0.5).cast("long")) * F.col("size")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    t = per_source.select("s", "source_size", "target")
    return out.join(F.broadcast(t), out["source"].eqNullSafe(t["s"])).select(F.col("doc").alias("doc_id"), "nth", "source", "size", "source_size", "target", F.col("take").cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, **kw) -> DataFrame:
    """The documents of the mix, with all their columns; a document taken twice is there twice, one not taken is gone.

    A document without words is kept once: it takes no words, so leaving it out would not change the mix.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    docs = durable(documents.select(own.alias("row")).withColumn("_row", F.monotonically_increasing_id()), "mix-documents")
    text = F.col("row.text")
    keys = docs.select("_row", F.col("row.doc_id").cast("long").alias("k"), F.col("row.source").cast("string").alias("s"), n_words(text).alias("n"), F.md5(text).alias("md5"))
    keys = keys.withColumn("r", F.row_number().over(Window.partitionBy("k", "s", "n").orderBy("md5", "_row")).cast("long"))
    took = mix(documents, **kw).select(F.col("doc_id").alias("k2"), F.col("source").alias("s2"), F.col("size").alias("n2"), F.col("nth").alias("r2"), F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1).alias("copies"))
    on = keys["k"].eqNullSafe(took["k2"]) & keys["s"].eqNullSafe(took["s2"]) & (keys["n"] == took["n2"]) & (keys["r"] == took["r2"])
    copies = durable(keys.join(took, on).where("copies > 0").select("_row", "copies"), "mix-copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    return docs.join(copies, "_row").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
