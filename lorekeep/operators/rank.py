"""Ranking: channels, fusion, re-ranking, graph diffusion, diversity, and budgets over ranked rows."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize, tokens_hybrid
from ..sources.shared import durable
from .oplog import irreversibility, is_never_drop

#: Fixed values of the ranking rules.
RRF_K = 60
IMPORTANCE_BONUS = {"low": 0.0, "medium": 0.012, "high": 0.026, "critical": 0.045}
IMPORTANCE_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
KIND_WEIGHT = {"state": 6, "intention": 5, "commitment": 4, "relation": 3, "ownership": 2, "knowledge": 1, "belief": 1}
ALWAYS, IN_CONTEXT = ("state", "intention", "commitment"), ("relation", "ownership", "knowledge", "belief")
RERANK_WEIGHTS = {"coverage": 0.30, "phrase": 0.18, "slot": 0.12, "entity": 0.12, "recency": 0.12, "importance": 0.08, "breadth": 0.08}
_LARGEST = math.log(1.7976931348623157e308)
RERANK_IMPORTANCE = {"high": 1.0, "medium": 0.6, "low": 0.3}


def lookup(values: dict, key: Column, default=0) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def temporal_topk(memories: DataFrame, k: int = 8, scope: Column | None = None, only_active: bool = True) -> DataFrame:
    """T4: values whose interval covers as_of (both ends count) and whose scope, if both have one, is a prefix of the other's."""
    rows = memories.where("status = 'active'") if only_active else memories
    rows = rows.where((F.col("valid_from") <= F.col("as_of")) & (F.coalesce("valid_until", F.lit(2**62)) >= F.col("as_of")))
    bonus = F.lit(0.0)
    if scope is not None:
        own, asked = F.lower(F.trim("scope")), F.lower(F.trim(scope))
        match = F.coalesce((own != "") & (own.startswith(asked) | asked.startswith(own)), F.lit(False))
        rows = rows.where(match | F.coalesce(own == "", F.lit(True)) | asked.isNull())
        bonus = F.when(match, 0.3).otherwise(0.0)
    score = 0.3 + 0.5 * F.greatest(F.lit(0.0), 1 - (F.col("as_of") - F.col("valid_from")) / 512) + bonus + lookup(IMPORTANCE_BONUS, F.col("importance"), 0.0)
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.round("score", 9).desc(), F.desc("valid_from"))) - 1
    return rows.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") < k)


def active_topk(memories: DataFrame, mentioned: Column, k: int = 12) -> DataFrame:
    """T5: active values that always matter, or that the query mentions or that are important."""
    level = lookup(IMPORTANCE_RANK, F.col("importance"), 1)
    rows = memories.where("status = 'active'").where(F.col("kind").isin(*ALWAYS) | F.col("kind").isin(*IN_CONTEXT) & (mentioned | (level >= 2)))
    order = Window.partitionBy("conv_id").orderBy(lookup(KIND_WEIGHT, F.col("kind")).desc(), level.desc(), F.desc("valid_from"), "slot")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mandatory_topk(memories: DataFrame, k: int = 24) -> DataFrame:
    """Values that must not be dropped, those hardest to take back first."""
    rows = memories.where(is_never_drop(F.col("status"), F.col("text"), F.col("importance"), F.col("kind")))
    weight = irreversibility(F.col("kind")) + (F.col("importance") == "critical").cast("int") + F.when(F.col("version") == 1, 0.5).otherwise(0.0)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(weight.desc(), F.desc("valid_from"), "slot"))).where(F.col("rank") <= k)


def mandatory_then_broad(must: DataFrame, broad: DataFrame, keys: list[str]) -> DataFrame:
    """All mandatory rows (part 0), and the broad ones that aren't among them (part 1)."""
    return must.withColumn("part", F.lit(0)).unionByName(broad.join(must, keys, "left_anti").withColumn("part", F.lit(1)))


def canonical_state(memories: DataFrame, chars: int) -> DataFrame:
    """Active values as lines, by kind and newest first, cut at so many characters."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(lookup(KIND_WEIGHT, F.col("kind")).desc(), F.desc("valid_from"), "slot"))
    rows = memories.where("status = 'active'").select("conv_id", rank.alias("r"), F.concat("slot", F.lit(": "), "text").alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.left(lines, F.lit(chars)).alias("state"))


def state_for_extraction(memories: DataFrame, active: int = 28, past: int = 8, chars: int = 12_000) -> DataFrame:
    """(conv_id, state): the newest active values, then the newest closed ones that matter, as lines, cut at so many characters.

    memories: (conv_id, id, kind, slot, text, status, importance, valid_from).
    """
    now = F.col("status") == "active"
    weighty = (F.col("status") == "closed") & F.coalesce("importance", F.lit("medium")).isin("high", "critical")
    rows = memories.where(now | weighty).withColumn("part", F.when(now, 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.desc("valid_from"), F.desc("id")))
    slot = F.when(F.coalesce("slot", F.lit("")) != "", F.concat(F.lit(" slot="), "slot")).otherwise("")
    line = F.when(now, F.concat(F.lit("- ["), "kind", slot, F.lit("] "), "text")).otherwise(F.concat(F.lit("- [past:"), "kind", F.lit("] "), "text"))
    few = rows.withColumns({"r": place, "line": line}).where((F.col("r") <= active) & now | (F.col("r") <= past) & weighty)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "r", "line"))), lambda x: x["line"]), "\n")
    return few.groupBy("conv_id").agg(F.left(lines, F.lit(chars)).alias("state"))


def cooldown_penalty(age: Column, turns: int = 4) -> Column:
    """Factor for what was recalled so many messages ago."""
    return F.when((age > 0) & (age <= turns), 0.42 + 0.58 * age / (turns + 1)).otherwise(1.0)


def recency(age: Column, half_life: float = 120) -> Column:
    """W5."""
    return F.exp(-math.log(2) * F.greatest(age, F.lit(0)) / half_life)


@F.pandas_udf(T.DoubleType())
def _exp(x: pd.Series) -> pd.Series:
    """The C library's, as SQL engines have it; Java's differs in the last place, which shows in large values."""
    return x.map(lambda v: math.inf if v > _LARGEST else math.exp(v), na_action="ignore")


def decay(age: Column, half_life: float = 120) -> Column:
    """W5 without a floor: what lies ahead of the time asked for (a negative age) weighs more than 1."""
    return _exp(-math.log(2) * age / half_life)


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as C does it, by a factor: halves away from zero, and what has no fraction left goes through the factor too."""
    scaled = value * 10.0**digits
    whole = F.when(F.abs(scaled) < 2.0**52, F.signum(scaled) * F.floor(F.abs(scaled) + 0.5)).otherwise(scaled) / 10.0**digits
    return F.when(F.abs(scaled) < math.inf, whole).otherwise(value)


def minmax(value: Column, by: str) -> Column:
    """0 to 1 over the rows of a query; 0.5 where they don't differ."""
    w = Window.partitionBy(by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi - lo < 1e-9, 0.5).otherwise((value - lo) / (hi - lo))


def rrf(channels: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, channels) from (query_id, channel, id, rank from 0): sums of weight / (k + rank + 1)."""
    part = lookup(weights, F.col("channel"), 1.0) / (k + F.col("rank") + 1)
    return channels.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))


def dense_gate(channels: DataFrame, lexical: str = "lexical", dense: str = "dense") -> DataFrame:
    """Lexical rows go unless the id is in a dense channel of the query or has an exact entity match (column entity)."""
    found = channels.where(F.col("channel").startswith(dense)).select("query_id", "id").distinct()
    gated = channels.where((F.col("channel") == lexical) & ~F.col("entity")).join(found, ["query_id", "id"], "left_semi")
    return channels.where((F.col("channel") != lexical) | F.col("entity")).unionByName(gated)


def adjusted(fused: DataFrame) -> DataFrame:
    """Bonuses for importance and reinforcement, a factor for missing evidence. Columns importance, reinforcement, evidenced."""
    score = F.col("score") + lookup(IMPORTANCE_BONUS, F.col("importance"), 0.0) + F.least(F.lit(0.025), 0.003 * F.col("reinforcement"))
    return fused.withColumn("score", score * F.when(F.col("evidenced"), 1.0).otherwise(0.82))


def rerank(rows: DataFrame, weight: float = 0.55, pool: int = 60) -> DataFrame:
    """Rows (query_id, id, score, coverage, phrase, slot, entity, recency, importance 0..1, breadth) in a new order.

    A linear blend of the fused score and of the features, each scaled over the query's rows and centred on 0.5.
    """
    parts = [2 * w * (minmax(F.col(f).cast("double"), "query_id") - 0.5) for f, w in RERANK_WEIGHTS.items()]
    local = F.least(F.lit(1.0), F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, parts, F.lit(0.5))))
    blend = (1 - weight) * minmax(F.col("score"), "query_id") + weight * local + F.when(F.col("entity") > 0, 0.05).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc(), F.round("score", 9).desc(), "id")
    return rows.withColumn("rerank_score", blend).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)


def candidate_edges(candidates: DataFrame, terms: DataFrame, n_all: DataFrame, hub_entity: float = 0.45, hub_topic: float = 0.60) -> DataFrame:
    """(query_id, a, b, w) of candidates that share rare terms: the sum of the lesser weights.

    terms: (conv_id, id, type e or t, term); n_all: (conv_id, n). Terms of too many memories link nothing, which also
    keeps any one term from bringing all candidates together.
    """
    df = terms.groupBy("conv_id", "type", "term").agg(F.count_distinct("id").alias("df")).join(n_all, "conv_id")
    share = F.col("df") / F.col("n")
    entity = F.col("type") == "e"
    weight = F.when(entity & (share <= hub_entity), 1.25 * F.log(1 + F.col("n") / F.col("df"))).when(~entity & (share <= hub_topic), F.log(1 + F.col("n") / F.col("df")))
    rare = df.withColumn("w", weight).where("w is not null").select("conv_id", "type", "term", "w")
    own = candidates.select("query_id", "conv_id", "id").join(terms.distinct(), ["conv_id", "id"]).join(rare, ["conv_id", "type", "term"])
    a, b = own.alias("a"), own.alias("b")
    on = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, on).groupBy(F.col("a.query_id").alias("query_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.sum(F.least("a.w", "b.w")).alias("w"))


def diffuse(candidates: DataFrame, edges: DataFrame, damping: float = 0.18, rounds: int = 5) -> DataFrame:
    """Score mass spread over the edges a few times; candidates: (query_id, id, score)."""
    both = edges.select("query_id", "a", "b", "w").unionByName(edges.select("query_id", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    share = durable(both.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("query_id", "a"))).select("query_id", F.col("a").alias("id"), "b", "share"), "diffuse-edges")
    per = Window.partitionBy("query_id")
    positive = F.greatest(F.lit(0.0), F.col("score"))
    base = candidates.withColumn("base", F.coalesce(positive / F.nullif(F.sum(positive).over(per), F.lit(0.0)), F.lit(0.0)))
    lonely = base.join(share.select("query_id", "id").distinct().withColumn("linked", F.lit(True)), ["query_id", "id"], "left").withColumn("p", F.col("base"))
    p = durable(lonely, "diffuse-0")
    for k in range(rounds):  # each round reads the last one twice, so it is written
        sent = p.select("query_id", "id", "p").join(share, ["query_id", "id"]).groupBy("query_id", F.col("b").alias("id")).agg(F.sum(F.col("p") * F.col("share")).alias("got"))
        kept = F.when(F.col("linked").isNull(), F.col("p")).otherwise(F.coalesce("got", F.lit(0.0)))
        p = p.join(sent, ["query_id", "id"], "left").withColumn("p", (1 - damping) * F.col("base") + damping * kept).drop("got")
        p = durable(p, f"diffuse-{k + 1}")
    graph = F.col("p") / F.greatest(F.max("p").over(per), F.lit(1e-9))
    top = F.greatest(F.max(positive).over(per), F.lit(1e-9))
    return p.withColumn("graph", graph).withColumn("score", 0.88 * F.col("score") + 0.12 * top * F.col("graph")).drop("base", "linked", "p")


def mmr(rows: DataFrame, k: int = 6, weight: float = 0.78) -> DataFrame:
    """K rows of each query, greedily by relevance less likeness to those chosen. rows: (query_id, id, score, terms array).

    Greedy per query over its candidates, whose number the pool of the re-ranking bounds. Ties go to the lesser place, if
    there is such a column, else to the greater score and lesser id.
    """
    order = {"by": ["place"], "ascending": [True]} if "place" in rows.columns else {"by": ["score", "id"], "ascending": [False, True]}

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left = [(r.id, r.score, set(r.terms)) for r in pdf.sort_values(**order).itertuples()]
        top = max(max((s for _, s, _ in left), default=0.0), 1e-9)
        chosen, out = [], []
        while left and len(out) < k:
            like = lambda t: max((len(t & c) / len(t | c) for c in chosen if t and c), default=0.0)  # noqa: E731, B023
            values = [round(weight * s / top - (1 - weight) * like(t), 12) for _, s, t in left]
            best = max(range(len(left)), key=lambda i: (values[i], -i))
            i, _, t = left.pop(best)
            chosen.append(t)
            out.append((key[0], i, len(out) + 1, values[best]))
        return pd.DataFrame(out, columns=["query_id", "id", "rank", "mmr"])

    schema = f"query_id {rows.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, rank int, mmr double"
    return rows.select("query_id", "id", "score", "terms", *[c for c in ("place",) if c in rows.columns]).groupBy("query_id").applyInPandas(choose, schema)


def similarity_terms(text: Column, topics: Column) -> Column:
    """The terms by which two rows are alike."""
    return F.array_distinct(F.concat(F.transform(topics, lambda t: F.concat(F.lit("t:"), normalize(t))), F.transform(F.filter(tokens_hybrid(text), lambda t: F.length(t) >= 2), lambda t: F.concat(F.lit("x:"), t))))


def pack_prefix(rows: DataFrame, by: str, order: list[Column], size: str, budget: int, at_least_one: bool = False) -> DataFrame:
    """Rows in order up to the first that does not fit; all after it go too."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("used", F.sum(F.col(size).cast("long")).over(w))
    fits = F.col("used") <= budget
    if at_least_one:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
        fits = fits | (F.col("_n") == 1)
    return out.where(fits).drop("_n")


def pack_skip(rows: DataFrame, by: str, order: list[Column], size: str, budget: int, key: str = "id") -> DataFrame:
    """Rows in order; one that does not fit is left out and later ones may still fit."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    items = F.array_sort(F.collect_list(F.struct("_r", F.col(size).cast("long").alias("n"), F.col(key).alias("key"))))
    kind = rows.schema[key].dataType.simpleString()
    state = F.expr(f"named_struct('left', {budget}L, 'out', cast(array() as array<struct<_r:int,n:bigint,key:{kind}>>))")
    step = lambda s, x: F.when(x["n"] <= s["left"], F.struct((s["left"] - x["n"]).alias("left"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    packed = ranked.groupBy(by).agg(items.alias("items")).select(by, F.explode(F.aggregate("items", state, step, lambda s: s["out"])).alias("x"))
    return packed.select(by, F.col("x.key").alias(key), F.col("x._r").alias("rank"), F.col("x.n").alias("size"))


def pack_layers(rows: DataFrame, by: str, layer: str, order: list[Column], size: str, budget: int, shares: tuple[float, ...] = (0.25, 0.45, 0.30), key: str = "id") -> DataFrame:
    """Layers 0, 1, 2 share a budget; what a layer leaves is added to the next one's share. Rows that don't fit are skipped."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by, layer).orderBy(*order)))
    kind = rows.schema[key].dataType.simpleString()
    none = F.expr(f"cast(array() as array<struct<_r:int,n:bigint,key:{kind}>>)")
    one = F.struct("_r", F.col(size).cast("long").alias("n"), F.col(key).alias("key"))
    packed = ranked.groupBy(by).agg(*[F.array_sort(F.collect_list(F.when(F.col(layer) == i, one))).alias(f"_{i}") for i in range(len(shares))])

    def step(s: Column, x: Column) -> Column:
        fits = F.struct((s["left"] - x["n"]).alias("left"), F.concat(s["out"], F.array(x)).alias("out"))
        return F.when(x["n"] <= s["left"], fits).otherwise(s)

    spare = F.lit(0).cast("long")
    for i, share in enumerate(shares):
        packed = packed.withColumn(f"_p{i}", F.aggregate(f"_{i}", F.struct((spare + F.lit(int(budget * share))).alias("left"), none.alias("out")), step))
        spare = F.col(f"_p{i}.left")
    every = F.flatten(F.array(*[F.col(f"_p{i}.out") for i in range(len(shares))]))
    layers = F.flatten(F.array(*[F.array_repeat(F.lit(i), F.size(F.col(f"_p{i}.out"))) for i in range(len(shares))]))
    out = packed.select(by, F.explode(F.arrays_zip(layers.alias("layer"), every.alias("x"))).alias("z"))
    return out.select(by, F.col("z.layer").alias(layer), F.col("z.x.key").alias(key), F.col("z.x.n").alias("size"))
