"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans (e-mail, IP, card and phone, by format) are the seeds. Candidates are the runs that could be identifiers: a token
with a digit or an @, or groups of digits with blanks, brackets, dots or dashes between them, five characters or more. A
lexical pattern is what stands beside a candidate, in plain words of any text: the word before it, the two words before it, or
the word after it (lower case, delimiters dropped). Patterns and candidates form a bipartite graph, scored in rounds over the
whole corpus: the trust of a pattern in a kind is its conditional frequency, the share of all the pattern's occurrences in
the corpus (beside a candidate or not; plus one) that are beside an instance of the kind. A pattern of trust ``CONFIDENT``
or more with ``SUPPORT`` or more distinct instances is trusted; the candidates beside it become instances of the kind and
count like seeds in the next round, so they can lead to patterns that no seed is beside. The rounds go on until no pattern
joins the trusted ones: the least fixed point, whatever the order of rows. A candidate that no base span touches and that a
trusted pattern is beside is a further span, of the kind of the pattern with most trust (then by order of kinds).

Defined results: null and empty texts have no spans; repeated rows get equal spans and count in frequencies as often as they
are there, but not in the number of distinct instances; a context does not reach over another candidate; an empty table gives
an empty result; other columns are ignored, or kept as they are by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import durable
from .spans import SPAN, find, free_of, listed, places, replaced

KINDS = ("email", "ip", "card", "phone")
CONFIDENT, SUPPORT, SHORTEST = 0.5, 3, 5
#: Pattern keys and rows with further spans that are broadcast at most; beyond that they are joined.
BROADCAST_KEYS = 500_000
# The expressions of the contract, written so that no text makes them scan a run of characters more than once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SIGN = r"[^\x20\x09-\x0D\"'<>(),;:=#|\[\]{}]"
LETTER = SIGN[:-1] + "0-9@]"
CANDIDATE = rf"(?<!{SIGN})(?:[+(]{{0,2}}[0-9]++(?:[\x20()./-]{{1,3}}+[0-9]++)++(?![\p{{L}}@_])|{LETTER}*+[0-9@](?:{SIGN}*[\p{{L}}\p{{N}}])?)"
WORD, BREAK, GAP = r"[\p{L}\p{M}'_-]", r"[^\p{L}\p{M}'_-]", r"[^0-9\p{L}\p{M}'_-]{0,6}"
#: Places of a pattern: the word before, the two words before, the word after; group 1 is the text.
PLACES = {
    "before": rf"(?s)^(?:.*{BREAK})?({WORD}++){GAP}$",
    "two before": rf"(?s)^(?:.*{BREAK})?({WORD}++{BREAK}++{WORD}++){GAP}$",
    "after": rf"^{GAP}+({WORD}++)",
}
FOUND = "struct<s:bigint,e:bigint,v:string,kind:string,beside:array<struct<place:string,words:string>>>"
BYTES = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        n = c.try_cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.transform(F.split(F.reverse(_digits(v)), ""), lambda c, i: F.coalesce(worth(c, i), F.lit(0))), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: str) -> list[Column]:
    """Arrays of spans, by kind. text: the name of a column without nulls."""
    t = F.col(text)
    digits = lambda x: F.length(_digits(x["v"]))
    return [
        find(text, EMAIL, "email", 0, F.contains(t, F.lit("@"))),
        F.filter(find(text, IP, "ip", 1, t.rlike(IP)), lambda x: x["v"].rlike(BYTES)),
        F.filter(find(text, CARD, "card", 2, t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda x: digits(x).between(14, 19) & _luhn(x["v"])),
        F.filter(find(text, PHONE, "phone", 3, F.contains(t, F.lit("+"))), lambda x: digits(x).between(10, 15)),
    ]


def candidates(text: str, base: Column) -> Column:
    """Array of (s, e, v, kind, beside): places and value of each candidate; kind: the seed's that begins in it, or null; beside: its patterns."""
    t = F.col(text)
    both = F.array(F.struct(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias("m"), F.split(t, CANDIDATE, -1).alias("g")))
    gaps = lambda y, k: F.slice(y["g"], F.lit(k), F.size(y["m"]))
    row = "struct<s:bigint,t:int,k:int,e:bigint,v:string,kind:string,g:string,h:string>"
    own = lambda v, x: F.struct((x["e"] - F.length(v)).alias("s"), F.lit(0).alias("t"), F.lit(-1).alias("k"), x["e"].alias("e"), v.alias("v"), F.lit(None).alias("kind"), x["g"].alias("g"), x["h"].alias("h")).cast(row)
    beside = lambda y: F.zip_with(places(y["m"], y["g"]), F.zip_with(gaps(y, 1), gaps(y, 2), lambda g, h: F.struct(g.alias("g"), h.alias("h"))), lambda e, x: F.struct(e.alias("e"), x["g"].alias("g"), x["h"].alias("h")))
    placed = F.get(F.transform(both, lambda y: F.zip_with(y["m"], beside(y), own)), F.lit(0))
    seeds = F.transform(base, lambda b: F.struct(b["s"].alias("s"), F.lit(1).alias("t"), b["k"].alias("k"), b["e"].alias("e"), b["v"].alias("v"), b["kind"].alias("kind"), F.lit("").alias("g"), F.lit("").alias("h")).cast(row))
    # in order of their places, the first seed in a candidate comes right after it, as candidates do not overlap
    merged = F.array(F.array_sort(F.concat(placed, seeds)))
    pairs = F.get(F.transform(merged, lambda m: F.zip_with(m, F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))), F.lit(0))

    def one(z: Column) -> Column:
        x = z["x"]
        seeded = F.coalesce((z["y"]["t"] == 1) & (z["y"]["s"] < x["e"]), F.lit(False))
        words = {k: F.regexp_replace(F.regexp_extract(F.lower(x["h" if k == "after" else "g"]), rx, 1), f"{BREAK}+", " ") for k, rx in PLACES.items()}
        near = F.filter(F.array(*[F.struct(F.lit(k).alias("place"), w.alias("words")) for k, w in words.items()]), lambda y: y["words"] != "")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(seeded, z["y"]["v"]).otherwise(x["v"]).alias("v"), F.when(seeded, z["y"]["kind"]).alias("kind"), near.alias("beside"))

    placed = F.filter(pairs, lambda z: z["x"]["t"] == 0)
    out = F.filter(F.transform(placed, one), lambda x: x["kind"].isNotNull() | (F.length(x["v"]) >= SHORTEST))
    return F.when(t.rlike("[0-9@]"), out).otherwise(F.expr(f"cast(array() as array<{FOUND}>)"))


def marked(documents: DataFrame, keep: list[Column]) -> DataFrame:
    """The kept columns with _text, by kind one array of spans each, _base (all base spans), _found (candidates) and _row."""
    rows = documents.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.withColumns({f"_{k}": c for k, c in zip(KINDS, base_spans("_text"))})
    rows = rows.withColumn("_base", F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS])))
    return rows.withColumn("_found", candidates("_text", F.col("_base"))).withColumn("_row", F.monotonically_increasing_id())


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def occurrences(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, total): how often each of the words and pairs of neighbouring words whose hash is in keys occurs in column text."""
    words = texts.select(F.regexp_extract_all(F.lower("text"), F.lit(f"{WORD}+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))
    each = words.select(F.explode(F.concat(F.transform("w", lambda x: F.xxhash64(x)), F.when(F.size("w") > 1, pairs).otherwise(F.expr("cast(array() as array<bigint>)")))).alias("key"))
    return each.join(_small(keys, keys.count()), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("total"))


def learn(found: DataFrame, texts: DataFrame, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame | None:
    """(place, words, kind, trust) of the trusted patterns at the fixed point, None if there are none.

    found: rows of (x: a candidate); texts: the texts that they are from, in column text.
    """
    each = found.select("x.v", "x.kind", F.explode("x.beside").alias("b")).select(F.struct("b.place", "b.words").alias("p"), "v", "kind")
    edges = durable(each.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")), "pii-edges")
    seen = F.sum("n")
    # patterns that no promotion could make trusted go first, so that only the others are counted in the corpus
    could = F.greatest(*[F.sum(F.when(F.coalesce(F.col("kind") == k, F.lit(True)), F.col("n")).otherwise(0)) for k in KINDS])
    viable = edges.groupBy("p").agg(F.count(F.lit(1)).alias("values"), could.alias("could"), seen.alias("seen")).where((F.col("values") >= support) & (F.col("could") >= confident * (F.col("seen") + 1)))
    viable = durable(viable.select("p", "could", F.xxhash64("p.words").alias("key")), "pii-viable")
    if viable.isEmpty():
        return None
    totals = occurrences(texts, viable.select("key").distinct())
    viable = durable(viable.join(totals, "key").where(F.col("could") >= confident * (F.col("total") + 1)).select("p", "total"), "pii-totals")
    edges = durable(edges.join(_small(viable, viable.count()), "p"), "pii-graph")
    seeds, blank = edges.where("kind is not null"), edges.where("kind is null").drop("kind")
    instances, before = seeds.select("v", "kind").distinct(), 0
    while True:
        met = seeds.unionByName(blank.join(instances, "v").select(*edges.columns))
        mass = met.groupBy("p", "kind").agg(F.sum("n").alias("mass"), F.count(F.lit(1)).alias("values"), F.max("total").alias("total"))
        trusted = mass.where((F.col("values") >= support) & (F.col("mass") >= confident * (F.col("total") + 1)))
        trusted = durable(trusted.select("p", "kind", (F.col("mass") / (F.col("total") + 1)).alias("trust")), "pii-trusted")
        now = trusted.count()
        if now == before:  # trusted patterns only join, so none did
            break
        before = now
        promoted = blank.select("p", "v").join(_small(trusted, now), "p").select("v", "kind")
        instances = durable(seeds.select("v", "kind").unionByName(promoted).distinct(), "pii-instances")
    return trusted.select("p.place", "p.words", "kind", "trust") if now else None


def _added(rows: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """rows (of marked) with _more: the spans that patterns add."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    if patterns is None:
        return rows.withColumn("_more", none)
    each = rows.where(F.size("_found") > 0).select("_row", F.explode("_found").alias("x")).where("x.kind is null").select("_row", "x", F.explode("x.beside").alias("b"))
    p = _small(patterns.select(F.struct("place", "words").alias("b"), "kind", "trust"), patterns.count())
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    best = each.join(p, "b").groupBy("_row", "x.s", "x.e", "x.v").agg(F.max_by("kind", F.struct("trust", -order)).alias("kind"))
    span = F.struct(F.col("s"), order.alias("k"), F.col("kind"), F.col("e"), F.col("v")).cast(SPAN)
    more = durable(best.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_y")), "pii-more")  # the candidates of one text
    return rows.join(_small(more, more.count()), "_row", "left").withColumn("_more", free_of(F.coalesce("_y", none), F.col("_base"))).drop("_y")


def detect(documents: DataFrame, **kw) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_spans) of every document."""
    rows = durable(marked(documents, [F.col("doc_id").cast("long").alias("doc_id")]).drop("_text"), "pii-marked")
    patterns = learn(rows.select(F.explode("_found").alias("x")), documents.select("text"), **kw)
    rows = _added(rows, patterns)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    more, base = F.size("_more").cast("long"), F.size("_base").cast("long")
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.concat("_base", "_more")).alias("spans"), more.alias("n_more"), (base + more).alias("n_spans"))


def redact(documents: DataFrame, **kw) -> DataFrame:
    """The documents, each span of their texts replaced by its kind in angle brackets; other columns stay."""
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]) if len(documents.columns) > 1 else F.lit(None)
    rows = durable(marked(documents, [own.alias("_own"), F.col("text").isNull().alias("_null")]), "pii-redact")
    rows = _added(rows, learn(rows.select(F.explode("_found").alias("x")), rows.select(F.col("_text").alias("text")), **kw))

    clean = replaced(F.col("_text"), F.array_sort(F.concat("_base", "_more")))
    text = F.when(F.col("_null"), F.lit(None)).otherwise(clean)
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"_own.`{c}`") for c in documents.columns])
