"""Secrets by format and by a battery of randomness tests, in DataFrame operations only.

Base spans: assignments to credential names, access key ids and long hexadecimal runs. The battery looks at the other long
tokens (20 characters or more of ``[A-Za-z0-9+/_=-]``): it infers the encoding from the characters (decimal, hexadecimal,
one case of letters, base 32, one case with digits, base 64) and tests the token's symbols, as numbers of that alphabet, for uniformity
(chi-squared, over as many equal bins as leave five symbols in each), for runs about the middle and for serial
correlation. A token passes if three times its least p-value is at least ``ALPHA``. Long identifiers and words can look
uniform when short, so discovery is controlled by length: a token's evidence is the likelihood of its symbols under the
uniform alphabet of its encoding against that under writing, a model of character pairs counted over all shorter tokens of
the corpus. The pairs of writing are smoothed towards a change of class (lower, upper, digit, other) with probability
``CHANGE``; from the 20th character on, each that follows also counts against the share of tokens that end there. The ratio
is a martingale while a token of writing goes on, so 1 / ratio is a p-value (Ville). Tokens without lower-case letters are
scored as lower case, so that capitals alone are no evidence. Benjamini-Hochberg over all long tokens of the corpus, in steps of a
twentieth of a decade, bounds the share of false discoveries by ``FDR``.

Defined results: null and empty texts have no spans; repeated rows count as often as they are there; with no long tokens
nothing is added; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import durable
from .spans import find, free_of, listed

KINDS = ("assign", "access", "hex")
ALPHA, FDR, CHANGE = 0.003, 0.01, 0.12
ASSIGN = r"(?:(?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
VALUE = r"^(?:(?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LONG = r"[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
#: What a token consists of, by class, and the weight of the smoothing, in pairs.
SIGNS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-")
PRIOR = 50.0
#: Alphabets of the encodings, by which a symbol's number is its place.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def base_spans(text: str) -> list[Column]:
    """Arrays of spans, by kind. text: the name of a column without nulls."""
    t = F.col(text)
    named = t.rlike(r"(?i)password|passwd|secret|token|api_?key")
    return [
        F.filter(find(text, ASSIGN, "assign", 0, named), lambda x: F.length(F.regexp_extract(x["v"], VALUE, 1)) >= 12),
        F.filter(find(text, ACCESS, "access", 1, F.contains(t, F.lit("AKIA"))), lambda x: F.length(x["v"]) >= 18),
        find(text, HEX, "hex", 2, t.rlike(HEX)),
    ]


def _phi(z: Column) -> Column:
    """The normal distribution function, by a logistic approximation (error below 0.0002)."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def encoding(v: Column) -> Column:
    return F.when(v.rlike("^[0-9]+$"), "decimal").when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(v.rlike("^[a-z]+$"), "lower").when(v.rlike("^[A-Z]+$"), "upper").when(v.rlike("^[A-Z2-7]+=*$"), "base32").when(v.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), "base36").otherwise("base64")


def writing(texts: DataFrame) -> list[float]:
    """Nats of each pair of signs under writing, then of going on after each sign, from all tokens under LEAST in column _text."""
    signs = "".join(SIGNS)
    k = len(signs)
    words = texts.select(F.explode(F.split("_text", r"[^A-Za-z0-9+/_=-]+")).alias("w")).where(F.length("w").between(1, LEAST - 1)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    chars = F.filter(F.split("w", ""), lambda c: c != "")
    pairs = F.zip_with(chars, F.slice(F.concat(chars, F.array(F.lit(""))), F.lit(2), F.length("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counts = words.select("n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).collect()  # at most 67 x 68 rows
    cls = np.repeat(np.arange(len(SIGNS)), [len(x) for x in SIGNS])
    same = cls[:, None] == cls[None, :]
    prior = np.where(same, (1 - CHANGE) / same.sum(1, keepdims=True), CHANGE / (~same).sum(1, keepdims=True))
    seen, ends = np.zeros((k, k)), np.zeros(k)
    for a, b, n in counts:
        if b:
            seen[signs.index(a), signs.index(b)] = n
        else:
            ends[signs.index(a)] = n
    inner = seen.sum(1)
    pair = np.log((seen + PRIOR * prior) / (inner + PRIOR)[:, None])
    on = np.log((inner + PRIOR) / (inner + ends + PRIOR))
    return [*pair.ravel().tolist(), *on.tolist()]


def evidence(v: Column, size: Column, model: list[float]) -> Column:
    """The p-value of a token under writing: the inverse ratio of its likelihoods, 1 at most."""
    signs = "".join(SIGNS)
    nats = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # folded to one literal
    one = F.when(v.rlike("[a-z]"), v).otherwise(F.lower(v))
    at = F.transform(F.filter(F.split(one, ""), lambda c: c != ""), lambda c: F.instr(F.lit(signs), c) - 1)
    n = F.size(at)
    pairs = F.zip_with(F.slice(at, F.lit(1), n - 1), F.slice(at, F.lit(2), n - 1), lambda a, b: F.get(nats, a * len(signs) + b))
    on = F.transform(F.slice(at, F.lit(LEAST), F.greatest(n - LEAST, F.lit(0))), lambda a: F.get(nats, F.lit(len(signs) ** 2) + a))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    ratio = -F.log(size) * (n - 1) - add(pairs) - add(on)
    return F.exp(-F.least(F.greatest(ratio, F.lit(0.0)), F.lit(700.0)))


def battery(tokens: DataFrame, model: list[float]) -> DataFrame:
    """Rows with a token in v get: encoding, p_uniform, p_runs, p_serial, p_random and p_text (evidence against writing)."""
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), F.col("encoding"))
    symbols = F.regexp_replace(F.when(F.col("encoding").isin("hex", "base36"), F.lower("v")).otherwise(F.translate("v", "-_", "+/")), "=", "")
    t = tokens.withColumn("encoding", encoding(F.col("v"))).withColumns({"_a": alphabet, "_w": symbols})
    t = t.withColumns({"_n": F.length("_w").cast("double"), "_size": F.length("_a").cast("double")})
    t = t.withColumn("_x", F.transform(F.filter(F.split("_w", ""), lambda c: c != ""), lambda c: F.instr(F.col("_a"), c) - 1))
    bins = F.greatest(F.lit(2.0), F.least(F.col("_size"), F.floor(F.col("_n") / 5).cast("double")))
    t = t.withColumn("_b", bins)
    per = F.transform(F.sequence(F.lit(0), F.col("_b").cast("int") - 1), lambda b: F.size(F.filter("_x", lambda x: F.floor(x * F.col("_b") / F.col("_size")) == b)).cast("double"))
    even = F.col("_n") / F.col("_b")
    chi = F.aggregate(per, F.lit(0.0), lambda s, c: s + (c - even) * (c - even) / even)
    df = F.col("_b") - 1
    # Wilson-Hilferty: the cube root of chi-squared over its degrees is nearly normal
    z = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    t = t.withColumn("p_uniform", 1 - _phi(z))
    up = F.transform("_x", lambda x: (2 * x + 1 > F.col("_size")).cast("int"))
    t = t.withColumn("_u", up)
    n1 = F.aggregate("_u", F.lit(0.0), lambda s, x: s + x)
    t = t.withColumns({"_n1": n1, "_n2": F.col("_n") - n1})
    runs = 1 + F.aggregate(F.zip_with(F.slice("_u", 1, F.size("_u") - 1), F.slice("_u", 2, F.size("_u") - 1), lambda a, b: (a != b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = 2 * F.col("_n1") * F.col("_n2")
    var = both * (both - F.col("_n")) / (F.col("_n") * F.col("_n") * (F.col("_n") - 1))
    t = t.withColumn("p_runs", F.when(var > 0, 2 * (1 - _phi(F.abs(runs - both / F.col("_n") - 1) / F.sqrt(var)))).otherwise(0.0))
    mean = (F.col("_size") - 1) / 2
    spread = (F.col("_size") * F.col("_size") - 1) / 12
    product = F.aggregate(F.zip_with(F.slice("_x", 1, F.size("_x") - 1), F.slice("_x", 2, F.size("_x") - 1), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda s, x: s + x)
    t = t.withColumn("p_serial", 2 * (1 - _phi(F.abs(product) / (spread * F.sqrt(F.col("_n") - 1)))))
    t = t.withColumn("p_random", F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial")))
    t = t.withColumn("p_text", evidence(F.col("v"), F.col("_size"), model))
    return t.drop("_a", "_w", "_n", "_size", "_x", "_b", "_u", "_n1", "_n2")


def discovery_limit(tested: DataFrame, fdr: float = FDR) -> float:
    """The p_text up to which tokens are discoveries, by Benjamini-Hochberg over a histogram of at most 400 steps."""
    step = F.least(F.floor(-20 * F.log10(F.greatest("p_text", F.lit(1e-20)))), F.lit(400)).cast("int")
    bins = tested.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.sum("n").over(Window.orderBy(F.col("b").desc()))
    every = F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upper = F.pow(F.lit(10.0), -F.col("b") / 20)
    best = bins.select("b", rank.alias("k"), every.alias("m"), upper.alias("p")).where(F.col("p") <= fdr * F.col("k") / F.col("m")).agg(F.max("p")).first()[0]
    return best if best is not None else 0.0


def detect(documents: DataFrame, alpha: float = ALPHA, fdr: float = FDR) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_more) of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.withColumns({f"_{k}": c for k, c in zip(KINDS, base_spans("_text"))})
    rows = rows.withColumn("_base", F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS])))
    rows = rows.withColumn("_long", free_of(find("_text", LONG, "random", 3, F.col("_text").rlike(LONG)), F.col("_base")))
    rows = durable(rows.drop("_text").withColumn("_row", F.monotonically_increasing_id()), "secrets-marked")
    each = rows.where(F.size("_long") > 0).select("_row", F.explode("_long").alias("x")).withColumn("v", F.col("x.v"))
    model = writing(documents.select(F.col("text").alias("_text")))
    tested = durable(battery(each, model).select("_row", "x", "p_random", "p_text"), "secrets-tested")
    limit = discovery_limit(tested, fdr)
    more = tested.where((F.col("p_random") >= alpha) & (F.col("p_text") <= limit)).groupBy("_row").agg(F.collect_list("x").alias("_y"))
    out = rows.join(more, "_row", "left").withColumn("_more", F.coalesce("_y", F.slice("_base", 1, 0)))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.concat("_base", "_more")).alias("spans"), F.size("_more").cast("long").alias("n_more"))
