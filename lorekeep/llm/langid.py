"""Language identification by interpolated Kneser-Ney character trigram models, one per language.

Training counts all character trigrams of all texts with a language (exact 63-bit keys of three code points); lower
orders are continuation counts, that is, numbers of distinct left neighbours. Spark sums the counts per language and trigram
and makes the probabilities by joins; a model then is a sorted array of keys and one of logs for each language and order. While
all models together have ``BROADCAST_ROWS`` rows at most they go to every task; beyond that, they are joined with the
trigrams of the texts. A text goes to the language of the lowest cross-entropy per character; its score is the posterior from the
entropies and the text's length, and ``rejected`` marks texts whose best entropy lies above the language's calibrated
limit (mean plus ``REJECT`` deviations of the entropies of all training texts that go to the language). A language to
which fewer than ``FEW`` training texts go takes the limit of all training texts together; with fewer in all there is
nothing to calibrate by and only texts without a language are rejected.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any training text every text is
``und``; ties go to the first language by name; repeated rows get the same result; an empty table gives an empty result;
other columns are ignored. Digits and punctuation do not count: every run of non-letters is one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable, texts_of

DISCOUNT, REJECT = 0.75, 4.0
#: Training texts that a language needs for a limit of its own.
FEW = 10
#: Rows of a model that is broadcast (12 bytes each); a larger one is joined.
BROADCAST_ROWS = 4_000_000
#: Characters gathered before a task sums its trigrams up.
CHUNK = 4_000_000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """By code point: the lower-case letter's code point, or a space for what is no letter."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x40000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def letters(text: str | None) -> np.ndarray:
    """Code points of the text's words, one space before, between and after them; empty if there is no letter."""
    if not text:
        return np.zeros(0, np.uint64)
    a = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = a == 32
    a = a[~(space & np.append(True, space[:-1]))]
    if not len(a):
        return np.zeros(0, np.uint64)
    tail = [] if a[-1] == 32 else [32]
    return np.concatenate(([32], a, tail)).astype(np.uint64)


def trigrams(a: np.ndarray) -> np.ndarray:
    """Keys of three code points each: 21 bits a code point."""
    return (a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:]


def count_trigrams(texts: DataFrame) -> DataFrame:
    """(lang, g, n) over rows of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            g, n = np.unique(trigrams(np.concatenate(held.pop(lang))), return_counts=True)
            size.pop(lang)
            two = np.uint64(32 << 21 | 32)  # two spaces stand only between texts
            inner = (g >> np.uint64(21) != two) & (g & np.uint64((1 << 42) - 1) != two)
            return pa.RecordBatch.from_arrays([pa.array([lang] * int(inner.sum()), pa.string()), pa.array(g[inner].astype(np.int64)), pa.array(n[inner].astype(np.int64))], names=["lang", "g", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                a = letters(text)
                if len(a) > 2:
                    held.setdefault(lang, []).append(a)
                    size[lang] = size.get(lang, 0) + len(a)
                    if size[lang] > CHUNK:
                        yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    return texts.select("lang", "text").mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def model_table(counts: DataFrame) -> DataFrame:
    """(lang, kind, key, value): each language's model, from rows (lang, g, n) of distinct trigrams.

    kind 3, 2 and 1: log probabilities of the trigrams, pairs and characters seen; 33 and 22: log weights of the lower order
    after the pairs and characters seen as contexts; 0: the log probability of a character not seen.
    """
    d, pair, char = DISCOUNT, F.lit((1 << 42) - 1), F.lit((1 << 21) - 1)
    tri = durable(counts, "langid-trigrams")
    bi = tri.groupBy("lang", F.col("g").bitwiseAND(pair).alias("two")).agg(F.count(F.lit(1)).alias("c2"))
    bi = durable(bi, "langid-pairs")
    uni = durable(bi.groupBy("lang", F.col("two").bitwiseAND(char).alias("one")).agg(F.count(F.lit(1)).alias("c1")), "langid-characters")
    signs = uni.agg(F.count_distinct("one")).first()[0] + 1
    total = uni.groupBy("lang").agg(F.sum("c1").alias("t1"), (d * F.count(F.lit(1)) / F.sum("c1") / signs).alias("none"))
    p1 = uni.join(F.broadcast(total), "lang").select("lang", "one", ((F.col("c1") - d) / F.col("t1") + F.col("none")).alias("p1"))  # a row a language
    ctx2 = bi.groupBy("lang", F.shiftright("two", 21).alias("ctx")).agg(F.sum("c2").alias("mass"), (d * F.count(F.lit(1)) / F.sum("c2")).alias("rest"))
    p2 = bi.withColumns({"ctx": F.shiftright("two", 21), "one": F.col("two").bitwiseAND(char)}).join(ctx2, ["lang", "ctx"]).join(p1, ["lang", "one"])
    p2 = durable(p2.select("lang", "two", ((F.col("c2") - d) / F.col("mass") + F.col("rest") * F.col("p1")).alias("p2")), "langid-p2")
    ctx3 = tri.groupBy("lang", F.shiftright("g", 21).alias("ctx")).agg(F.sum("n").alias("mass"), (d * F.count(F.lit(1)) / F.sum("n")).alias("rest"))
    p3 = tri.withColumns({"ctx": F.shiftright("g", 21), "two": F.col("g").bitwiseAND(pair)}).join(ctx3, ["lang", "ctx"]).join(p2, ["lang", "two"])
    parts = [
        (p3.select("lang", "g", ((F.col("n") - d) / F.col("mass") + F.col("rest") * F.col("p2"))), 3), (p2, 2), (p1, 1),
        (ctx3.select("lang", "ctx", "rest"), 33), (ctx2.select("lang", "ctx", "rest"), 22), (total.select("lang", F.lit(0).cast("long"), "none"), 0),
    ]
    out = None
    for df, kind in parts:
        lang, key, value = (F.col(f"`{c}`") for c in df.columns)
        part = df.select(lang.alias("lang"), F.lit(kind).alias("kind"), key.alias("key"), F.log(value).alias("value"))
        out = part if out is None else out.unionByName(part)
    return durable(out, "langid-model")


class Models:
    """Per language, sorted key arrays with log values for each kind of ``model_table``."""

    def __init__(self, table: pa.Table):
        self.parts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        self.langs: list[str] = []
        if not table.num_rows:
            return
        lang, kind = table.column("lang").combine_chunks().dictionary_encode(), table.column("kind").to_numpy()
        key, value = table.column("key").to_numpy().astype(np.uint64), table.column("value").to_numpy().astype(np.float32)
        code = lang.indices.to_numpy()
        order = np.lexsort((key, kind, code))
        edge = np.flatnonzero(np.append(True, (np.diff(code[order]) != 0) | (np.diff(kind[order]) != 0)))
        for lo, hi in zip(edge, np.append(edge[1:], len(order))):
            at = order[lo:hi]
            self.parts.setdefault(str(lang.dictionary[int(code[at[0]])]), {})[int(kind[at[0]])] = key[at], value[at]
        self.langs = sorted(self.parts)

    def entropies(self, a: np.ndarray) -> np.ndarray:
        """Nats per character of the padded letters, by language."""
        g, n = np.unique(trigrams(a), return_counts=True)
        return np.array([-(self._log(self.parts[x], g) * n).sum() / n.sum() for x in self.langs])

    @staticmethod
    def _log(part: dict[int, tuple[np.ndarray, np.ndarray]], g: np.ndarray) -> np.ndarray:
        def find(kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, values = part[kind]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return keys[at] == wanted, values[at].astype(np.float64)

        seen, out = find(3, g)
        miss = np.flatnonzero(~seen)
        if len(miss):  # never seen: the lower orders, with the context's weight where it is known
            two, pair, char = g[miss] & np.uint64((1 << 42) - 1), np.uint64(21), np.uint64((1 << 21) - 1)
            known, low = find(2, two)
            one, p1 = find(1, two & char)
            after, rest = find(22, two >> pair)
            low = np.where(known, low, np.where(one, p1, float(part[0][1][0])) + np.where(after, rest, 0.0))
            after, rest = find(33, g[miss] >> pair)
            out[miss] = low + np.where(after, rest, 0.0)
        return out


def learn(texts: DataFrame) -> DataFrame:
    """The model table of rows of (lang, text)."""
    return model_table(count_trigrams(texts.where("lang is not null and text is not null")))


def verdict(h: np.ndarray, size: int, langs: list[str], limits: dict[str, tuple[float, float]]) -> tuple:
    """(lang_pred, score, cross_entropy, rejected) from the entropies of a text of so many letters."""
    k = int(np.argmin(h))
    # neighbouring trigrams overlap: a third of the characters counts as independent
    odds = np.exp(-np.minimum((h - h[k]) * (size / 3), 700.0))
    mean, dev = limits.get(langs[k], (np.inf, 0.0))
    return langs[k], float(1 / odds.sum()), float(h[k]), bool(h[k] > mean + REJECT * dev * (1 + 5 / np.sqrt(size)))


UND = ("und", 0.0, None, True)
KINDS = (pa.string(), pa.float64(), pa.float64(), pa.bool_())


def predict(documents: DataFrame, model: DataFrame, limits: dict[str, tuple[float, float]] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every document.

    A model of up to broadcast_rows rows goes to every task as sorted arrays; a larger one is joined with the texts' trigrams.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model.count() > broadcast_rows:
        return _predict_joined(docs, model, limits or {})
    sent = documents.sparkSession.sparkContext.broadcast((Models(model.toArrow()), limits or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, limits = sent.value
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                a = letters(text)
                rows.append(verdict(models.entropies(a), len(a), models.langs, limits) if len(a) > 2 and models.langs else UND)
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, KINDS))], names=["doc_id", *PREDICTED])

    return docs.mapInArrow(run, SCHEMA)


def _predict_joined(docs: DataFrame, model: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """The same by joins: log probabilities of every trigram of the texts in every language, then sums by text."""
    langs = [r["lang"] for r in model.where("kind = 0").orderBy("lang").collect()]  # a row a language
    none = {r["lang"]: r["value"] for r in model.where("kind = 0").collect()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = letters(text)
                if len(a) > 2:
                    g, n = np.unique(trigrams(a), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), uid)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["uid", "g", "n"])

    docs = durable(docs.withColumn("uid", F.monotonically_increasing_id()), "langid-docs")
    met = durable(docs.select("uid", "text").mapInArrow(split, "uid long, g long, n long"), "langid-met")
    each = met.select("g").distinct().withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs])))
    each = each.withColumns({"k3": F.col("g"), "k33": F.shiftright("g", 21), "k2": F.col("g").bitwiseAND(F.lit((1 << 42) - 1)), "k1": F.col("g").bitwiseAND(F.lit((1 << 21) - 1))})
    each = each.withColumn("k22", F.shiftright("k2", 21))
    for kind in (3, 33, 2, 22, 1):
        part = model.where(F.col("kind") == kind).select("lang", F.col("key").alias(f"k{kind}"), F.col("value").alias(f"v{kind}"))
        each = each.join(part, ["lang", f"k{kind}"], "left")
    unseen = F.element_at(F.create_map(*[F.lit(x) for kv in none.items() for x in kv]), F.col("lang"))
    low = F.coalesce("v2", F.coalesce("v1", unseen) + F.coalesce("v22", F.lit(0.0)))
    log = each.select("g", F.struct("lang", F.coalesce("v3", low + F.coalesce("v33", F.lit(0.0))).alias("v")).alias("x")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("v"))
    sums = met.join(log, "g").groupBy("uid").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.get("v", F.lit(j))).alias(f"s{j}") for j in range(len(langs))])
    found = docs.select("uid", "doc_id").join(sums, "uid", "left").select("doc_id", "n", F.when(F.col("n").isNotNull(), F.array(*[-F.col(f"s{j}") / F.col("n") for j in range(len(langs))])).alias("h"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [UND if n is None else verdict(np.array(h), n + 2, langs, limits) for n, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, KINDS))], names=["doc_id", *PREDICTED])

    return found.mapInArrow(decide, SCHEMA)


PREDICTED = ["lang_pred", "score", "cross_entropy", "rejected"]
SCHEMA = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def calibrate(scored: DataFrame, langs: list[str], few: int = FEW) -> dict[str, tuple[float, float]]:
    """Mean and deviation of the entropies by language, from the predictions of all training texts."""
    parts = scored.where("cross_entropy is not null").groupBy("lang_pred").agg(F.count(F.lit(1)), F.avg("cross_entropy"), F.stddev_pop("cross_entropy")).collect()
    whole = sum(n for _, n, _, _ in parts)
    if whole < few:
        return {}
    mean = sum(n * m for _, n, m, _ in parts) / whole
    rest = mean, float(np.sqrt(sum(n * (d * d + (m - mean) ** 2) for _, n, m, d in parts) / whole))
    own = {lang: (m, d) for lang, n, m, d in parts if n >= few}
    return {lang: own.get(lang, rest) for lang in langs}


def identify(documents: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Predictions for every document, learnt from those with a language outside the held-out fold."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    training = documents.where(~out).select(F.col("lang").cast("string").alias("lang"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    model = learn(training)
    langs = [r["lang"] for r in model.where("kind = 0").collect()]  # a row a language
    limits = calibrate(predict(training.where("lang is not null and text is not null"), model), langs)
    return predict(documents, model, limits).select("doc_id", out.alias("held_out"), *PREDICTED)
