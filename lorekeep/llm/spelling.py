"""Words one insertion, deletion or replacement apart, by an index of grams of varying length.

The gram dictionary starts from grams of ``LEAST`` code points; a gram is lengthened by one while it is *frequent*, up to
``MOST`` code points. Only frequent grams need be known to cut a word up: at every place the longest gram of the dictionary
is taken, and kept if no gram before it covers it. One edit can only affect the kept grams that hold its place, those that
a longer gram across it may cover, and a last gram that more letters would lengthen; the largest number of them over all
places is the word's bound. So of two words one edit apart at least one gram among each one's (bound + 1) first, in an order
that both share (rarest first), is the same, at a place that differs by one at most. Those lists alone are merged; pairs
that meet in one, agree before or after it and have all but two letters in common, are verified by their edit distance in the
join itself.

Grams of one length bound the edits as well: words of ``LEAST`` + 2 * ``LEAST`` - 2 code points and more always keep one in
common. Where the grams of varying length leave a word without such a promise, it goes into a second index of grams of
``LEAST`` code points, together with the other words without one.

Defined results: null and empty texts have no words; a null doc_id counts as an empty string before the colon; repeated rows
count each; ties between near words of equal counts go to the first in code-point order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LETTERS, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least and largest gram; a gram is frequent from RARE words on, and at most FREQUENT grams of a length are.
LEAST, MOST, RARE, FREQUENT = 3, 6, 40, 60_000
#: A form has so many times the occurrences of its word at least.
TIMES = 10
#: Words of a list that are compared in one block.
LIST = 2048


def words(documents: DataFrame, least: int = 7, twice: int = 2) -> DataFrame:
    """(word, n): the words of all texts with planted slips: a run loses a code point where its hash says so."""
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least).withColumn("run", F.translate("run", LETTERS, LOWER))
    h = F.crc32(F.concat_ws(":", "doc", "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def frequent(dictionary: DataFrame, rare: int = RARE, most: int = FREQUENT) -> DataFrame:
    """(gram, m): the grams of LEAST to MOST - 1 code points with m places in the words, where m is large enough.

    A place counts once for each length, so no more than ``most`` grams of a length can have places / most of them, and the
    limit grows with the words once that exceeds ``rare``.
    """
    places = dictionary.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("p")).first()[0]
    limit = max(rare, -(-places // most))
    long = F.col("length") <= F.length("word") - F.col("at") + 1
    at = dictionary.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - LEAST + 1)).alias("at"))
    grams = at.select("word", "at", F.explode(F.array(*[F.lit(k) for k in range(LEAST, MOST)])).alias("length")).where(long)
    counted = grams.select(F.substring(F.col("word"), F.col("at"), F.col("length")).alias("gram")).groupBy("gram").agg(F.count("*").alias("m"))
    return counted.where(F.col("m") >= limit)


def grams(word: str, known: dict[str, int], most: int = MOST) -> list[tuple[int, int]]:
    """(from, to) of the kept grams of a word of at least LEAST code points."""
    out, covered = [], 0
    for p in range(len(word) - LEAST + 1):
        e = p + LEAST
        while e - p < most and e < len(word) and word[p:e] in known:
            e += 1
        if e > covered:
            out.append((p, e))
            covered = e
    return out


def bound(word: str, kept: list[tuple[int, int]], known: dict[str, int], most: int = MOST) -> int:
    """How many of the kept grams one edit can affect at most."""
    n = len(word)
    change, insert = [0] * (n + 1), [0] * (n + 1)

    def may_grow(inner: str) -> bool:  # a longer gram across the edit ends with it
        return len(inner) < LEAST or len(inner) >= most or inner in known

    for p, e in kept:
        for i in range(p, e):
            change[i] += 1
        for i in range(p + 1, e):
            insert[i] += 1
        for i in range(max(0, e - most - 1), p):
            change[i] += may_grow(word[i + 1 : e - 1])
        for i in range(max(0, e - most), p + 1):
            insert[i] += may_grow(word[i : e - 1])
        if e == n and e - p < most and word[p:e] in known:
            insert[n] += 1
    return max(change + insert)


def letters(word: str) -> int:
    """31 bits that say which code points a word has; one edit changes two of them at most."""
    out = 0
    for c in word:
        out |= 1 << ord(c) % 31
    return out


def lists(dictionary: DataFrame, known: DataFrame) -> DataFrame:
    """(word, gram, at, sign): the grams of each word whose lists are merged, and its letters; grams of the second index begin with a blank."""
    spark = dictionary.sparkSession
    # at most FREQUENT grams for each of MOST - LEAST lengths
    held = spark.sparkContext.broadcast({r["gram"]: r["m"] for r in known.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for batch in batches:
            out: list[tuple] = []
            for word in batch.column(0).to_pylist():
                kept = grams(word, common)
                loses = bound(word, kept, common)
                rank = sorted((common.get(word[p:e], 0), word[p:e], p) for p, e in kept)
                sign = letters(word)
                out += [(word, g, p, sign) for _, g, p in rank[: loses + 1]]
                if loses >= len(kept):
                    plain = sorted((common.get(word[p : p + LEAST], 0), word[p : p + LEAST], p) for p in range(len(word) - LEAST + 1))
                    out += [(word, " " + g, p, sign) for _, g, p in plain[: LEAST + 1]]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["word", "gram", "at", "sign"])

    return dictionary.select("word").mapInArrow(run, "word string, gram string, at int, sign int")


def near(dictionary: DataFrame) -> DataFrame:
    """(a, b): every two words exactly one insertion, deletion or replacement apart, once; b is the longer, or the later of two as long."""
    known = durable(frequent(dictionary), "spelling-frequent")
    found = durable(lists(dictionary, known), "spelling-lists")
    # a common gram lies before or after the edit, so what is on its other side is the same in both words: it is part of the key
    n, at = F.length("word"), F.col("at")
    before, after = F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 1, n)
    key = lambda side, n, at: F.xxhash64("gram", F.lit(side), n, at, before if side == 0 else after)
    held = found.select(F.col("word").alias("b"), F.col("sign").alias("sb"), F.explode(F.array(key(0, n, at), key(1, n, at))).alias("key"))
    # long lists are split into blocks; what asks for them asks for every block
    sizes = held.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > LIST).select("key", F.ceil(F.col("size") / LIST).cast("int").alias("blocks"))
    sizes = durable(sizes, "spelling-long")
    asks = found.select(F.col("word").alias("a"), F.col("sign").alias("sa"), F.explode(F.array(key(0, n, at), key(1, n, at), key(0, n + 1, at), key(1, n + 1, at + 1))).alias("key"))
    if sizes.isEmpty():
        met = asks.join(held, "key")
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        held = held.join(sizes, "key", "left").select("b", "sb", "key", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))
        asks = asks.join(sizes, "key", "left").select("a", "sa", "key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        met = asks.join(held, ["key", "block"])
    order = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    alike = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2
    return met.where(alike & order & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts (op11)."""
    dictionary = durable(words(documents), "spelling-words")
    pairs = durable(near(dictionary), "spelling-near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(dictionary.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.max("m").alias("form_n"))
    first = both.join(best.select(F.col("word").alias("a"), F.col("form_n").alias("m")), ["a", "m"]).groupBy(F.col("a").alias("word")).agg(F.min("b").alias("form"))
    out = dictionary.join(best, "word", "left").join(first, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    good = F.col("form_n") >= TIMES * F.col("n")
    out = durable(out.withColumns({"form": F.when(good, F.col("form")), "form_n": F.when(good, F.col("form_n"))}), "spelling-forms")
    # counts grow tenfold along forms: the chains have at most some twenty words, and four doublings reach their ends
    to = durable(out.where("form is not null").select("word", F.col("form").alias("root")), "spelling-root0")
    k = 0
    while True:
        k += 1
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = durable(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"spelling-root{k}")
        if to.where("moved").isEmpty():
            break
        to = to.drop("moved")
    return out.join(to.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
