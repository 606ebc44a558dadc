"""Quality rules by distribution divergence against language references.

The references are learnt from all documents with a language: per language, the histogram of character classes over all
its texts and the shares of its common words in normal form (lower case, no punctuation around), those of at least ``COMMON``
of its words. Counts are exact: a word of that share in all has half of its number in chunks of words where it has half of
its share, so only what passes there is counted in all texts. A text's own two histograms are compared with those of each language by
Jensen-Shannon distance (base 2, 0 to 1); the text fails when even its nearest language lies beyond a limit. The limit of
the words is that language's own: the upper fence of the distances of all its texts (third quartile plus ``FENCE`` times
the distance of the quartiles), from exact counts in ``STEPS`` steps of distance. Texts of fewer than ``LEAST_WORDS``
words are too short to judge by shares and pass the divergence rule; a language none of whose texts is judged has no limit.

Defined results: null, empty and blank texts have zero counts and fail the base rule; with no references (an empty table,
no language given) the divergence rule passes every text; repeated rows get the same result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import durable, texts_of

CLASSES = ("lower", "upper", "other letter", "accented", "digit", "space", "punctuation", "symbol", "other")
COMMON, LEAST_WORDS = 0.004, 50
#: Largest distance to the nearest language by character classes; the fence and the steps of the distances by words.
CLASS_LIMIT, FENCE, STEPS = 0.3, 1.5, 10_000
CHUNK = 1_000_000
SYMBOLS = b"#*$%&|<>"
STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANKS = b" \t\n\x0b\x0c\r"

_table: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The character class of each code point, by its general category; letters beyond ASCII are apart."""
    if not _table:
        t = np.full(0x110000, 8, np.uint8)
        for c in (*range(0x40000), *range(0xE0000, 0xE0200)):  # the others are not assigned
            k = unicodedata.category(chr(c))
            t[c] = (3 if c > 127 else 0) if k == "Ll" else (1 if k == "Lu" else 2) if k[0] in "LM" else 4 if k[0] == "N" else 5 if k[0] == "Z" or 9 <= c <= 13 else 6 if k[0] == "P" else 7 if k[0] == "S" else 8
        for c in SYMBOLS:
            t[c] = 7
        _table.append(t)
    return _table[0]


def class_counts(text: str) -> np.ndarray:
    return np.bincount(class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(CLASSES))


def repeat_words(ids: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of so many words that is found twice or more in the text."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    kinds = int(ids.max()) + 1
    if kinds == len(ids):
        return 0
    code = ids[:n].astype(np.int64)
    size = kinds
    for k in range(1, width):
        if size * kinds >= 1 << 62:  # renumber, so that codes stay exact
            code = np.unique(code, return_inverse=True)[1]
            size = int(code.max()) + 1
        code, size = code * kinds + ids[k : n + k], size * kinds
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def numbered(words: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    known: dict[bytes, int] = {}
    return known, np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def base_counts(text: str | None) -> tuple[tuple[int, int, int, int, int], dict[bytes, int], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the distinct words and the words' numbers."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at ASCII white space only
    known, ids = numbered(words)
    word_chars = len(text or "") - (len(raw) - len(raw.translate(None, BLANKS)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(ids) if words else 0), known, ids


def normal(word: bytes) -> bytes:
    return word.lower().strip(STRIP)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of a distribution p and each row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.sqrt(np.clip(d / 2, 0, 1))


def learn(documents: DataFrame, common: float = COMMON) -> dict[str, tuple[np.ndarray, dict[bytes, float]]]:
    """By language: shares of the character classes, and of the common words."""
    rows = documents.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of at least half that share of some chunk, and the chunks' totals (word null)."""
        held: dict[str, Counter] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            n, words = size.pop(lang), Counter()
            for w, c in held.pop(lang).items():
                words[normal(w)] += c
            out = [(lang, None, n)] + [(lang, w, c) for w, c in words.items() if 2 * c >= common * n]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.int64()))], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                words = text.encode("utf-8", "surrogatepass").split()
                held.setdefault(lang, Counter()).update(words)
                size[lang] = size.get(lang, 0) + len(words)
                if size[lang] > CHUNK:
                    yield flush(lang)
                elif len(held) > 64 and sum(size.values()) > 4 * CHUNK:  # many languages: none may wait for its own chunk
                    for other in list(held):
                        yield flush(other)
        for lang in list(held):
            yield flush(lang)

    found = durable(rows.mapInArrow(heavy, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "quality-words")
    totals = found.where("word is null").select("lang", F.col("n").alias("total"))
    # every language with a word; each has at most 2 / common candidates
    big = {r["lang"]: r["total"] for r in totals.where("total > 0").collect()}
    if not big:
        return {}
    candidates: dict[str, set[bytes]] = {lang: set() for lang in big}
    kept = found.join(totals, "lang").where(F.col("word").isNotNull() & (2 * F.col("n") >= common * F.col("total")))
    for r in kept.select("lang", "word").collect():
        candidates[r["lang"]].add(bytes(r["word"]))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple, int] = Counter()
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                if lang in candidates:
                    own = candidates[lang]
                    for w, n in Counter(text.encode("utf-8", "surrogatepass").split()).items():
                        k = known.get(w)
                        if k is None:
                            if len(known) > 300_000:
                                known.clear()
                            k = known[w] = normal(w)
                        if k in own:
                            words[lang, k, -1] += n
                    for k, n in enumerate(class_counts(text)):
                        words[lang, None, k] += int(n)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in words], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int32()))] + [pa.array(list(words.values()), pa.int64())], names=["lang", "word", "class", "n"])

    counts = rows.mapInArrow(exact, "lang string, word binary, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n")).collect()
    out = {lang: (np.zeros(len(CLASSES)), {}) for lang in sorted(big)}
    for r in counts:
        classes, words = out[r["lang"]]
        if r["word"] is None:
            classes[r["class"]] = r["n"]
        elif r["word"] and r["n"] >= common * big[r["lang"]]:
            words[bytes(r["word"])] = r["n"] / big[r["lang"]]
    return {lang: (classes / max(1.0, classes.sum()), words) for lang, (classes, words) in out.items()}


class WordShares:
    """The languages' shares of common words by word, so that a text meets only the entries of its own words."""

    def __init__(self, references: dict):
        entries: dict[bytes, list[tuple[int, float]]] = {}
        self.rest = np.ones(len(references))
        for j, lang in enumerate(sorted(references)):
            for w, share in references[lang][1].items():
                entries.setdefault(w, []).append((j, share))
                self.rest[j] -= share
        self.rest = np.maximum(self.rest, 0.0)
        self.at = {w: i for i, w in enumerate(sorted(entries))}
        held = [entries[w] for w in self.at]
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int64)
        self.lang = np.array([j for x in held for j, _ in x], np.int64)
        self.share = np.array([s for x in held for _, s in x], np.float64)

    def distances(self, found: dict[int, int], n: int) -> np.ndarray:
        """Jensen-Shannon distance to each language of a text of n words, found: the counts of its common words.

        A word that only one side has adds its share, so the sum is 2 but for the words of both sides.
        """
        total = np.full(len(self.rest), 2.0)
        if found:
            ids = np.fromiter(found, np.int64, len(found))
            size = self.start[ids + 1] - self.start[ids]
            at = np.repeat(self.start[ids] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            p = np.repeat(np.fromiter(found.values(), np.float64, len(found)) / n, size)
            np.add.at(total, self.lang[at], shared_part(p, self.share[at]))
        rest = 1 - sum(found.values()) / n
        if rest > 0:
            total += np.where(self.rest > 0, shared_part(rest, np.where(self.rest > 0, self.rest, 1.0)), 0.0)
        return np.sqrt(np.clip(total / 2, 0, 1))


def shared_part(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    m = (p + q) / 2
    return p * np.log2(p / m) + q * np.log2(q / m) - p - q


def distances(documents: DataFrame, references: dict, least_words: int = LEAST_WORDS) -> DataFrame:
    """The base counts, the nearest language's distances and name by words (null if not judged) and the own language's distance by words."""
    langs = sorted(references)
    classes = np.array([references[x][0] for x in langs]).reshape(len(langs), len(CLASSES))
    sent = documents.sparkSession.sparkContext.broadcast((langs, {x: j for j, x in enumerate(langs)}, classes, WordShares(references)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, place, classes, words = sent.value
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for text, lang in zip(texts_of(batch), texts_of(batch, "lang")):
                counts, distinct, ids = base_counts(text)
                n, repeats = counts[0], counts[4]
                failed = n < 10 or 100 * repeats > 20 * n
                judged = (None,) * 4
                if n >= least_words and langs:
                    c = class_counts(text)
                    mine: dict[int, int] = {}
                    if len(known) > 300_000:
                        known.clear()
                    for w, m in zip(distinct, np.bincount(ids).tolist()):
                        k = known.get(w)
                        if k is None:
                            k = known[w] = words.at.get(normal(w), -1)
                        if k >= 0:
                            mine[k] = mine.get(k, 0) + m
                    d = words.distances(mine, n)
                    j = int(np.argmin(d))
                    judged = float(js_distance(c / c.sum(), classes).min()), float(d[j]), langs[j], float(d[place[lang]]) if lang in place else None
                rows.append((*counts, failed, *judged, lang))
            cols = list(zip(*rows)) or [()] * 11
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 2 + [pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", *MEASURED])

    lang = F.col("lang").cast("string").alias("lang") if "lang" in documents.columns else F.lit(None).cast("string").alias("lang")
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, near string, own_distance double, lang string"
    return documents.select(F.col("doc_id").cast("long"), "text", lang).mapInArrow(run, schema)


def word_limits(measured: DataFrame, fence: float = FENCE) -> DataFrame:
    """(near, word_limit): every language's upper fence over all its judged texts that pass the base rule, by exact counts in steps."""
    step = F.floor(F.col("own_distance") * STEPS).cast("int")
    bins = measured.where("own_distance is not null and not base_failed").groupBy("lang", step.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("b"))
    ranked = bins.withColumns({"k": below, "m": F.sum("n").over(Window.partitionBy("lang"))})
    quartile = lambda q: F.min(F.when(F.col("k") >= q * F.col("m"), (F.col("b") + 1) / STEPS))
    both = ranked.groupBy(F.col("lang").alias("near")).agg(quartile(0.25).alias("low"), quartile(0.75).alias("high"))
    return both.select("near", (F.col("high") + fence * (F.col("high") - F.col("low"))).alias("word_limit"))


def assess(documents: DataFrame, references: dict, least_words: int = LEAST_WORDS, class_limit: float = CLASS_LIMIT, fence: float = FENCE) -> DataFrame:
    """The base counts, both distances to the nearest language (null if not judged) and the verdict of every document."""
    measured = durable(distances(documents, references, least_words), "quality-distances")
    rows = measured.join(F.broadcast(word_limits(measured, fence)), "near", "left")  # a row a language, as the references
    diverges = F.coalesce((F.col("class_distance") > class_limit) | (F.col("word_distance") > F.col("word_limit")), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~diverges).select(*NAMES)


MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "near", "own_distance", "lang"]
NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


def rules(documents: DataFrame, **kw) -> DataFrame:
    """Base counts and verdicts of all documents, against references learnt from all of them."""
    return assess(documents, learn(documents), **kw)
