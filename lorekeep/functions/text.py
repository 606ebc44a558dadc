"""Text rules as column expressions: normal forms, tokens, estimates, similarity, escaping."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: Fixed values of the token estimate: tokens per CJK character and per other character.
TOKENS_PER_CJK, TOKENS_PER_OTHER = 0.9408, 0.2441


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def squeeze(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def normalize(text: Column, compatibility: bool = False) -> Column:
    """H1: lower case, one space between words; with compatibility, NFKC first (an Arrow UDF, as Spark has none)."""
    text = F.coalesce(text, F.lit(""))
    return squeeze(F.lower(_nfkc(text) if compatibility else text))


def normalize_baseline(text: Column, compatibility: bool = False) -> Column:
    """H1, baseline form: zero-width characters go too."""
    return squeeze(F.lower(F.regexp_replace(_nfkc(F.coalesce(text, F.lit(""))) if compatibility else F.coalesce(text, F.lit("")), "[​-‍﻿]", "")))


def _grams(run: Column, sizes: tuple[int, ...]) -> Column:
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(run) - (n - 1))
        return F.when(F.length(run) >= n, F.transform(starts, lambda i: F.substr(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    parts = [of(n) for n in sizes]
    return F.concat(F.when(F.length(run) == 1, F.array(run)).otherwise(F.array().cast("array<string>")), *parts)


def tokens_hybrid(text: Column) -> Column:
    """H2: Latin words of two characters or more; CJK runs as 2- and 3-grams, a lone character as itself. Keeps repeats."""
    runs = F.regexp_extract_all(normalize(text), F.lit(f"([a-z0-9_]+|[{CJK}]+)"), F.lit(1))
    word = lambda r: r.rlike("^[a-z0-9_]+$")
    return F.flatten(F.transform(runs, lambda r: F.when(word(r), F.when(F.length(r) >= 2, F.array(r)).otherwise(F.array().cast("array<string>"))).otherwise(_grams(r, (2, 3)))))


def tokens_baseline(text: Column) -> Column:
    """H3: distinct tokens; Latin ones may go on with ``.:/+-``, Han runs give 2- and 3-grams."""
    t = normalize_baseline(text)
    latin = F.regexp_extract_all(t, F.lit(r"([a-z0-9_][a-z0-9_.:/+-]*)"), F.lit(1))
    han = F.flatten(F.transform(F.regexp_extract_all(t, F.lit("([㐀-鿿]+)"), F.lit(1)), lambda r: _grams(r, (2, 3))))
    return F.array_distinct(F.concat(latin, han))


def tokens_scene(text: Column) -> Column:
    """H3, scene form: distinct Latin words of two characters or more and Han bigrams."""
    t = normalize(text)
    latin = F.regexp_extract_all(t, F.lit("([a-z0-9_]{2,})"), F.lit(1))
    return F.array_distinct(F.concat(latin, F.flatten(F.transform(F.regexp_extract_all(t, F.lit("([㐀-鿿]+)"), F.lit(1)), lambda r: _grams(r, (2,))))))


def words(text: Column) -> Column:
    """H5: runs of letters and digits, lower case; CJK runs as bigrams, since no word segmenter is at hand."""
    runs = F.regexp_extract_all(normalize(text), F.lit(rf"([{CJK}]+|[\p{{L}}\p{{N}}_&&[^{CJK}]]+)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), _grams(r, (2,))).otherwise(F.array(r))))


def word_coverage(query: Column, document: Column) -> Column:
    """H5: share of the query's distinct words, by length, that the document has."""
    q = F.array_distinct(query)
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, w: s + F.length(w))
    return F.when(size(q) > 0, size(F.array_intersect(q, document)) / size(q)).otherwise(0.0)


def phrase_hits(query: Column, text: Column) -> Column:
    """H5: adjacent query words that are adjacent in the text too, with at most two other characters between."""
    pairs = F.array_distinct(F.zip_with(F.slice(query, F.lit(1), F.greatest(F.size(query) - 1, F.lit(0))), F.slice(query, F.lit(2), F.greatest(F.size(query) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(r"[^\p{L}\p{N}]{0,2}"), b)))
    return F.size(F.filter(pairs, lambda p: F.regexp_like(normalize(text), p)))


def lexical_similarity(a: Column, b: Column) -> Column:
    """H4: 1 for equal texts, 0.88 to 0.99 if one (8 characters or more) is inside the other, else token overlap."""
    a, b = normalize_baseline(a), normalize_baseline(b)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) > F.length(b), a).otherwise(b)
    ta, tb = tokens_baseline(a), tokens_baseline(b)
    both = F.size(F.array_intersect(ta, tb))
    least = F.least(F.size(ta), F.size(tb))
    overlap = F.when(least > 0, F.greatest(both / (F.size(ta) + F.size(tb) - both), 0.92 * both / least)).otherwise(0.0)
    inside = F.least(F.lit(0.99), 0.88 + 0.11 * F.length(short) / F.length(long))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when((F.length(short) >= 8) & F.contains(long, short), inside).otherwise(overlap)


def overlap_similarity(both: Column, m: Column, n: Column, a: Column, b: Column) -> Column:
    """H4 from the number of common tokens, the sizes of the token sets and the normal forms of the texts."""
    small, large = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    overlap = F.when(F.least(m, n) > 0, F.greatest(both / (m + n - both), 0.92 * both / F.least(m, n))).otherwise(0.0)
    inside = (small >= 8) & (F.contains(a, b) | F.contains(b, a))
    return F.when(small == 0, 0.0).when(a == b, 1.0).when(inside, F.least(F.lit(0.99), 0.88 + 0.11 * small / large)).otherwise(overlap)


def cjk_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{CJK}]", ""))


def estimate_tokens(text: Column) -> Column:
    """H6: estimated tokens, one at least; null or empty text has none."""
    cjk, size = cjk_count(text), F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(TOKENS_PER_CJK * cjk + TOKENS_PER_OTHER * (size - cjk)))).cast("long")


def tokens_to_chars(n_tokens: Column, sample: Column) -> Column:
    """H6: characters that so many tokens hold, at the sample's ratio."""
    ratio = F.when(estimate_tokens(sample) > 0, F.length(sample) / estimate_tokens(sample)).otherwise(1 / TOKENS_PER_OTHER)
    return F.floor(n_tokens * ratio).cast("long")


def digest(text: Column) -> Column:
    """Sixty bits of a text's MD5 as a number, which other engines can compute too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fnv1a32(text: Column) -> Column:
    """H7: 32-bit FNV-1a over the characters' code points, which beyond the first plane differ from UTF-16 units; ids here are 64-bit hashes."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619), F.lit(1 << 32))
    return F.aggregate(chars, F.lit(2166136261).cast("long"), step)


def strip_summary(text: Column) -> Column:
    """Summary and operation blocks go, three newlines or more become two."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(summary|memory_ops)>.*?</\1>", ""), r"\n{3,}", "\n\n"))


def xml_escape(text: Column) -> Column:
    """H17."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def distinct_ordered(values: Column, cap: int | None = None) -> Column:
    """Distinct trimmed values that aren't empty, in order, at most cap."""
    out = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return out if cap is None else F.slice(out, 1, cap)


def is_provider_error(text: Column) -> Column:
    """A short text that reports a failed call."""
    return (F.length(text) <= 800) & F.trim(text).rlike(r"(?is)^\s*\[?(api |http |provider )?error\b|\bHTTP\s*[45]\d\d\b|\b(quota|rate limit)\b.*\b(exceeded|reached)\b|\btimed? ?out\b")


def is_starved_json(text: Column) -> Column:
    """Begins an object, but isn't JSON."""
    return F.trim(text).startswith("{") & F.try_parse_json(text).isNull()


def retrieval_text(scope: Column, entities: Column, topics: Column, text: Column) -> Column:
    """``{scope} [entities - topics] text``."""
    left = F.array_join(F.filter(F.array(F.array_join(distinct_ordered(entities), ", "), F.array_join(distinct_ordered(topics), ", ")), lambda x: x != ""), " — ")
    head = F.when(F.trim(scope) != "", F.concat(F.lit("{"), F.trim(scope), F.lit("} "))).otherwise("")
    return F.trim(F.concat(F.coalesce(head, F.lit("")), F.when(left != "", F.concat(F.lit("["), left, F.lit("] "))).otherwise(""), F.trim(text)))
