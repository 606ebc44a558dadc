"""op8: the model table against a plain Kneser-Ney model; the joined form against the broadcast one; ties and awkward rows."""

from __future__ import annotations

import math
import random
from collections import Counter

PARTS = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["zu", "lo", "qo", "vi"], "cc": ["𰀀漢", "字语"]}


def plain_log(texts, d, signs):
    """log p(c | a b) by interpolated Kneser-Ney over the texts, as a function of three characters."""
    tri = Counter()
    for t in texts:
        p = " " + " ".join(t.split()) + " "
        tri.update(p[i : i + 3] for i in range(len(p) - 2))
    bi, uni = Counter(g[1:] for g in tri), None
    uni = Counter(b[1] for b in bi)

    def p1(c):
        return max(uni[c] - d, 0) / sum(uni.values()) + d * len(uni) / sum(uni.values()) / signs

    def p2(b, c):
        mass, kinds = sum(n for x, n in bi.items() if x[0] == b), sum(x[0] == b for x in bi)
        return p1(c) if not mass else max(bi[b + c] - d, 0) / mass + d * kinds / mass * p1(c)

    def p3(a, b, c):
        mass, kinds = sum(n for x, n in tri.items() if x[:2] == a + b), sum(x[:2] == a + b for x in tri)
        return p2(b, c) if not mass else max(tri[a + b + c] - d, 0) / mass + d * kinds / mass * p2(b, c)

    return lambda g: math.log(p3(*g)), set(uni)


def test_model_equals_a_plain_one_and_the_joined_form_the_broadcast(spark):
    from lorekeep.llm import langid

    rng = random.Random(3)
    text = lambda lang, n: " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(3, 12)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    signs = len({c for *_, t, _ in [(0, *r[1:]) for r in rows] for c in t} | {" "}) + 1
    plain = {lang: plain_log([t for _, t, x in rows if x == lang], langid.DISCOUNT, signs) for lang in PARTS}
    probe = [(i, t) for i, t, _ in rows[:12]] + [(100, "kalozu qomi"), (101, "漢字"), (102, "xyz kal"), (103, None), (104, "12 !?"), (105, ""), (None, "ka lo"), (106, "𰀀")]
    docs = spark.createDataFrame(probe, "doc_id long, text string")
    one = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    two = {r["doc_id"]: r for r in langid.predict(docs, model, broadcast_rows=0).collect()}
    assert len(one) == len(two) == len(probe)
    for i, t in probe:
        assert one[i]["lang_pred"] == two[i]["lang_pred"] and abs(one[i]["score"] - two[i]["score"]) < 1e-4
        if one[i]["lang_pred"] == "und":
            assert i in (103, 104, 105)
            continue
        p = " " + " ".join(t.split()) + " "
        grams = [p[k : k + 3] for k in range(len(p) - 2)]
        h = {lang: -sum(f(g) for g in grams) / len(grams) for lang, (f, _) in plain.items()}
        best = min(sorted(h), key=h.get)
        assert abs(one[i]["cross_entropy"] - h[best]) < 1e-4 and abs(two[i]["cross_entropy"] - h[best]) < 1e-6
        assert one[i]["lang_pred"] == best


def test_ties_and_very_long_texts(spark):
    from lorekeep.llm import langid

    rows = [(i, "ka lo mi", lang) for i in range(1, 40) for lang in ("xx", "ww")] + [(500, "ka lo " * 100_000, None), (501, "ka", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "ww" and abs(got[501]["score"] - 0.5) < 1e-9
