"""op1: the word rule rejects what it is for, and every language has a reference."""

from __future__ import annotations

import random


def test_quality_rejects_texts_without_common_words(spark):
    from lorekeep.llm import quality

    rng = random.Random(8)
    rare = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lon", "rint", "sty", "mer")]
    word = lambda: rng.choice(("the", "of", "and", "in", "to")) if rng.random() < 0.4 else rng.choice(rare) + rng.choice("abcdefghij") + rng.choice("klmnop")
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 300))), "en") for i in range(300)]
    rows += [(900, " ".join(rng.choice(rare) + rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(200)), None), (901, " ".join(f"zu{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    references = quality.learn(docs)
    assert sorted(references) == ["en", "zz"]  # 60 words of some 50,000
    got = {r["doc_id"]: r for r in quality.assess(docs, references).collect()}
    assert not got[900]["base_failed"] and not got[900]["kept"]
    assert got[901]["kept"] and got[901]["word_distance"] < 1e-6
    assert sum(got[i]["kept"] for i in range(300)) >= 290


def test_quality_distances_equal_the_dense_ones(spark):
    import numpy as np

    from lorekeep.llm import quality

    references = {"a": (None, {b"x": 0.3, b"y": 0.2}), "b": (None, {b"y": 0.5, b"z": 0.5}), "c": (None, {})}
    shares = quality.WordShares(references)
    for mine in ({b"x": 3, b"z": 2}, {b"y": 7}, {}, {b"x": 5, b"y": 3, b"z": 2}):
        p = np.array([mine.get(w, 0) / 10 for w in (b"x", b"y", b"z")] + [1 - sum(mine.values()) / 10])
        q = np.array([[0.3, 0.2, 0, 0.5], [0, 0.5, 0.5, 0], [0, 0, 0, 1]])
        assert np.allclose(shares.distances({shares.at[w]: n for w, n in mine.items()}, 10), quality.js_distance(p, q))


def test_quality_references_and_verdicts_equal_plain_ones(spark, monkeypatch):
    from collections import Counter

    import numpy as np

    from lorekeep.llm import quality

    monkeypatch.setattr(quality, "CHUNK", 300)
    rng = random.Random(18)
    spell = lambda w: rng.choice((w, w.upper(), w + ",", f"({w})", w.capitalize() + "!", f"“{w}”"))
    rows = [(i, " ".join(spell(rng.choice(("the", "of", "and"))) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 160))), ("en", "xx")[i % 9 == 0]) for i in range(200)]
    rows += [(900, "1234 5678 " * 60, None), (901, None, "en"), (None, "", "en"), (902, "short text", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    references = quality.learn(docs)
    for lang in ("en", "xx", "yy"):
        words = Counter(quality.normal(w) for _, t, x in rows if x == lang for w in (t or "").encode().split())
        total = sum(words.values())
        want = {w: n / total for w, n in words.items() if w and n / total >= quality.COMMON}
        assert references[lang][1].keys() == want.keys() and all(abs(references[lang][1][w] - want[w]) < 1e-12 for w in want)
        classes = np.sum([quality.class_counts(t) for _, t, x in rows if x == lang and t], axis=0)
        assert np.allclose(references[lang][0], classes / classes.sum())
    langs = sorted(references)
    plain = {}
    for i, t, lang in rows:
        words = [quality.normal(w) for w in (t or "").encode().split()]
        if len(words) < quality.LEAST_WORDS:
            continue
        c = quality.class_counts(t)
        by_class = min(float(quality.js_distance(c / c.sum(), references[x][0])) for x in langs)
        by_word = {}
        for x in langs:
            names = sorted(references[x][1].keys() | set(words) & set().union(*(references[y][1] for y in langs)))
            p, q = np.array([words.count(w) / len(words) for w in names]), np.array([references[x][1].get(w, 0.0) for w in names])
            by_word[x] = float(quality.js_distance(np.append(p, 1 - p.sum()), np.append(q, max(0.0, 1 - q.sum()))))
        plain[i] = by_class, min(by_word.values()), min(langs, key=by_word.get), by_word.get(lang)
    fence = {}
    got = {r["doc_id"]: r for r in quality.assess(docs, references).collect()}
    for x in langs:
        own = sorted(int(d[3] * quality.STEPS) for i, d in plain.items() if d[3] is not None and dict((a, c) for a, _, c in rows)[i] == x and not got[i]["base_failed"])
        if own:
            low, high = (next((b + 1) / quality.STEPS for k, b in enumerate(own, 1) if k >= q * len(own)) for q in (0.25, 0.75))
            fence[x] = high + quality.FENCE * (high - low)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        if i not in plain:
            assert r["word_distance"] is None and r["kept"] == (not r["base_failed"])
            continue
        by_class, by_word, near, _ = plain[i]
        assert abs(r["class_distance"] - by_class) < 1e-9 and abs(r["word_distance"] - by_word) < 1e-9
        assert r["kept"] == (not r["base_failed"] and by_class <= quality.CLASS_LIMIT and by_word <= fence.get(near, 9.0))
    assert not got[900]["kept"]
