"""Each stage of the pipeline against a plain version over its own input."""

from __future__ import annotations

import random
import re

from . import brute

rng = random.Random(8)
VOCAB = [f"w{i}" for i in range(300)]


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from lorekeep.llm import toxicity

    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(VOCAB) for _ in range(rng.randint(20, 60))]
        if i % 6 == 0:
            words += ["awful", "nasty"]
        text = " ".join(words)
        if i % 7 == 3 and i > 20:
            text = rows[i - 20][1] + (" tail" if i % 2 else "")
        if i % 11 == 5:
            text += f" mail me{i}@example.com or 10.0.0.{i % 250} now"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int("awful" in text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs, columns, seen = spark.read.parquet(f"{sf}/documents.parquet"), None, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]

    given, kept = seen["toxicity"]
    bad = {r["doc_id"] for r in toxicity.detect(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in given} - bad and bad

    given, kept = seen["near duplicates"]
    ids, sets = [r["doc_id"] for r in given], [brute.shingle_set(r["text"], 5) for r in given]
    assert sorted(r["doc_id"] for r in kept) == sorted(set(brute.least_reachable(ids, brute.linked(sets)))) and len(kept) < len(given)

    given, clean = seen["personal data"]
    text = {r["doc_id"]: r["text"] for r in clean}
    for r in given:
        want = r["text"]
        if want:
            want = re.sub(brute.PII[0][1], "<EMAIL>", want)
            want = re.sub(r"10\.0\.0\.\d+", "<IP>", want)
        assert text[r["doc_id"]] == want

    given, mixed = seen["mixing"]
    taken = {}
    for r in mixed:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert max(taken.values()) <= 2
    size = lambda r: len(brute.WORD.findall(r["text"] or ""))
    total = sum(size(r) for r in given)
    assert abs(sum(size(r) for r in mixed) - 1.5 * total) <= 4 * max(size(r) for r in given)

    given, pieces = seen["packing"]
    assert sorted({r["doc_id"] for r in pieces}) == sorted({r["doc_id"] for r in given})
    fill = {}
    for r in pieces:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024

    whole = corpus_pipeline.run(spark, sf)
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, pieces))
