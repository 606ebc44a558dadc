"""op3 and op2: columns whose names clash with the result's, ties and very long texts."""

from __future__ import annotations


def test_html_keeps_to_its_columns(spark):
    from lorekeep.llm import html_text

    rows = [(None, "u", "<p>a b", 7), (1, None, None, 7), (1, "u", "<article>" + "<p>long text here</p>" * 20_000 + "</article>", 7), (2, "u", "<" * 50_000, 7), (3, "u", "<p" * 30_000, 7), (4, "u", "&#65;&amp;&nbsp;x", 7)]
    got = {(r["page_id"], r["url"]): r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()}
    assert len(got) == len(rows) and got[None, "u"]["text"] == "a b" and got[1, None]["text"] == ""
    assert got[1, "u"]["text"] == " ".join(["long text here"] * 20_000) and got[4, "u"]["text"] == "A& x"


def test_neardup_clashing_columns_and_long_texts(spark):
    from lorekeep.llm import neardup

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, long, "a", 1), (3, long + " tail", "b", 2), (None, long, "c", 3), (9, None, "d", 4), (9, "", "e", 5), (2, "x y", "f", 6), (1, "X Y", "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string, component_id int")
    got = {(r["doc_id"], r["n_shingles"]): r for r in neardup.link(docs, 4, 80).collect()}
    assert got[3, 29_998]["component_id"] == got[5, 29_997]["component_id"] == 3 and got[2, 1]["component_id"] == 1 and got[9, 0]["kept"]
    kept = neardup.deduplicated(docs, 5, 80)
    assert kept.columns == docs.columns and {r["t"] for r in kept.collect()} >= {"b", "d", "e", "g"}
