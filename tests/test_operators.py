"""Rules on small fixtures: the fold, ranking, diversity, budgets, gate, texts, streams."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import derived, evaluate, fold, gate, oplog, rank, settings
from lorekeep.streaming import turns as stream


def values(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def ops(spark, rows):
    """rows: dicts with conv_id, msg, op and any of the optional columns."""
    names = ["conv_id", "msg", "op", *[c for c in fold.OPTIONAL if c != "op_idx"]]
    kinds = ", ".join(f"{n} {'long' if n in ('conv_id', 'msg') else 'string'}" for n in names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds)


def test_tokens(spark):
    df = spark.createDataFrame([("A bc_9 Ｄef 日本語 字, x",)], "t string")
    assert df.select(X.tokens_hybrid(F.lit("A bc_9 日本語 字"))).first()[0] == ["bc_9", "日本", "本語", "日本語", "字"]
    assert df.select(X.tokens_baseline(F.lit("v1.2/x a a 日本語"))).first()[0] == ["v1.2/x", "a", "日本", "本語", "日本語"]
    assert df.select(X.normalize(F.col("t"), compatibility=True)).first()[0] == "a bc_9 def 日本語 字, x"
    assert df.select(X.fnv1a32(F.lit("hello"))).first()[0] == 0x4F9F2CAB
    assert df.select(X.estimate_tokens(F.lit("日本語ab"))).first()[0] == 4


def test_similarity(spark):
    df = spark.createDataFrame([("same", "Same", 1.0), ("a long text", "in a long text here", 0.88 + 0.11 * 11 / 19), ("a b c d", "a b c e", 0.69), ("", "x", 0.0)], "a string, b string, s double")
    for r in df.withColumn("got", X.lexical_similarity(F.col("a"), F.col("b"))).collect():
        assert abs(r["got"] - r["s"]) < 1e-9


def test_slot_lifecycle(spark):
    base = {"conv_id": 1, "kind": "state", "slot": "s", "target_slot": "s"}
    rows = [
        base | {"msg": 1, "op": "add", "text": "old"}, base | {"msg": 2, "op": "close"}, base | {"msg": 3, "op": "add", "text": "new"}, base | {"msg": 4, "op": "add", "text": " new "},
        base | {"msg": 5, "op": "supersede", "kind": "knowledge", "text": "newer"}, base | {"msg": 6, "op": "update", "new_slot": "t"}, base | {"msg": 7, "op": "reinforce"}, base | {"msg": 8, "op": "reinforce", "target_slot": "t"},
    ]
    got = {r["text"]: r for r in fold.apply_ops(ops(spark, rows)).collect()}
    assert (got["old"]["status"], got["old"]["valid_until"], got["old"]["superseded_by"]) == ("closed", 2, None)
    assert (got["new"]["status"], got["new"]["confirmed"], got["new"]["superseded_by"]) == ("superseded", 1, got["newer"]["id"])
    assert (got["newer"]["slot"], got["newer"]["reinforcement"], got["newer"]["supersedes"], got["newer"]["owns"]) == ("t", 1, got["new"]["id"], True)


def test_windows_equal_fold(spark):
    """On logs without updates of slots, states and texts the windows give what the general fold gives."""
    rng = random.Random(4)
    rows = [{"conv_id": c, "msg": m, "op": rng.choice(["add", "add", "supersede", "close", "reinforce", "invalidate"]), "kind": rng.choice(["state", "knowledge", "relation"]), "slot": f"s{(s := rng.randrange(3))}", "target_slot": f"s{s}", "text": f"t{rng.randrange(3)}", "importance": "medium"} for c in range(4) for m in range(80)]
    log = ops(spark, rows)
    names = ["conv_id", "slot", "text", "valid_from", "valid_until", "reinforcement", "confirmed"]
    assert sorted(values(oplog.slot_versions(log), *names), key=str) == sorted(values(fold.apply_ops(log), *names), key=str)


def test_validation(spark):
    op = "struct<op:string,kind:string,text:string,target_id:string,target_slot:string,status:string,importance:string,epistemic:string,reason:string,scope:string,entities:array<string>,topics:array<string>,known_by:array<string>>"
    one = lambda **k: tuple(k.get(n.split(":")[0]) for n in op[7:-1].replace("array<string>", "x").split(","))
    rows = [(one(op="add", kind="state", text="x"),), (one(op="add", kind="odd", text=" "),), (one(op="close"),), (one(op="noop"),), (one(op="jump"),), (one(op="add", kind="state", text="x" * 1201, entities=["e"] * 21),)]
    got = [r[0] for r in spark.createDataFrame(rows, f"o {op}").select(oplog.validate(F.col("o"))).collect()]
    assert [len(x) for x in got] == [0, 2, 1, 1, 1, 2]


def test_temporal(spark):
    rows = [(1, "tea", "active", 10, 12, "home", "medium", 20), (1, "coffee", "active", 12, None, "home", "medium", 20)]
    m = spark.createDataFrame(rows, "conv_id long, text string, status string, valid_from long, valid_until long, scope string, importance string, as_of long")
    assert values(rank.temporal_topk(m), "text") == [("coffee",)]
    assert values(rank.temporal_topk(m.withColumn("as_of", F.lit(5))), "text") == []
    assert values(rank.temporal_topk(m, scope=F.lit("office")), "text") == []
    assert values(rank.temporal_topk(m, scope=F.lit("HOME office")), "text") == [("coffee",)]


def test_fusion_and_mmr(spark):
    ch = spark.createDataFrame([(1, "a", 1, 0), (1, "a", 2, 1), (1, "b", 2, 0), (1, "b", 3, 1)], "query_id int, channel string, id int, rank int")
    assert rank.rrf(ch, {}).orderBy(F.desc("score")).first()["id"] == 2
    rows = spark.createDataFrame([(1, 1, 1.0, ["x", "y"]), (1, 2, 0.99, ["x", "y"]), (1, 3, 0.8, ["z"])], "query_id int, id int, score double, terms array<string>")
    assert [r["id"] for r in rank.mmr(rows, k=2).orderBy("rank").collect()] == [1, 3]


def test_budgets(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4)], "q int, id int, n int")
    assert values(rank.pack_prefix(rows, "q", [F.col("id")], "n", 10), "id") == [(1,)]
    assert sorted(values(rank.pack_skip(rows, "q", [F.col("id")], "n", 10), "id")) == [(1,), (3,)]


def test_budget_layers(spark):
    rows = spark.createDataFrame([(1, 0, 1, 30), (1, 0, 2, 10), (1, 1, 3, 60), (1, 2, 4, 31), (1, 2, 5, 29)], "q int, layer int, id int, n int")
    got = sorted(values(rank.pack_layers(rows, "q", "layer", [F.col("id")], "n", 100), "layer", "id"))
    assert got == [(0, 2), (1, 3), (2, 5)]  # 25, then 45 + 15, then 30 + 0


def test_rerank_without_spread(spark):
    f = {"coverage": 1.0, "phrase": 0.0, "slot": 0.0, "entity": 0, "recency": 1.0, "importance": 0.6, "breadth": 0.3}
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], "query_id int, id int, score double").withColumns({k: F.lit(v) for k, v in f.items()})
    assert [round(r["rerank_score"], 6) for r in rank.rerank(rows).orderBy("rank").collect()] == [round(0.45 + 0.55 * 0.5, 6), round(0.55 * 0.5, 6)]


def test_gate(spark):
    o = spark.createDataFrame([(1, "the house at the lake belongs to anna", ["a"]), (2, "she sold the boat", ["a"]), (3, "anna works in a bakery", ["b"])], "id long, text string, entity_ids array<string>")
    r = spark.createDataFrame([(10, "The house at the lake  belongs to Anna", ["a"]), (11, "anna works in a bakery in town", ["c"])], "id long, text string, entity_ids array<string>")
    taken, blocked = gate.split(o, r, F.lit(True))
    assert sorted(values(taken, "id")) == [(2,), (3,)] and values(blocked, "id", "record_id") == [(1, 10)]


def test_chunks(spark):
    text = "First sentence here. Second one follows.\nUnless it rains. " + "word " * 120 + "end."
    got = spark.range(1).select(settings.split_chunks(F.lit(text), 60)).first()[0]
    assert all(len(x) <= 60 + 19 for x in got) and "".join(" ".join(got).split()) == "".join(text.split())
    glued = spark.range(1).select(settings.glue_conditions(F.array(F.lit("A rule."), F.lit("Unless it rains."), F.lit("Other.")), most=40)).first()[0]
    assert glued == ["A rule. Unless it rains.", "Other."]


def test_imports(spark):
    files = spark.createDataFrame([("a/b.md", "intro\n# One\nbody\n### Sub\nmore\n## Two\nlast"), ("c.txt", "only text")], "path string, text string")
    assert values(settings.titled_entries(files).orderBy("path", "index"), "title", "content") == [("b", "intro"), ("One", "body\n### Sub\nmore"), ("Two", "last"), ("c", "only text")]
    book = spark.createDataFrame([("x", '{"entries":{"0":{"comment":"c","content":"# Head\\ntext","disable":true,"foo":1},"1":5}}'), ("y", '[{"title":"T","content":"k"}]')], "path string, text string")
    assert values(settings.worldbook_entries(book).orderBy("path"), "title", "disabled", F.size("raw_extra")) == [("Head", True, 1), ("T", False, 0)]


def test_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    ranked = spark.createDataFrame([(1, 7, 0), (1, 8, 1), (2, 9, 0)], "query_id int, id int, rank int")
    gold = spark.createDataFrame([(1, 8), (3, 5)], "query_id int, id int")
    got = values(evaluate.case_scores(cases, ranked, gold, 2).orderBy("query_id"), "recall", "precision", "reciprocal_rank", "hit")
    assert got == [(1.0, 0.5, 0.5, True), (1.0, 0.0, 0.0, False), (0.0, 0.0, 0.0, False)]


def test_visibility_leaks_nothing(spark):
    o = spark.createDataFrame([(1, 1, 0, "public", "both", True), (1, 1, 1, "hidden", "both", False), (1, 2, 0, "hidden too", "x", False)], "conv_id int, msg int, op_idx int, text string, summary string, shown boolean")
    assert values(derived.redact_records(o, F.col("shown")), "msg", "summary") == [(1, "public")]


def test_scenes(spark):
    rows = [(1, i, "here" if i < 4 else None, "b", f"s{i}") for i in range(9)]
    got = derived.scene_sessions(spark.createDataFrame(rows, "conv_id long, turn long, location string, branch string, summary string"))
    assert values(got.orderBy("scene"), "n", "first_turn") == [(6, 0), (3, 6)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [{"conv_id": c, "msg": m, "op": rng.choice(["add", "supersede", "close"]), "kind": "state", "slot": "s", "target_slot": "s", "text": f"t{m}"} for c in range(5) for m in range(20)]
    log = ops(spark, rows)
    for part, (lo, hi) in enumerate(((0, 7), (7, 20))):
        log.where(f"msg >= {lo} and msg < {hi}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    src = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream.ingest_ops(src, str(tmp_path / "log"), str(tmp_path / "memories"), str(tmp_path / "state")).awaitTermination(120)
    names = ["conv_id", "id", "text", "status", "valid_from", "valid_until"]
    got = spark.read.parquet(str(tmp_path / "memories"))
    assert sorted(values(got, *names), key=str) == sorted(values(fold.apply_ops(log), *names), key=str)


def test_hard_queries(spark):
    """Words, a changed preference, a condition, a promise: the right memory is found by BM25, then put first by re-ranking."""
    from lorekeep.operators import lexical

    told = [(2, "the pass has the number a-7391"), (4, "the cellar key is not with tom but on the table"), (6, "only holders of the star permit open the blue hatch"), (8, "tom promised lena to check the blue hatch"), (12, "the user now likes long derivations"), (16, "mary keeps the cellar key")]
    asked = [("what number has the pass", 2), ("is the cellar key with tom", 4), ("what permit does the blue hatch need to open", 6), ("what has tom promised lena", 8), ("what derivations does the user like", 12), ("who keeps the cellar key", 16)]
    docs = spark.createDataFrame([(1, i, t) for i, t in told], "conv_id int, id int, text string")
    queries = spark.createDataFrame([(k, 1, q) for k, (q, _) in enumerate(asked)], "query_id int, conv_id int, text string")
    hits = lexical.top_k(lexical.bm25(queries, docs), 6)
    rows = hits.join(docs.select("id", "text"), "id").join(queries.select("query_id", F.col("text").alias("q")), "query_id")
    q = X.words(F.col("q"))
    rows = rows.withColumns({"coverage": X.word_coverage(q, X.words(F.col("text"))), "phrase": X.phrase_hits(q, F.col("text")).cast("double"), "slot": F.lit(0.0), "entity": F.lit(0), "recency": rank.recency(20 - F.col("id")), "importance": F.lit(0.6), "breadth": F.lit(0.3)})
    scored = evaluate.case_scores(queries, rank.rerank(rows).select("query_id", "id", (F.col("rank") - 1).alias("rank")), spark.createDataFrame([(k, i) for k, (_, i) in enumerate(asked)], "query_id int, id int"), 6)
    mean = evaluate.mean_scores(scored).first()
    assert mean["hit_rate"] == 1 and mean["reciprocal_rank"] >= 0.7
