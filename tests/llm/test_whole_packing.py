"""op6: the ids of texts that hold an added token are those of the plain tokenizers file."""

from __future__ import annotations

import zlib


def test_packing_added_tokens(spark):
    from tokenizers import Tokenizer

    from lorekeep.llm import packing
    from lorekeep.llm.queries import tokenizer_files

    plain = Tokenizer.from_file(tokenizer_files()[0])
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext| >", "no such token"]
    got = {r["doc_id"]: r for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *tokenizer_files()).collect()}
    for i, t in enumerate(texts):
        ids = plain.encode(t, add_special_tokens=False).ids + [2]
        assert got[i]["length"] == len(ids)
        assert got[i]["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_packing_awkward_rows_and_columns(spark):
    from tokenizers import Tokenizer

    from lorekeep.llm import packing
    from lorekeep.llm.queries import tokenizer_files

    plain = Tokenizer.from_file(tokenizer_files()[0])
    rows = [(None, None, 5, "x"), (1, "", 5, None), (1, "same text", 5, "x"), (1, "same text", 5, "x"), (2, "word " * 30_000, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, offset string")
    got = packing.pack(docs, *tokenizer_files()).collect()
    sizes = sorted(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    whole: dict = {}
    for r in got:
        if r["piece"] == 0:
            whole[r["doc_id"], r["length"]] = whole.get((r["doc_id"], r["length"]), 0) + 1
    assert sum(r["length"] for r in got) == sum(sizes) and sum(whole.values()) == len(rows)
    assert whole[None, 1] == 1 and whole[1, 1] == 1 and whole[1, 3] == 2
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 2)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(n == 1024 for _, _, n in long[1:]) and long[0][1] == 0
    # no two sequences that are not full could have been one
    fill: dict = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    low = sorted(fill.values())[:2]
    assert len(low) < 2 or sum(low) > 1024
