"""What the pipeline's Python stages hold of a batch at once does not grow with the batch."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest


def _functions(monkeypatch, build) -> list:
    """The functions that build() gives to mapInArrow."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, f, *a, **kw: (seen.append(f), plain(df, f, *a, **kw))[1])
    build()
    monkeypatch.undo()
    return seen


def _peak(function, batch: pa.RecordBatch) -> tuple[float, int]:
    """MB of Python objects at once, beyond a first run's (caches), and the rows that come out."""
    tracemalloc.start()
    try:
        sum(b.num_rows for b in function(iter([batch.slice(0, 10)])))
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        rows = sum(b.num_rows for b in function(iter([batch])))
        return (tracemalloc.get_traced_memory()[1] - before) / 1e6, rows
    finally:
        tracemalloc.stop()


def _text(i: int) -> str:
    return " ".join(f"word{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}ending" for k in range(150)) + (" vile" if i % 4 == 1 else " kind")


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(i, _text(i)) for i in range(60)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(60)], "doc_id long, toxic int")


def test_toxicity_holds_a_part_of_a_batch(monkeypatch, small):
    from lorekeep.llm import toxicity

    extract, index, keep = _functions(monkeypatch, lambda: toxicity.without_toxic(*small))
    n = 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([i % 4 == 1 for i in range(n)]), pa.array([_text(i) for i in range(n)])], names=["doc_id", "pos", "text"])
    for function in (extract, index):
        peak, rows = _peak(function, batch)
        assert rows == n
        assert peak < 12, peak
    peak, rows = _peak(keep, batch.select(["doc_id", "text"]))
    assert rows == sum(i % 4 != 1 for i in range(n))
    assert peak < 4, peak


def test_packing_holds_a_part_of_a_batch(monkeypatch, small):
    from lorekeep.llm import packing
    from lorekeep.llm.queries import tokenizer_files

    (cut_up,) = _functions(monkeypatch, lambda: packing.pieces(small[0], *tokenizer_files()))
    n = 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([_text(i) for i in range(n)])], names=["doc_id", "text"])
    peak, rows = _peak(cut_up, batch)
    assert rows == n
    assert peak < 4, peak


def test_slices_keep_rows_and_order():
    from lorekeep.llm.base import slices

    batch = pa.RecordBatch.from_arrays([pa.array([5, None, 3, 2, 1])], names=["a"])
    parts = list(slices(iter([batch, batch.slice(0, 0), batch.slice(1, 2)]), 2))
    assert [p.column(0).to_pylist() for p in parts] == [[5, None], [3, 2], [1], [None, 3]]
