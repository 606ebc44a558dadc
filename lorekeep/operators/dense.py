"""Dense search: exact cosine of a stated query set against a collection, in blocks, and mapping of hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import durable

#: Queries of a block, vectors of a block, and bytes of queries that are broadcast at most.
BLOCK, VECTORS, BROADCAST_BYTES = 256, 2048, 64_000_000


def norm(vec: Column) -> Column:
    """H8: L2 norm."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def encode(vec: Column) -> Column:
    """H8: components as base64 of little-endian 32-bit floats is storage; here a comma list keeps them readable and exact."""
    return F.array_join(F.transform(vec, lambda x: x.cast("string")), ",")


def decode(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.cast("float"))


@F.pandas_udf(T.BinaryType())
def pack(vec: pd.Series) -> pd.Series:
    """H8: components as little-endian 32-bit floats, four bytes each; null stays null. No built-in function gives a float's bytes."""
    return vec.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack(data: pd.Series) -> pd.Series:
    """H8: the components of packed vectors; bytes that are no whole number of components give null."""
    return data.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def packed(rows: DataFrame, most: int) -> DataFrame:
    """(dim, ids, vectors): vectors of one length, so many to a row, as bytes of 64-bit numbers. rows: (id, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[float]]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            own = held.pop(dim)
            ids, vectors = np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.float64)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if v:
                    held.setdefault(len(v), []).append((i, v))
                    if len(held[len(v)]) >= most:
                        yield flush(len(v))
        for dim in list(held):
            yield flush(dim)

    return rows.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).mapInArrow(run, "dim int, ids binary, vectors binary")


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, id, score, rank) of the k best by cosine, those under the threshold taken out afterwards.

    queries: (query_id, vec), vectors: (id, vec). Vectors of another length than the query do not count, those without
    direction score -1. Blocks of queries meet blocks of vectors, a pair of blocks at a time; each passes on k rows a query.
    The queries' blocks are broadcast up to BROADCAST_BYTES; beyond that the pairs of blocks are dealt over the cluster.
    """
    asked = durable(packed(queries.select(F.col("query_id").alias("id"), "vec"), BLOCK), "dense-queries").select(F.col("dim").alias("qd"), F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
    size = asked.agg(F.sum(F.length("qv"))).first()[0] or 0
    asked = F.broadcast(asked) if size <= BROADCAST_BYTES else asked
    pairs = packed(vectors, VECTORS).crossJoin(asked).where("dim = qd").select("qi", "qv", "ids", "vectors", "dim")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, ids, vs, dim in zip(*(batch.column(i).to_pylist() for i in range(5))):
                q, v = np.frombuffer(qi, np.int64), np.frombuffer(ids, np.int64)
                a, b = np.frombuffer(qv, np.float64).reshape(-1, dim), np.frombuffer(vs, np.float64).reshape(-1, dim)
                size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
                s = np.where(size > 0, a @ b.T / np.where(size > 0, size, 1), -1.0)
                # all that tie with the k-th best go on, so that the final order decides
                low = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(q), -2.0)
                x, y = np.nonzero(s >= low[:, None] - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(q[x]), pa.array(v[y]), pa.array(s[x, y])], names=["query_id", "id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")) - 1
    return pairs.mapInArrow(scan, "query_id long, id long, score double").withColumn("rank", rank).where((F.col("rank") < k) & (F.col("score") >= threshold))


def same_space(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits whose index has the query's embedding space and is not stale."""
    return hits.join(queries.select("query_id", "space_fp"), ["query_id", "space_fp"]).where(~F.col("stale"))


def map_hits(hits: DataFrame, by_hash: DataFrame, by_index: DataFrame) -> DataFrame:
    """Hits (query_id, hash, index, rank) to ids, by hash, else by index where the hash is unknown; the best rank of each id."""
    h = by_hash.select(F.col("hash").alias("h"), F.col("id").alias("id_h"))
    i = by_index.select(F.col("index").alias("i"), F.col("id").alias("id_i"))
    known = hits.join(h, hits["hash"] == h["h"], "left").join(i, hits["index"] == i["i"], "left")
    out = known.withColumn("id", F.coalesce("id_h", "id_i")).where("id is not null")
    return out.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))


#: Families of embedding models and what their names contain; the first that fits counts.
FAMILIES = {"jina": r"\bjina\b", "e5": r"(^|[/_-])e5([-_]|$)", "bge": r"\bbge([-_]|\b)", "qwen3": r"qwen.*embedding", "voyage": "voyage", "openai": "text-embedding-|openai"}
#: What the family's queries and documents begin with.
PREFIXES = {"e5": ("query: ", "passage: ")}


def family(model: Column) -> Column:
    """The family of a model by its name."""
    low, out = F.lower(F.coalesce(model, F.lit(""))), None
    for name, pattern in FAMILIES.items():
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("generic")


def role_text(text: Column, model: Column, role: Column) -> Column:
    """The text with its family's prefix for queries or documents, once."""
    t, out = F.trim(F.coalesce(text, F.lit(""))), None
    for name, (query, document) in PREFIXES.items():
        prefix = F.when(role == "query", query).when(role == "document", document).otherwise("")
        out = F.when((t != "") & (family(model) == name) & ~t.startswith(prefix), F.concat(prefix, t))
    return F.coalesce(out, t)


def calibrated_threshold(requested: Column, own: Column) -> Column:
    """An index's own threshold, where it has a valid one, else the one asked for."""
    return F.when(own.between(0, 1), own).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(requested, F.lit(0.0)))))
