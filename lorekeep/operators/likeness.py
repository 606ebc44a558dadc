"""T2 in blocks: which chunks of its world are likest to a query, found pair by pair without writing the pairs.

Chunks are dealt by world and packed into blocks of BLOCK, queries into blocks of ASKED; a pair of blocks is a unit of work. Common tokens
are counted by a product of incidence matrices for frequent tokens and hit by hit for others. Each pair of blocks passes on k
chunks a query at most (and those whose rounded score is in doubt), and a task only what reaches the k best of a block that it
has seen. So the work is that of all pairs, but disk and memory grow with the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_baseline, tokens_baseline
from ..sources.shared import durable

#: Chunks of a block, queries of a block, bytes of queries that are broadcast at most.
BLOCK, ASKED, BROADCAST_BYTES = 1024, 1024, 64_000_000


def packed(rows: DataFrame, by: str, most: int) -> DataFrame:
    """(<by>, <list of each other column>): rows of one group, so many to a row. The rows must be sorted by group within partitions."""
    names = [c for c in rows.columns if c != by]
    schema = T.StructType([rows.schema[by], *[T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            lists = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(c)) for c in names]
            return pa.RecordBatch.from_arrays([whole.column(by).slice(0, 1), *lists], names=[by, *names])

        for batch in batches:
            keys, start = batch.column(by).to_pylist(), 0
            while start < len(keys):
                if held and (held[0].column(by)[0].as_py() != keys[start] or sum(x.num_rows for x in held) >= most):
                    yield flush()
                room, end = most - sum(x.num_rows for x in held), start
                while end < len(keys) and keys[end] == keys[start] and end - start < room:
                    end += 1
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def common(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """How many tokens each row of a shares with each of b; the tokens of a row are distinct."""
    (ra, ta), (rb, tb) = ((np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy(zero_copy_only=False)), x.flatten()) for x in (a, b))
    words = pc.unique(ta)
    ka, kb = (pc.fill_null(pc.index_in(t, words), -1).to_numpy(zero_copy_only=False) for t in (ta, tb))
    rb, kb = rb[kb >= 0], kb[kb >= 0]
    na, nb = np.bincount(ka, minlength=len(words)), np.bincount(kb, minlength=len(words))
    often = na * nb * 256 > len(a) * len(b)
    place = np.cumsum(often) - 1
    x, y = np.zeros((len(a), often.sum()), np.float32), np.zeros((len(b), often.sum()), np.float32)
    x[ra[often[ka]], place[ka[often[ka]]]] = 1
    y[rb[often[kb]], place[kb[often[kb]]]] = 1
    out = (x @ y.T).astype(np.int32)
    order = np.argsort(ka, kind="stable")
    first = np.cumsum(na) - na
    rb, kb = rb[~often[kb]], kb[~often[kb]]
    reps = na[kb]
    at = np.repeat(first[kb] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    out += np.bincount(ra[order[at]] * len(b) + np.repeat(rb, reps), minlength=out.size).reshape(out.shape).astype(np.int32)
    return out


def _lengths(x: pa.Array) -> np.ndarray:
    return pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64)


def similarity(x: np.ndarray, y: np.ndarray, both: np.ndarray, m: np.ndarray, n: np.ndarray, a: pa.Array, b: pa.Array) -> np.ndarray:
    """``overlap_similarity`` of the pairs (x, y) of texts a and b, from their numbers of common tokens and of tokens.

    Texts are compared only where one may hold the other: all tokens of the one but the first and the last are in the other then.
    """
    m, n, la, lb = m[x], n[y], _lengths(a)[x], _lengths(b)[y]
    out = np.maximum(both / np.maximum(m + n - both, 1), 0.92 * both / np.maximum(np.minimum(m, n), 1))
    few = np.nonzero((both >= np.where(la <= lb, m, n) - 2) & ((np.minimum(la, lb) >= 8) | (la == lb)))[0]
    if len(few):
        p, q = a.to_pylist(), b.to_pylist()
        for k, i, j in zip(few.tolist(), x[few].tolist(), y[few].tolist()):
            s, t = p[i], q[j]
            if s == t:
                out[k] = 1.0 if s else 0.0
            elif min(len(s), len(t)) >= 8 and (s in t or t in s):
                out[k] = min(0.99, 0.88 + 0.11 * min(len(s), len(t)) / max(len(s), len(t)))
    return out


def _best(x: np.ndarray, y: np.ndarray, score: np.ndarray, k: int, constant: np.ndarray, ord_: np.ndarray, entry: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y) may be among the k best of their row: by score to nine digits, constants first, then by ord, entry and chunk."""
    scaled = score * 1e9
    lesser = np.floor(scaled + 0.5 - 1e-5)
    doubt = np.floor(scaled + 0.5 + 1e-5) > lesser
    order = np.lexsort((chunk[y], entry[y], ord_[y], ~constant[y], -lesser, x))
    x, lesser, doubt = x[order], lesser[order], doubt[order]
    start = np.concatenate([[0], np.nonzero(np.diff(x))[0] + 1]) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(x)))
    place = np.arange(len(x)) - np.repeat(start, size)
    last = np.repeat(lesser[start + np.minimum(k, size) - 1], size) if len(x) else lesser
    keep = (place < k) | doubt & (lesser + 1 >= last)
    return order[keep]


def candidates(queries: DataFrame, chunks: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, entry_id, chunk, constant, ord, score): for each query of (query_id, world_id, text) its k best chunks at least, of those that share a token with it."""
    spark = queries.sparkSession
    salt = F.pmod(F.xxhash64("entry_id"), F.lit(spark.sparkContext.defaultParallelism))
    c = chunks.where("world_id is not null").select("world_id", "entry_id", "chunk", "constant", F.col("ord").cast("double").alias("ord"), "text", "retrieval_text")
    c = c.withColumn("_salt", salt).repartition("world_id", "_salt").sortWithinPartitions("world_id")
    body, full = tokens_baseline(F.col("text")), tokens_baseline(F.col("retrieval_text"))
    c = c.select("world_id", "_salt", "entry_id", "chunk", "constant", "ord", normalize_baseline(F.col("text")).alias("b"), normalize_baseline(F.col("retrieval_text")).alias("r"), body.alias("bt"), full.alias("rt"))
    c = c.withColumns({"more": F.array_except("rt", "bt"), "less": F.array_except("bt", "rt")}).drop("rt", "_salt")
    q = queries.where("world_id is not null").select("world_id", "query_id", normalize_baseline(F.col("text")).alias("q"), tokens_baseline(F.col("text")).alias("qt")).repartition("world_id").sortWithinPartitions("world_id")
    asked = durable(packed(q, "world_id", ASKED).withColumn("part", F.monotonically_increasing_id()), "likeness-queries")
    size = asked.agg(F.sum(F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + 2 * F.length(x)))).first()[0] or 0
    asked = F.broadcast(asked) if size <= BROADCAST_BYTES else asked
    pairs = packed(c, "world_id", BLOCK).join(asked, "world_id")
    names = ["query_id", "q", "qt", "entry_id", "chunk", "constant", "ord", "b", "r", "bt", "more", "less"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                ids, q, qt, entry, chunk, constant, ord_, b, r, bt, more, less = (batch.column(1 + j).slice(i, 1).flatten() for j in range(12))
                count = lambda x: pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
                const = np.asarray(constant.to_numpy(zero_copy_only=False), bool)
                ib, m = common(qt, bt), count(qt)
                ir = ib + common(qt, more) - (common(qt, less) if count(less).any() else 0)
                nb, nr = count(bt), count(bt) + count(more) - count(less)
                # no pair's score is over this, unless one text holds the other, which may be where all tokens but two are common
                most = np.maximum(ib, ir)
                small = np.minimum(m[:, None], np.minimum(nb, nr)[None, :])
                low = reached.get(part, np.full(len(m), least))
                x, y = np.nonzero((most > 0) & ((most >= (low[:, None] - 0.016) * small) | (most >= small - 2)))
                score = np.maximum(similarity(x, y, ib[x, y], m, nb, q, b), 0.88 * similarity(x, y, ir[x, y], m, nr, q, r)) + np.where(const[y], 0.015, 0.0)
                good = (score >= least) & (score >= low[x] - 2e-9)
                x, y, score = x[good], y[good], score[good]
                if len(x) > 4 * k * len(m):
                    whole = np.full(ib.shape, -1.0)
                    whole[x, y] = score
                    low = np.maximum(low, np.partition(whole, -k, axis=1)[:, -k] if whole.shape[1] > k else -1.0)
                    good = score >= low[x] - 2e-9
                    x, y, score = x[good], y[good], score[good]
                number = lambda z: z.to_numpy(zero_copy_only=False) if pa.types.is_integer(z.type) else np.unique(np.asarray(z.to_pylist(), object), return_inverse=True)[1]
                best = _best(x, y, score, k, const, np.nan_to_num(ord_.to_numpy(zero_copy_only=False).astype(float), nan=np.inf), number(entry), number(chunk))
                x, y, score = x[best], y[best], score[best]
                full = np.bincount(x, minlength=len(m)) >= k
                least_of = np.full(len(m), np.inf)
                np.minimum.at(least_of, x, score)
                reached[part] = np.where(full, np.maximum(low, least_of - 2e-9), low)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), *[v.take(pa.array(y)) for v in (entry, chunk, constant, ord_)], pa.array(score)], names=["query_id", "entry_id", "chunk", "constant", "ord", "score"])

    kind = lambda d, c: d.schema[c].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, entry_id {kind(chunks, 'entry_id')}, chunk {kind(chunks, 'chunk')}, constant boolean, ord double, score double"
    return pairs.select("part", *names).mapInArrow(run, schema)
