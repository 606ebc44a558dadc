"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

Every unit vector is turned by ``ROTATIONS`` fixed random rotations and reduced to its signs. Stored with the code is a factor
f for the first rotation P, the inner product of P a and its code x (the signs over the root of the dimension d). Since the
rotation is random, x is f P a plus a part of length sqrt(1 - f^2) in a direction at random across P a; so for any unit vector b
the estimate  <x, P b> / f  of the inner product c = <a, b> is unbiased, with variance  (1 - c^2) (1 - f^2) / (f^2 (d - 1)).

Candidates come from all codes. Tables keyed by ``bits`` drawn code bits each bring classes together; those of one key whose
codes differ in no more bits than pairs at the limit do, plus ``Z`` deviations (a differing bit is a coin that falls with
angle / pi), hang together. A task compares the codes of a key as arrays and passes on a forest. In the groups that these
forests make, all pairs meet in blocks inside tasks: the estimate from one vector's code and factor decides, by its confidence
bound of ``Z`` deviations, which pairs are computed exactly, in double precision. Tasks pass on numbers of links and a forest,
no pairs. The number of tables is such that a pair at the limit shares no key with probability ``MISS`` at most, all tables
drawing from the same code bits; the work of the tables so grows as the input to a power near 1.15.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; equal
vectors (repeated rows) form a class that is compared once and counts with all its members; vectors of different lengths
do not link; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable
from .blocks import dealt, every_pair, first_pairs, forest, halves, hanging, other_pairs, parted, runs, tiles, with_blocks
from .graph import components

ROTATIONS, MISS, SEED = 8, 1e-3, 77
#: Deviations that an estimate may lie beyond the limit.
Z = 4.0
#: Members of a block of a key, of a block of a group.
ENTRY, BLOCK = 4096, 1024


def rotations(dim: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, dim])
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(ROTATIONS)])


def tables_for(n: int, dim: int, limit: float) -> tuple[int, int]:
    """Bits of a key and number of tables, for n vectors."""
    pool = ROTATIONS * dim
    bits = max(1, min(pool // 2, math.ceil(math.log2(max(2, n))) + 1))
    share = math.acos(limit) / math.pi
    differ = np.arange(pool - bits + 1)
    log = np.array([math.lgamma(pool + 1) - math.lgamma(x + 1) - math.lgamma(pool - x + 1) for x in differ]) + differ * math.log(share) + (pool - differ) * math.log1p(-share)
    agree = np.exp([sum(math.log((pool - x - k) / (pool - k)) for k in range(bits)) for x in differ])
    tables = 1
    while tables < 2000 and (np.exp(log) * (1 - agree) ** tables).sum() > MISS:
        tables += 1
    return bits, tables


def most_differing(dim: int, limit: float) -> int:
    """Code bits that may differ in a candidate."""
    pool, share = ROTATIONS * dim, math.acos(limit) / math.pi
    return math.floor(pool * share + Z * math.sqrt(pool * share * (1 - share)))


def unit(v: list[float]) -> np.ndarray:
    u = np.asarray(v, np.float64)
    u = u / np.abs(u).max()
    return u / np.linalg.norm(u)


def coded(classes: DataFrame, n: int, limit: float) -> DataFrame:
    """(cid, dim, words, factor, keys) of each class: packed code bits of all rotations, the first one's factor, a key per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            out = []
            for cid, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                dim = len(v)
                if dim not in made:
                    bits, tables = tables_for(n, dim, limit)
                    rng = np.random.default_rng([SEED, dim, 1])
                    drawn = np.stack([rng.permutation(ROTATIONS * dim)[:bits] for _ in range(tables)])
                    made[dim] = rotations(dim), drawn, rng.integers(1, 1 << 62, bits, dtype=np.int64) | 1, rng.integers(0, 1 << 62, tables, dtype=np.int64)
                turn, drawn, weights, salt = made[dim]
                x = turn @ unit(v)
                sign = (x > 0).ravel()
                with np.errstate(over="ignore"):
                    keys = (sign[drawn] * weights).sum(1) * np.int64(0x5851F42D4C957F2D) ^ salt
                words = np.packbits(np.pad(sign, (0, -len(sign) % 64))).view(np.int64)
                out.append((cid, dim, words, float(np.abs(x[0]).sum() / math.sqrt(dim)), keys))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["cid", "dim", "words", "factor", "keys"])

    return classes.select("cid", "unit").mapInArrow(run, "cid long, dim int, words array<long>, factor double, keys array<long>")


def stacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The lists of a column, all of one length, as a matrix."""
    return np.array(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1)


def candidate_forest(entries: DataFrame, limit: float) -> DataFrame:
    """(a, b): what the classes of each key hang together by. entries: (dim, key, i, j, block, cid, words), of ``dealt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in of_one_dimension(batches):
            yield from hanging(one, 2, 5, sides)

    def of_one_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
        """The batches of each dimension: they are sorted by it, and the words of one dimension are of one length."""
        for dim, parts in itertools.groupby(cut_by_dimension(batches), key=lambda x: x.column(0)[0].as_py()):
            yield parts

    def cut_by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(0).to_numpy()
            at = [0, *(np.flatnonzero(dim[1:] != dim[:-1]) + 1).tolist(), len(dim)]
            yield from (batch.slice(lo, hi - lo) for lo, hi in zip(at, at[1:]) if hi > lo)

    def sides(table: pa.Table):
        words, most = stacked(table.column(6), np.int64).view(np.uint64), most_differing(table.column(0)[0].as_py(), limit)

        def near(x: np.ndarray, y: np.ndarray, alike: bool) -> np.ndarray:
            total = 0
            for k in range(words.shape[1]):
                a, b = words[x, k], words[y, k]
                total = total + np.bitwise_count(a ^ b if alike else a[:, None] ^ b).astype(np.uint16)
            return total <= most

        return near

    return entries.mapInArrow(run, "a long, b long").distinct()


def estimates(words: np.ndarray, factor: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each code (rows) with each unit vector (columns): the estimated inner product; of each code the deviation at c = 0.

    The deviation at an inner product c is that times sqrt(1 - c^2).
    """
    dim = units.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)[:, :dim]
    code = (2.0 * bits - 1) / math.sqrt(dim) / factor[:, None]
    spread = np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    return code @ (units @ rotations(dim)[0].T).T, spread


def compared(pairs: DataFrame, limit: float) -> DataFrame:
    """(a, b, k): links that connect what is linked (k null), and numbers of vectors linked to class a (b null).

    pairs: (gid, i, j, block, cid, m, words, factor, unit), of ``dealt``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            if table.num_rows < 2:
                continue
            order, first = halves(table.column(3).to_numpy(), table.column(1)[0].as_py(), table.column(2)[0].as_py())
            cid, m, factor = (table.column(k).to_numpy()[order] for k in (4, 5, 7))
            words, units = stacked(table.column(6), np.int64)[order], stacked(table.column(8), np.float64)[order]
            units = units / np.abs(units).max(1, keepdims=True)
            units /= np.linalg.norm(units, axis=1, keepdims=True)
            degree = np.zeros(len(cid), np.int64)
            links: list[tuple[slice, slice, np.ndarray]] = []
            for a, b in tiles(len(cid), first, BLOCK):
                estimate, spread = estimates(words[a], factor[a], units[b])
                maybe = estimate >= limit - Z * math.sqrt(1 - limit * limit) * spread[:, None]
                x, y = np.nonzero(np.tril(maybe, -1) if a == b else maybe)
                near = np.zeros(maybe.shape, bool)
                for lo in range(0, len(x), 100_000):
                    p, q = x[lo : lo + 100_000], y[lo : lo + 100_000]
                    near[p, q] = np.einsum("ij,ij->i", units[a][p], units[b][q]) >= limit
                np.add.at(degree, np.arange(a.start, a.stop), near @ m[b])
                np.add.at(degree, np.arange(b.start, b.stop), near.T @ m[a])
                if near.any():
                    links.append((a, b, near))
            found = forest(len(cid), ((a, b, lambda near=near: near) for a, b, near in links))
            at = np.flatnonzero(degree)
            if len(at):
                a = [int(cid[i]) for i, _ in found] + cid[at].tolist()
                b = [int(cid[j]) for _, j in found] + [None] * len(at)
                k = [None] * len(found) + degree[at].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, k)], names=["a", "b", "k"])

    return pairs.mapInArrow(run, "a long, b long, k long")


def link(embeddings: DataFrame, limit: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("unit", F.when(good, F.transform("v", lambda x: x + F.lit(0.0)))).drop("v")
    # equal vectors are told by a digest of their components, which are shortest decimals of the doubles
    v = durable(v.withColumn("h", F.unhex(F.md5(F.concat_ws(",", F.col("unit").cast("array<string>"))))), "vectors-rows")
    classes = v.where("unit is not null").groupBy("h").agg(F.first("unit").alias("unit"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors-classes")
    codes = durable(coded(classes, classes.count(), limit), "vectors-codes")
    index = codes.select("dim", F.explode("keys").alias("key"), "cid").repartition("dim", "key")
    shared = index.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = with_blocks(durable(index.join(shared, ["dim", "key"]), "vectors-members"), "c", ENTRY)
    words = codes.select("cid", "words")
    by_key = lambda m, meets: dealt(m.join(words, "cid"), meets, ("dim", "key"), ("cid", "words"))
    hang = durable(candidate_forest(by_key(members, first_pairs()), limit), "vectors-hang")
    groups = components(hang)
    again = parted(members, ("dim", "key"), groups)
    if not again.isEmpty():
        groups = components(hang.unionByName(candidate_forest(by_key(again, other_pairs()), limit)))
    groups = groups.withColumnRenamed("id", "cid").withColumnRenamed("comp", "gid")
    sizes = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    at = with_blocks(groups.join(sizes, "gid"), "size", BLOCK)
    full = at.join(codes.select("cid", "words", "factor"), "cid").join(classes.select("cid", "m", "unit"), "cid")
    links = durable(compared(dealt(full, every_pair(), ("gid",), ("cid", "m", "words", "factor", "unit")), limit), "vectors-links")
    comp = components(links.where("b is not null").select("a", "b"))
    degree = links.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("k").alias("k"))
    of = classes.drop("unit").join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).join(degree, "cid", "left")
    least = of.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = of.join(least, "comp").select("h", (F.coalesce("k", F.lit(0)) + F.col("m") - 1).cast("long").alias("links"), "component_id")
    out = v.select("vec_id", F.when(F.col("unit").isNotNull(), F.col("h")).alias("h")).join(of, "h", "left")
    component = F.when(F.col("h").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.col("vec_id").isNull()).alias("kept"))
