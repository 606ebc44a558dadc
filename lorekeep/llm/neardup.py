"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

A text's set holds its distinct shingles; texts of equal sets form a class, of which one member goes on. A signature has
``CHUNKS`` x ``CHUNK`` MinHash values of 16 bits; the distance of two is the number of values that differ. If it is at most
``MOST_APART``, less than 2 x ``CHUNKS``, then by the pigeonhole principle all but one value at most agree in some chunk; so
each class is indexed under every chunk with each one of its values left out, and all pairs within the distance meet. Pairs
that meet are first held against two bits of 64 of their values: these differ in no more places than the values, so more than
``MOST_APART`` differences rule a pair out and none within the distance is lost. (Of the texts at the similarity limit itself,
0.5 % lie further apart, since signatures are drawn; most of them still meet and differ in 9.6 of the 64, with a deviation of
2.9, so that 1 in 100,000 is lost.)

No pair of an index entry becomes a row. A task compares the two-bit values of an entry's classes as arrays and passes on
only which classes hang together by pairs that may be similar: a forest, no longer than the entry. The forests of all
entries make candidate groups, whose full sets meet in tasks where common shingles are counted for all pairs at once; what is
passed on is again a forest, of the confirmed links. Entries of more than ``ENTRY`` and groups of more than ``BLOCK`` classes are
compared in pairs of blocks (see ``blocks``), first each block alone and with one of them, then, only where this leaves a
group in parts, all the others.

Defined results: null and empty texts and those without words have an empty set and no links; texts shorter than a shingle
are one shingle; repeated rows fall into one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import durable, texts_of
from .blocks import dealt, first_pairs, forest, halves, other_pairs, parted, runs, tiles, with_blocks
from .graph import BROADCAST_IDS, components

CHUNKS, CHUNK = 12, 6
MOST_APART = 2 * CHUNKS - 1
VALUES = CHUNKS * CHUNK
SEED = 20240229
#: Classes of a block of an index entry, of a block of a group; columns of shingles that are counted at once.
ENTRY, BLOCK, COLUMNS = 4096, 512, 4096
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. Words: lower-cased A-Z, split at ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > 300_000:
        known.clear()
    ids = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    a = np.array(ids, np.uint64)
    n = max(1, len(a) - width + 1)
    h = np.full(n, len(a) if len(a) < width else width, np.uint64)
    for k in range(min(width, len(a))):
        h = h * FACTOR + a[k : n + k]
    return np.unique(_mix(h))


def signature(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The MinHash values' 16 bits."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 2048):
        least = np.minimum(least, (factors[:, None] * s[None, lo : lo + 2048]).min(1))
    return (_mix(least) >> np.uint64(48)).astype(np.uint64)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each chunk and each value left out of it."""
    c = sig.reshape(CHUNKS, CHUNK)
    out = []
    for skip in range(CHUNK):
        h = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(skip + 1)
        for k in range(CHUNK):
            if k != skip:
                h = _mix(h * FACTOR + c[:, k])
        out.append(h)
    return np.concatenate(out)


def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signed(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, t, h, w0, w1, keys): set size, text digest, set digest, two bits of 64 values, index keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        factors = _factors()
        places = np.arange(32, dtype=np.uint64) * np.uint64(2)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, h, w, keys = [], [], [], []
                for text in texts_of(part):
                    s = shingles(text, width, known)
                    n.append(len(s))
                    h.append(hashlib.md5(s.tobytes()).digest())
                    if len(s):
                        v = signature(s, factors)
                        w.append(((v[:64].reshape(2, 32) & np.uint64(3)) << places).sum(1).view(np.int64))
                        keys.append(index_keys(v).view(np.int64))
                    else:
                        w.append((0, 0))
                        keys.append([])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), part.column(2), pa.array(h, pa.binary()), pa.array([x[0] for x in w], pa.int64()), pa.array([x[1] for x in w], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "t", "h", "w0", "w1", "keys"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, t binary, h binary, w0 long, w1 long, keys array<long>")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the 64 two-bit values of each pair of signatures (rows of two words) differ."""
    total = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        x = a[:, None, k] ^ b[None, :, k]
        total += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
    return total


def candidate_forest(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): what the classes of each index entry hang together by. entries: (key, i, j, block, cid, n, w0, w1), of ``dealt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for table in runs(batches, 3):
            if table.num_rows < 2:
                continue
            order, first = halves(table.column(3).to_numpy(), table.column(1)[0].as_py(), table.column(2)[0].as_py())
            cid, n = table.column(4).to_numpy()[order], table.column(5).to_numpy()[order]
            w = np.stack([table.column(k).to_numpy() for k in (6, 7)], 1).astype(np.int64).view(np.uint64)[order]

            def near(a: slice, b: slice, n=n, w=w) -> np.ndarray:
                out = (differing(w[a], w[b]) <= MOST_APART) & (n[a][:, None] * 100 >= n[b] * percent) & (n[b] * 100 >= n[a][:, None] * percent)
                return np.tril(out, -1) if a == b else out

            found = forest(len(n), ((a, b, lambda a=a, b=b: near(a, b)) for a, b in tiles(len(n), first, 1024)))
            pairs = {(int(min(cid[i], cid[j])), int(max(cid[i], cid[j]))) for i, j in found} - seen
            if len(seen) > 500_000:
                seen.clear()
            seen |= pairs
            if pairs:
                a, b = zip(*sorted(pairs))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return entries.mapInArrow(run, "a long, b long").distinct()


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each pair of sets (sorted arrays without repeats)."""
    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])

    (va, ra), (vb, rb) = flat(a), flat(b)
    names = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(names):
        return out.astype(np.int64)
    pa_, pb = np.searchsorted(names, va), np.searchsorted(names, vb)
    ka, kb = names[np.minimum(pa_, len(names) - 1)] == va, names[np.minimum(pb, len(names) - 1)] == vb
    pa_, ra, pb, rb = pa_[ka], ra[ka], pb[kb], rb[kb]
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    pa_, ra, pb, rb = pa_[oa], ra[oa], pb[ob], rb[ob]
    for lo in range(0, len(names), COLUMNS):
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        for m, p, r in ((x, pa_, ra), (y, pb, rb)):
            i, j = np.searchsorted(p, (lo, lo + COLUMNS))
            m[r[i:j], p[i:j] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def confirmed_forest(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what the full sets connect. pairs: (gid, i, j, block, cid, s), of ``dealt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            if table.num_rows < 2:
                continue
            order, first = halves(table.column(3).to_numpy(), table.column(1)[0].as_py(), table.column(2)[0].as_py())
            cid = table.column(4).to_numpy()[order]
            sets = [np.asarray(x.values if hasattr(x, "values") else x, np.int64) for x in table.column(5)]
            sets = [sets[k] for k in order]
            size = np.array([len(x) for x in sets])

            def near(a: slice, b: slice, sets=sets, size=size) -> np.ndarray:
                both = common(sets[a], sets[b])
                out = both * 100 >= (size[a][:, None] + size[b] - both) * percent
                return np.tril(out, -1) if a == b else out

            links = forest(len(cid), ((a, b, lambda a=a, b=b: near(a, b)) for a, b in tiles(len(cid), first, BLOCK)))
            if links:
                a, b = zip(*((int(cid[x]), int(cid[y])) for x, y in links))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def link(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, t) of every document; one of each component is kept.

    component_id: the least doc_id reachable by links of similarity percent / 100 or more; of rows that repeat the least
    doc_id only those of its value are kept. t: the text's digest.
    """
    rows = durable(signed(documents, width).withColumn("uid", F.monotonically_increasing_id()), "neardup-signed")
    # of equal sets one goes on: the classes, by their first row
    classes = rows.where("n > 0").groupBy("h").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("least"))
    classes = durable(classes, "neardup-classes")
    first = classes.select(F.col("cid").alias("uid"))
    first = F.broadcast(first) if first.count() <= BROADCAST_IDS else first
    one = rows.join(first, "uid", "left_semi").withColumnRenamed("uid", "cid")
    index = one.select(F.explode("keys").alias("key"), "cid").repartition("key")
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = durable(index.join(shared, "key"), "neardup-members")
    columns = ("cid", "n", "w0", "w1")
    entries = with_blocks(members.join(one.select(*columns), "cid"), "c", ENTRY)
    hang = durable(candidate_forest(dealt(entries, first_pairs(), ("key",), columns), percent), "neardup-hang")
    groups = components(hang)
    again = parted(with_blocks(members.where(F.col("c") > 2 * ENTRY), "c", ENTRY), ("key",), groups)
    if not again.isEmpty():
        again = again.join(one.select(*columns), "cid")
        groups = components(hang.unionByName(candidate_forest(dealt(again, other_pairs(), ("key",), columns), percent)))
    groups = groups.withColumnRenamed("id", "cid").withColumnRenamed("comp", "gid")
    # the full sets of the classes in groups, from the texts
    need = durable(groups.join(one.select("cid", "t"), "cid"), "neardup-groups")
    few = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
    texts = documents.select(F.col("text").cast("string").alias("text")).withColumn("t", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    texts = texts.join(few.select("cid", "t"), "t").groupBy("cid").agg(F.first("text").alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, width, known).view(np.int64) for t in texts_of(part)], pa.list_(pa.int64()))], names=["cid", "s"])

    sets = durable(texts.select("cid", "text").mapInArrow(whole, "cid long, s array<long>"), "neardup-sets")
    sizes = need.groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    at = durable(with_blocks(need.select("cid", "gid").join(sizes, "gid"), "size", BLOCK), "neardup-blocks")
    links = durable(confirmed_forest(dealt(at.join(sets, "cid"), first_pairs(), ("gid",), ("cid", "s")), percent), "neardup-links")
    comp = components(links)
    again = parted(at, ("gid",), comp)
    if not again.isEmpty():
        more = confirmed_forest(dealt(again.join(sets, "cid"), other_pairs(), ("gid",), ("cid", "s")), percent)
        comp = components(links.unionByName(more))
    of = classes.join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = of.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = of.join(least, "comp").select("h", "component_id")
    out = rows.select("doc_id", "n", "h", "t").join(of, "h", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull()).alias("kept"), "t")


def deduplicated(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one of each component, all their columns; of rows that repeat it the first by digest and id."""
    verdict = link(documents, width, percent).where("kept").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "n_shingles").distinct()
    docs = documents.withColumn("_md5", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    stay = docs.join(verdict, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_md5") == F.col("_t")))
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("_md5"))
    return stay.withColumn("_rank", F.when((F.col("n_shingles") > 0) & F.col("_id").isNotNull(), rank).otherwise(1)).where("_rank = 1").select(*[F.col(f"`{c}`") for c in documents.columns])
