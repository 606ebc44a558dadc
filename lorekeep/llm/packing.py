"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Every task packs its own pieces best-fit (longest first); bins that are nearly full are emitted. The underfull bins go
on as items into a tree of merges: each level brings the bins of ``MERGE`` tasks together and packs them best-fit again.
A level's tasks get a bounded number of bins; merging ends when a level no longer lowers the number of bins by
``LEAST_GAIN`` or all bins are in one group, so nothing is ever gathered whole.

Defined results: a null or empty text is a document of one token, the end-of-text id; repeated rows are packed each on
its own; ties go to the smaller document id and piece; an empty table gives an empty result; other columns are ignored.
Token ids are those of the ``tokenizers`` file, its added tokens included; tiktoken, which reads the same vocabulary as
ranks, computes them faster, and texts that hold an added token or that it cannot take go to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable, slices, texts_of

LENGTH, END_ID = 1024, 2
#: Bins with at most so many free places are closed.
SLACK = 2
#: Groups of bins that meet in one task of the next level, and the bins that a task takes, about.
MERGE, TASK_BINS = 8, 20_000
LEAST_GAIN = 0.002
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

_loaded: dict[str, tuple] = {}


def encoder(path: str, ranks: str):
    """A function from text to little-endian unsigned 32-bit ids; loaded once per Python worker."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        added = [t.content for t in exact.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={}), exact, added
    fast, exact, added = _loaded[path]

    def plain(text: str) -> bytes:
        return np.asarray(exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(text: str) -> bytes:
        if any(t in text for t in added):
            return plain(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except BaseException as e:  # the fast library panics on some inputs, in a class of its own
            if type(e).__name__ != "PanicException":
                raise
            return plain(text)

    return ids


def cut(n: int, most: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first may be shorter, the others are full."""
    first = (n - 1) % most + 1
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def pieces(documents: DataFrame, path: str, ranks: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path, ranks)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                raw = ids(text or "") + end
                out += [(doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(raw) // 4))]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], most: int = LENGTH) -> list[list[int]]:
    """Indexes of the items of each bin; longest items first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(most + 1)]
    rooms: list[int] = []  # rooms that some bin has, ascending
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, most - n
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
            room -= n
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append(b)
    return bins


def _level(items: DataFrame, level: int) -> DataFrame:
    """Bins of each task: rows (item, bin, at, fill): where each item lies in its bin; fill is the bin's in its first row, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fills = [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            fills += batch.column(1).to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (-fills[i], keys[i]))
        keys, fills = [keys[i] for i in order], [fills[i] for i in order]
        part = TaskContext.get().partitionId()
        rows = []
        for k, members in enumerate(best_fit(fills)):
            at = 0
            for m in members:
                rows.append((keys[m], (level << 58) | (part << 34) | k, at, sum(fills[x] for x in members) if at == 0 else 0))
                at += fills[m]
        for lo in range(0, len(rows), 100_000):
            cols = list(zip(*rows[lo : lo + 100_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "bin", "at", "fill"])

    return items.select("item", "fill").mapInArrow(run, "item long, bin long, at long, fill long")


def pack(documents: DataFrame, path: str, ranks: str, slack: int = SLACK, merge: int = MERGE) -> DataFrame:
    """Every piece with its sequence and its place there; the columns of PIECES."""
    cut_up = durable(pieces(documents, path, ranks).withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    full = cut_up.where(F.col("length") >= LENGTH).withColumn("sequence_id", F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    placed = cut_up.where(F.col("length") < LENGTH)
    # (root: the piece, at: its place in the bin that holds it, item: that bin)
    holds = placed.select(F.col("item").alias("root"), F.col("item"), F.lit(0).cast("long").alias("at"))
    open_bins = placed.select("item", F.col("length").alias("fill"))
    n = open_bins.count()
    settled = []
    groups, level = max(1, -(-n // TASK_BINS)), 1
    while n:
        dealt = open_bins.repartition(groups, F.xxhash64("item", F.lit(level)))
        met = durable(_level(dealt, level), f"pack-level{level}")
        bins = met.where("fill > 0").select(F.col("bin").alias("item"), "fill")
        moved = holds.join(met.select("item", "bin", F.col("at").alias("more")), "item")
        holds = durable(moved.select("root", F.col("bin").alias("item"), (F.col("at") + F.col("more")).alias("at")), f"pack-holds{level}")
        made = bins.count()
        if groups == 1 or level > 1 and made > (1 - LEAST_GAIN) * n:
            break
        closed = bins.where(F.col("fill") >= LENGTH - slack).select("item")
        open_bins = bins.where(F.col("fill") < LENGTH - slack)
        settled.append(holds.join(closed, "item", "left_semi"))
        holds = holds.join(closed, "item", "left_anti")
        n, level = open_bins.count(), level + 1
        groups = max(1, -(-groups // merge), -(-n // TASK_BINS) if n > 4 * TASK_BINS else 1)
    for s in settled:
        holds = holds.unionByName(s)
    rest = placed.join(holds.select(F.col("root").alias("item"), F.col("item").alias("sequence_id"), F.col("at").alias("offset")), "item")
    out = rest.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return full.select(*out.columns).unionByName(out)
