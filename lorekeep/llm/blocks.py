"""Groups that are compared in blocks: no task gets more than two blocks of a group, however large it is.

A group of n members has ceil(n / block) blocks, and every pair of blocks (i, j), i <= j, is a unit of work of its own. Where
only what hangs together matters, the first round takes each block alone and with block 0; only groups that this leaves in
several parts need the other pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_blocks(members: DataFrame, size: str, most: int, cid: str = "cid") -> DataFrame:
    """members with blocks (their number in the group of that size) and block (the member's)."""
    return members.withColumn("blocks", F.ceil(F.col(size) / most).cast("int")).withColumn("block", F.pmod(F.xxhash64(cid), F.col("blocks")).cast("int"))


def every_pair() -> Column:
    """The blocks that a member's block meets if all meet."""
    return F.sequence(F.lit(0), F.col("blocks") - 1)


def first_pairs() -> Column:
    """The blocks that it meets in the first round: itself and block 0."""
    return F.when(F.col("block") == 0, every_pair()).otherwise(F.array(F.lit(0), F.col("block")))


def other_pairs() -> Column:
    """The blocks that it meets in the second round, if any."""
    more = (F.col("blocks") > 2) & (F.col("block") > 0)
    return F.when(more, F.filter(F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1))), lambda x: x != F.col("block"))).otherwise(F.expr("cast(array() as array<int>)"))


def dealt(members: DataFrame, meets: Column, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Rows (*keys, i, j, block, *columns), all of a (*keys, i, j) in one task, in order of the first of columns."""
    rows = members.withColumn("_other", F.explode(meets)).select(*keys, F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", *columns)
    return rows.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", columns[0])


def parted(members: DataFrame, keys: tuple[str, ...], comp: DataFrame, cid: str = "cid") -> DataFrame:
    """The members of groups of more than two blocks that comp (id, comp) leaves in several parts."""
    large = members.where("blocks > 2")
    of = large.join(comp.withColumnRenamed("id", cid), cid, "left").withColumn("comp", F.coalesce("comp", cid))
    apart = of.groupBy(*keys).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select(*keys)
    return large.join(apart, list(keys), "left_semi")


def whole_keys(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about so many rows, or of one larger key, that hold keys whole, and where each key begins and the last ends.

    batches: sorted by their first n_keys columns.
    """
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(k).to_numpy() for k in range(n_keys)], 1)
        return np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))

    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            at = cut(table)
            if len(at) > 2:  # the last key may go on in the next batch
                yield table.slice(0, at[-2]), at[:-1]
                held = table.slice(at[-2]).to_batches()
            n = sum(x.num_rows for x in held)
            rows = max(rows, 2 * n)
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each key of more than one row, of batches sorted by their first n_keys columns."""
    for table, at in whole_keys(batches, n_keys):
        for k in np.flatnonzero(np.diff(at) > 1):
            yield table.slice(at[k], at[k + 1] - at[k])


#: Rows of a key whose pairs are compared for many keys at once.
FEW = 16


def hanging(batches: Iterator[pa.RecordBatch], n_keys: int, cid: int, sides: Callable[[pa.Table], Callable], step: int = 1024) -> Iterator[pa.RecordBatch]:
    """(a, b): the pairs of each (keys, i, j) that are near, as a forest where a key has more than FEW rows.

    batches: of ``dealt``, the block in column n_keys + 2 and the id in column cid; sides(table) gives near(x, y) for places of
    the table: as a matrix for slices or an array for two arrays of equal length, given as near(x, y, True).
    """
    for table, at in whole_keys(batches, n_keys + 2):
        near, ids = sides(table), table.column(cid).to_numpy()
        i, j, block = (table.column(n_keys + k).to_numpy() for k in range(3))
        size = np.diff(at)
        few = (size > 1) & (size <= FEW) & (i[at[:-1]] == j[at[:-1]])
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        starts, lengths = at[:-1][few], size[few]
        for lag in range(1, int(lengths.max(initial=1))):
            some = lengths > lag
            count = lengths[some] - lag
            x = np.repeat(starts[some] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            ok = near(x, x + lag, True)
            left.append(x[ok])
            right.append(x[ok] + lag)
        for k in np.flatnonzero((size > 1) & ~few):
            rows = np.arange(at[k], at[k + 1])
            order, first = halves(block[rows], i[at[k]], j[at[k]])
            rows = rows[order]

            def paired(a: slice, b: slice, rows=rows) -> np.ndarray:
                out = near(rows[a], rows[b], False)
                return np.tril(out, -1) if a == b else out

            found = forest(len(rows), ((a, b, lambda a=a, b=b: paired(a, b)) for a, b in tiles(len(rows), first, step)))
            if found:
                x, y = np.array(found).T
                left.append(rows[x])
                right.append(rows[y])
        if left:
            x, y = ids[np.concatenate(left)], ids[np.concatenate(right)]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def forest(n: int, blocks: Iterator[tuple[slice, slice, Callable[[], np.ndarray]]]) -> list[tuple[int, int]]:
    """Pairs (i, j) that connect what the given blocks connect: rows, columns, and a function to what is paired there.

    A block all of whose rows and columns hang together already is not computed.
    """
    root = np.arange(n)
    out = []
    for rows, cols, paired in blocks:
        one = root[rows.start]
        if (root[rows] == one).all() and (root[cols] == one).all():
            continue
        near = paired()
        for i in np.flatnonzero(near.any(1)):
            while True:  # each turn joins two trees, so there are fewer than n in all
                other = np.flatnonzero(near[i] & (root[cols] != root[rows.start + i]))
                if not len(other):
                    break
                j = cols.start + int(other[0])
                out.append((rows.start + int(i), j))
                root[root == root[j]] = root[rows.start + i]
    return out


def halves(block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, int]:
    """The places of the rows, those of block i before those of block j, and how many block i has (all, if i = j)."""
    return (np.arange(len(block)), len(block)) if i == j else (np.argsort(block != i, kind="stable"), int((block == i).sum()))


def tiles(n: int, first: int, step: int) -> Iterator[tuple[slice, slice]]:
    """Tiles (rows, columns) of the pairs to compare: below the diagonal if first = n, else of the rest against the first."""
    if first == n:
        for top in range(0, n, step):
            for left in range(0, top + 1, step):
                yield slice(top, min(top + step, n)), slice(left, min(left + step, n))
    else:
        for top in range(first, n, step):
            for left in range(0, first, step):
                yield slice(top, min(top + step, n)), slice(left, min(left + step, first))
