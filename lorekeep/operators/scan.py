"""Running sums on two levels, for keys that may hold any share of the rows.

The rows are dealt by ranges of (keys, order), so a large key lies in many tasks; each task sums its own rows as a stream.
What the tasks before it have of a key is added from a table of one row per task at most: only the first key of a task can
have begun in an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import durable


def _starts(batch: pa.RecordBatch, n_keys: int, last: pa.RecordBatch | None) -> np.ndarray:
    """Which rows begin a key."""
    new = np.zeros(batch.num_rows, bool)
    for k in range(n_keys):
        column = batch.column(k)
        head = last.column(k) if last is not None else pa.nulls(1, column.type)
        before = pa.concat_arrays([head, column.slice(0, batch.num_rows - 1)])
        same = pc.or_(pc.fill_null(pc.equal(column, before), False), pc.and_(column.is_null(), before.is_null()))
        new |= ~same.to_numpy(zero_copy_only=False)
    if last is None:
        new[0] = True
    return new


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], label: str = "running") -> DataFrame:
    """df, written once, with a long per name in values: the sum of it over the key's rows up to this one, this one included.

    Rows that are equal in keys and order come in any order. Nulls come first, and null keys are a key. values must not be null.
    """
    names = list(values)
    given = df.withColumns({n: c.cast("long") for n, c in values.items()})
    held = [*keys, *[c for c in given.columns if c not in keys]]
    out = T.StructType([given.schema[c] for c in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _starts(batch, len(keys), last)
            at = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), -1))
            columns = {c: batch.column(k) for k, c in enumerate(held)}
            for k, n in enumerate(names):
                v = columns[n].to_numpy(zero_copy_only=False)
                total = np.cumsum(v)
                total = np.where(at < 0, total + carry[k], total - (total - v)[np.maximum(at, 0)])
                carry[k] = total[-1]
                columns[n] = pa.array(total, pa.int64())
            last = pa.RecordBatch.from_arrays([batch.column(k).slice(batch.num_rows - 1) for k in range(len(keys))], names=keys)
            yield pa.RecordBatch.from_arrays([columns[c] for c in held], names=held)

    sorted_ = given.select(held).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = durable(sorted_.mapInArrow(run, out).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), label)
    ends = placed.groupBy(*keys, "_part").agg(F.max(F.struct("_at", *names)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), *[F.sum(f"_m.{n}").over(before).alias(f"_{n}") for n in names])
    carry = carry.where(F.col(f"_{names[0]}").isNotNull())
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    # one row per task at most
    full = placed.join(F.broadcast(carry), on, "left")
    return full.select(*[c for c in df.columns if c not in names], *[(F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in names])
