"""The stream with keyed state leaves the memories of the whole log, after any cut into batches, replacements and restarts."""

from __future__ import annotations

import random

import pytest

from lorekeep.operators import fold
from lorekeep.streaming import state

from .test_segments import SCHEMA, random_log


def run(spark, folder, most=None):
    reader = spark.readStream.schema(SCHEMA + ", tx long").option("maxFilesPerTrigger", 1)
    job = state.ingest(reader.parquet(f"{folder}/in/*"), f"{folder}/out", f"{folder}/check")
    job.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def deliver(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA + ", tx long").coalesce(1).write.parquet(f"{folder}/in/part={k}")


def memories(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def log():
    rng = random.Random(21)
    return random_log(rng, 1, 60) + random_log(rng, 2, 25, slots=2) + random_log(rng, 3, 2)


def test_any_cut_and_restart(spark, log, tmp_path):
    want = memories(fold.apply_ops(spark.createDataFrame(log, SCHEMA)))
    deliver(spark, tmp_path, 0, [(*r, 0) for r in log if r[1] < 20])
    deliver(spark, tmp_path, 1, [(*r, 0) for r in log if 20 <= r[1] < 30])
    first = run(spark, tmp_path)
    assert memories(state.current(first)) == memories(fold.apply_ops(spark.createDataFrame([r for r in log if r[1] < 30], SCHEMA)))
    before = first.count()
    deliver(spark, tmp_path, 2, [(*r, 0) for r in log if r[1] >= 30] + [(*r, 0) for r in log if r[1] == 5])  # started again; one message twice
    after = run(spark, tmp_path)
    assert memories(state.current(after)) == want and after.count() > before
    touched = after.where("batch = 2 and not gone").select("conv_id", "id").distinct().count()
    assert touched < len(want)  # what later operations do not touch is not written again


def test_replaced_and_late_transactions(spark, log, tmp_path):
    rng = random.Random(22)
    new = [r for r in random_log(rng, 1, 60) if r[1] in (3, 17, 40)]
    deliver(spark, tmp_path, 0, [(*r, 1) for r in log if r[1] % 3])
    deliver(spark, tmp_path, 1, [(*r, 1) for r in log if r[1] % 3 == 0])  # late
    deliver(spark, tmp_path, 2, [(*r, 2) for r in new])  # extracted again
    deliver(spark, tmp_path, 3, [(*r, 1) for r in log if r[0] == 1 and r[1] == 17])  # the replaced ones once more
    want = [r for r in log if not (r[0] == 1 and r[1] in (3, 17, 40))] + new
    assert memories(state.current(run(spark, tmp_path))) == memories(fold.apply_ops(spark.createDataFrame(want, SCHEMA)))
