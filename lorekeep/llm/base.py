"""What the operators of this subpackage share: reading, durable tables, word rules."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import durable  # noqa: F401

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows whose Python objects a task holds at once; a batch has up to 10,000.
SLICE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def texts_of(batch, name: str = "text"):
    """Python strings of an Arrow batch's column, with None for null."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterator, rows: int = SLICE) -> Iterator:
    """The same rows in order, in parts of batches of at most so many rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
