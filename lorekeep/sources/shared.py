"""Tables in the folder that driver and executors share, to cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local session that names none (tests) gets one of its own; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder: set it to one that the driver and all executors share")
        where = _made.get(context.applicationId) or _made.setdefault(context.applicationId, tempfile.mkdtemp(prefix="lorekeep-"))
    return where.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's name there; ``clear`` deletes it too."""
    path = f"{shared_dir(spark)}/lorekeep-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """df, written as a table there and read again: lost executors cost no recomputation of what came before."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process has written there; returns their number. For when all results are written elsewhere."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as the session has cores, if it has fewer (a table of one row group, say); large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
