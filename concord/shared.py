"""The folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir. Where it names nothing, a temporary folder, on a local master only:
    on a cluster executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = context.getCheckpointDir()
    return current


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whatever reads it and whichever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TASK_ROWS = 500_000


def partitions(df: DataFrame) -> int:
    """How many partitions the rows of ``df``, a table as it is read (counted by its footers), ask for at TASK_ROWS rows a
    task: 0 where one for each core will do, and never fewer than the session's number otherwise."""
    n = math.ceil(df.count() / TASK_ROWS)
    spark = df.sparkSession
    return 0 if n <= spark.sparkContext.defaultParallelism else max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over ``n`` partitions (see partitions), so that what a task holds doesn't grow with the
    table. Spark's own choice (0) puts small partitions together by their compressed bytes, of which millions of narrow
    rows need few."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)
