"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.shared import shared_dir


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 4) -> None:
    """Arrow batches of ``rows`` rows and about ``mb`` MB at most, since a row may be a long document; a batch has one row
    at least. The session's own row setting is lowered, never raised."""
    if not 0 < int(spark.conf.get(BATCH, "10000")) <= rows:
        spark.conf.set(BATCH, str(rows))
    spark.conf.set(BATCH_BYTES, f"{mb}m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, in one folder a Spark application: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in the one column of ``gone``; rows with a null key stay. ``gone`` is written
    and counted, and broadcast only if it is small."""
    own = private(docs)
    gone = written(gone.toDF(own).where(F.col(own).isNotNull()).distinct(), "gone")
    side = F.broadcast(gone) if salted_rows_bound(gone, BROADCAST_ROWS) else gone
    return docs.join(side, key == side[own], "left_anti")


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, hinted for broadcast only if it has at most ``limit`` rows."""
    return F.broadcast(df) if salted_rows_bound(df, limit) else df


def text_digest(text: Column) -> Column:
    """Names a text; null and empty texts share one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def private(df: DataFrame, name: str = "_own") -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def salted_rows_bound(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than it needs to know."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit
