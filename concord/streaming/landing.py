"""The same operators on rows as they land: Structured Streaming over a folder of label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.rules import apply_rules


def labels(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def standardized(stream: DataFrame, program: dict, ids: str | None = None) -> DataFrame:
    """Rule programs are one projection without a shuffle, so they run on a stream as they are."""
    return apply_rules(stream, program, ids)


def landed_counts(stream: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window and source; rows later than ``late`` behind the newest are left out, so state stays bounded."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count(F.lit(1)).alias("n"))
