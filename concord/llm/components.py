"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the smallest neighbour of each node. Written, so that the join on a node with many edges is a plain one, whose
    large partitions Spark splits."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "cc")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Has every node one root, and is no root a node below another? Counted by node, so one partial aggregation."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges (u, v: long) -> (node, root): the smallest node of each component, for every node but the roots themselves.

    Each round is written to the shared folder. Rounds end when the edges form stars, after about log2 of the
    longest path; not reaching that within ``rounds`` raises. Links that form stars already take no round.
    """
    edges = written(_small(edges.select("u", "v").where("u <> v")), "cc")
    for _ in range(rounds):
        if _stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = written(_small(_large(edges)), "cc")
    raise RuntimeError("components did not settle")
