"""Token counts (operator 5): an exact histogram of encoded lengths, and suffix sums that answer every context limit.

Documents are encoded whole (operator 10's encoder) and aggregated by length. Suffix sums over the histogram are taken
in two levels, within blocks of STEP lengths and over the blocks, so no window holds more than STEP rows or one row a
block. For a limit L: documents longer than L, their tokens, the total when each document is cut at L, and the
share of documents that fit. Limits between two lengths follow from the next shorter length: no document ends there.

Defined results: null and empty texts have length 0; every row counts, repeated ones too; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import bpe
from concord.llm.common import table, written

STEP = 4096


def lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    return bpe.encode(docs.select("text"), vocabulary).select((F.coalesce(F.length("ids"), F.lit(0)) / 4).cast("long").alias("n_tokens"))


def histogram(sizes: DataFrame) -> DataFrame:
    """n_tokens, docs."""
    return sizes.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def by_limit(hist: DataFrame) -> DataFrame:
    """A row for each length that occurs, taken as context limit, with the answers for it."""
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / STEP)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each STEP lengths
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"), F.sum("bd").over(all_).alias("all_docs"), F.sum("bt").over(all_).alias("all_tokens"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    j = h.withColumn("ld", F.coalesce(F.sum("docs").over(inner), F.lit(0))).withColumn("lt", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(F.broadcast(blocks), "block")  # max length / STEP rows
    longer, longer_tokens = F.col("ld") + F.col("ad"), F.col("lt") + F.col("at")
    return j.select(
        F.col("n_tokens").alias("context_limit"), "docs", "tokens", longer.alias("docs_longer"), longer_tokens.alias("tokens_in_longer"),
        (F.col("all_tokens") - longer_tokens + longer * F.col("n_tokens")).alias("truncated_total"), (longer_tokens - longer * F.col("n_tokens")).alias("tokens_lost"),
        (F.col("all_docs") - longer).alias("docs_that_fit"), F.round((F.col("all_docs") - longer) / F.col("all_docs"), 9).alias("quantile"), "all_docs", "all_tokens",
    )


def answer(limits: DataFrame, context_limit: int) -> DataFrame:
    """One row: the truncated total and fitting documents for any limit."""
    below = limits.where(F.col("context_limit") <= context_limit)
    row = below.agg(F.max_by(F.struct("*"), "context_limit").alias("r"), F.lit(context_limit).alias("context_limit"))
    cut = F.col("r.truncated_total") + F.col("r.docs_longer") * (F.col("context_limit") - F.col("r.context_limit"))
    total = limits.agg(F.max("all_docs").alias("d"))
    return row.crossJoin(total).select("context_limit", F.coalesce(cut, F.col("d") * F.col("context_limit")).alias("truncated_total"), F.coalesce("r.docs_that_fit", F.lit(0)).alias("docs_that_fit"))  # one row each


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the histogram is used twice: written, so that texts are encoded once
    return by_limit(written(histogram(lengths(table(spark, sf_dir, "documents"), bpe.default_vocabulary())), "lengths"))


QUERIES = {"op5_token_counts": query}
ORACLES: dict[str, str] = {}
