"""The training-data pipeline: toxicity, near-dedup, decontamination, tokens; each stage works on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import bpe, decontaminate, minhash, toxicity
from concord.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text operator 4 predicts toxic go, whether they have a doc_id or not. Null and empty texts stay (they have
    no evidence); with no labels nothing goes."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class of operator 2 the document with the smallest doc_id stays, with all rows that repeat that
    doc_id; of a class without any doc_id one row stays. Null and empty texts are one class."""
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text operator 7 finds contaminated go, whether they have a doc_id or not; null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed little-endian unsigned 32-bit) and whether they decode to the text; null
    and empty texts have no ids."""
    got = bpe.coded(docs.select("doc_id", "lang", "source", "text"), bpe.default_vocabulary())
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return got.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("toxicity", without_toxic), ("minhash near-dedup", without_copies), ("benchmark decontamination", without_benchmark), ("bpe", as_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
