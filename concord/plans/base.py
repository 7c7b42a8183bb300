"""Registration of queries, and the bindings (fx_*) of the operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.shared import dealt, partitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r4(c):
    return F.round(c, 4)


def fx_sample(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"),
        F.col("n_regionkey") == F.col("r_regionkey"))
    role = F.when(F.col("o_orderstatus") == "F", "treated").when(F.col("o_orderstatus") == "O", "vehicle_control").otherwise("untreated_control")
    return o.select(F.col("o_orderkey").alias("sample_id"), F.col("r_name").alias("study_id"),
        F.concat_ws("|", "n_name", F.date_format("o_orderdate", "yyyy-MM")).alias("batch"),
                    F.year("o_orderdate").alias("yr"), F.col("c_mktsegment").alias("line"), role.alias("role"), "n_name", "o_custkey",
                        F.col("o_orderpriority").alias("prio"))


def fx_treatment(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("l_returnflag") == "R", "OHT").when(F.col("l_returnflag") == "A", "E2").otherwise("DMSO")
    lines = t(spark, d, "lineitem")
    given = lines.select(F.col("l_orderkey").alias("sample_id"), c.alias("compound_id"), "l_quantity", "l_linenumber")
    g = dealt(given, partitions(lines), "sample_id").groupBy("sample_id", "compound_id")
    g = g.agg(F.avg("l_quantity").alias("dose"), F.max("l_linenumber").alias("exposure_h"))
    return g.withColumn("exposure_type", F.when(F.col("exposure_h") >= 6, "chronic").otherwise("acute"))


def fx_values(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, feature_id, raw_value; dealt out by sample alone, so that a join on it needs no further shuffle."""
    lines = t(spark, d, "lineitem")
    values = lines.select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("feature_id"), "l_extendedprice")
    return dealt(values, partitions(lines), "sample_id").groupBy("sample_id", "feature_id").agg(F.avg("l_extendedprice").alias("raw_value"))


def fx_measurement(spark: SparkSession, d: str) -> DataFrame:
    m = fx_values(spark, d).join(fx_sample(spark, d).select("sample_id", "study_id"), "sample_id")
    return m.select("study_id", "sample_id", "feature_id", "raw_value")


def fx_feature_map(spark: SparkSession, d: str, measurement: DataFrame | None = None) -> DataFrame:
    m, n = measurement if measurement is not None else fx_measurement(spark, d), partitions(t(spark, d, "lineitem"))
    m = (dealt(m, n, "feature_id") if n else m).groupBy("study_id", "feature_id")  # dealt by feature: part joins it as it is
    m = m.agg(F.avg(F.log2(F.col("raw_value") + 1)).alias("mean"))
    return m.join(t(spark, d, "part"), F.col("feature_id") == F.col("p_partkey")).select("study_id", "feature_id", F.col("p_name").alias("entity"), "mean")


#: The same bindings as SQL, for oracles: "WITH " + these + ", more AS (...)".
FX_SAMPLE = """fx_sample AS (SELECT o_orderkey AS sample_id, r_name AS study_id, n_name || '|' || strftime(o_orderdate, '%Y-%m') AS batch,
    CAST(year(o_orderdate) AS INTEGER) AS yr,
  c_mktsegment AS line, CASE o_orderstatus WHEN 'F' THEN 'treated' WHEN 'O' THEN 'vehicle_control'
    ELSE 'untreated_control' END AS role, n_name, o_custkey, o_orderpriority AS prio
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FX_TREATMENT = """fx_treatment AS (SELECT l_orderkey AS sample_id, CASE l_returnflag WHEN 'R' THEN 'OHT' WHEN 'A' THEN 'E2'
    ELSE 'DMSO' END AS compound_id, avg(l_quantity) AS dose,
  max(l_linenumber) AS exposure_h, CASE WHEN max(l_linenumber) >= 6 THEN 'chronic' ELSE 'acute' END AS exposure_type FROM lineitem
    GROUP BY ALL)"""
FX_MEASUREMENT = FX_SAMPLE + """, fx_measurement AS (SELECT study_id, sample_id, feature_id, raw_value FROM
  (SELECT l_orderkey AS sample_id, l_partkey AS feature_id, avg(l_extendedprice) AS raw_value FROM lineitem GROUP BY ALL)
    JOIN fx_sample USING (sample_id))"""
FX_FEATURE_MAP = FX_MEASUREMENT + """, fx_feature_map AS (SELECT study_id, feature_id, p_name AS entity, avg(log2(raw_value + 1)) AS mean
  FROM fx_measurement JOIN part ON feature_id = p_partkey GROUP BY ALL)"""
