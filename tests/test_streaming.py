from pyspark.sql import functions as F

from concord.streaming import landing


def test_rules_run_on_a_stream_as_on_a_table(spark, tmp_path):
    spark.createDataFrame([(1, "F"), (2, "O")], "id int, s string").write.parquet(f"{tmp_path}/in")
    program = {"defaults": {"role": {"value": "other"}}, "rules": [{"name": "f", "when": {"status": "^F$"}, "set": {"role": "treated"}}]}
    stream = landing.labels(spark, f"{tmp_path}/in", "id int, s string").withColumn("labels", F.create_map(F.lit("status"), "s"))
    q = landing.standardized(stream, program).select("id", "role").writeStream.format("memory").queryName("landed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.role) for r in spark.table("landed").collect()} == {(1, "treated"), (2, "other")}


def test_landed_counts_leave_out_late_rows(spark, tmp_path):
    def land(rows):
        df = spark.createDataFrame(rows, "s long, source string").select(F.timestamp_seconds("s").alias("at"), "source")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    land([(0, "a"), (10, "a"), (20, "b")])
    stream = landing.labels(spark, f"{tmp_path}/in", "at timestamp, source string")
    q = landing.landed_counts(stream, "at", "source").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    for more in ([(4 * 3600, "a")], [(30, "a"), (8 * 3600, "b")], [(12 * 3600, "b")]):  # (30, "a") comes too late
        q.processAllAvailable()
        land(more)
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start.timestamp() // 3600, r.source): r.n for r in spark.table("counts").collect()}
    assert got[(0, "a")] == 2 and got[(0, "b")] == 1
