from pyspark.sql import functions as F

from lorewell.streaming.ingest import sessions, stream_append, windowed


def test_stream_append_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "k int, o int, v string").coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema("k int, o int, v string").parquet(src)
    stream_append(read(), out, ["k"], ["o"], str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([(2, 0, "z"), (3, 0, "d")], "k int, o int, v string").coalesce(1).write.mode("append").parquet(src)
    stream_append(read(), out, ["k"], ["o"], str(tmp_path / "ck")).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert windowed(events).agg(F.sum("events")).first()[0] == events.count()
    assert sessions(events).agg(F.sum("events")).first()[0] == events.count()
