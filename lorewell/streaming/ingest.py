"""Streams: an append-only import by micro-batches, and event-time windows. Extensions beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.writes import first_wins


def stream_append(rows: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str):
    """Appends each micro-batch's new keys to the Parquet table at ``target``. A repeated batch adds nothing: its folder
    is named by the batch and overwritten."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        new = first_wins(batch, keys, order)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            earlier = spark.read.parquet(target).where(F.col("batch") < batch_id).select(*keys).distinct()
            new = new.join(earlier, keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of event time; later events than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy("event_type", F.window("ts", length)).agg(F.count("*").alias("events"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of one user's events without a pause of ``gap``."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
