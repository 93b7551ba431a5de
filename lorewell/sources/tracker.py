"""Tracker files (SQLite) of a chat history, as table rows. Ids are the service's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.text import media_type
from lorewell.schema import TABLES
from lorewell.sources.detect import Source
from lorewell.sources.readers import register

COPIED = ("servers", "channels", "users", "messages", "attachments", "message_attachments", "message_embeds", "message_reactions", "message_replied_to", "message_edit_timestamps")


def read(spark: SparkSession, source: Source, table: str, schema: str | None = None) -> DataFrame:
    register(spark)
    return spark.read.format("sqlite_table").schema(schema or TABLES[table].columns).option("path", str(source.path)).option("table", table).load()


def stage(spark: SparkSession, source: Source) -> dict[str, DataFrame]:
    """The file's rows; columns are those both sides know."""
    out = {name: read(spark, source, name) for name in COPIED}
    for name in ("servers", "channels", "users", "messages", "attachments"):
        out[name] = out[name].withColumn("platform", F.lit("discord"))
    out["messages"] = out["messages"].withColumn("is_unsent", F.lit(0))
    out["attachments"] = out["attachments"].withColumn("type", F.coalesce("type", media_type(F.col("name"))))
    out["_blobs"] = read(spark, source, "download_blobs", "normalized_url string, blob binary")
    return out


def recovered(attachments: DataFrame, blobs: DataFrame) -> DataFrame:
    """Attachments whose bytes the file holds, with their digest and size."""
    found = blobs.select("normalized_url", F.sha2("blob", 256).alias("_sha"), F.length("blob").cast("bigint").alias("_size"))
    rows = attachments.join(found, "normalized_url", "left")
    path = F.concat(F.substring("_sha", 1, 2), F.lit("/"), F.col("_sha"), F.lower(F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1)))
    return rows.withColumn("sha256", F.coalesce("sha256", "_sha")).withColumn("local_path", F.coalesce("local_path", path)).withColumn("size", F.coalesce("_size", "size")).drop("_sha", "_size")
