"""Data packages of a chat service: folders ``c<id>`` with messages.json; media links are planned, nothing is downloaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ID bigint, Timestamp string, Contents string, Attachments string"
_LINK = r"/attachments/(\d+)/(\d+)/([^/?#]+)"


def read(spark: SparkSession, root: str) -> DataFrame:
    """(channel_id, message_id, timestamp, text, link): one row a message, or a link of it."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(f"{root}/c*/messages.json").withColumn("file", F.col("_metadata.file_path"))
    channel = F.regexp_extract("file", r"/c(\d+)/messages\.json$", 1).cast("bigint")
    links = F.filter(F.split(F.coalesce("Attachments", F.lit("")), r"\s+"), lambda x: x != "")
    ms = F.unix_millis(F.try_to_timestamp("Timestamp", F.lit("yyyy-MM-dd HH:mm:ss")))
    return raw.select(channel.alias("channel_id"), F.col("ID").alias("message_id"), ms.alias("timestamp"), F.coalesce("Contents", F.lit("")).alias("text"), F.explode_outer(links).alias("link"))


def parsed_link(link: Column) -> Column:
    """struct<channel_id, attachment_id, name, url>: the parts of a media link, its query taken off."""
    part = lambda i: F.regexp_extract(link, _LINK, i)
    return F.when(link.rlike(_LINK), F.struct(part(1).cast("bigint").alias("channel_id"), part(2).cast("bigint").alias("attachment_id"), F.url_decode(part(3)).alias("name"), F.regexp_replace(link, r"[?#].*$", "").alias("url")))


def plan(package: DataFrame, attachments: DataFrame) -> dict[str, DataFrame]:
    """What a rescue has to do: links that the archive doesn't know, those it knows without bytes, and those to be linked."""
    links = package.where("link IS NOT NULL").select("message_id", parsed_link(F.col("link")).alias("l")).where("l IS NOT NULL").select("message_id", "l.*").dropDuplicates(["message_id", "attachment_id"])
    known = attachments.select("attachment_id", "sha256")
    return {
        "absent": links.join(known, "attachment_id", "left_anti"),
        "without_bytes": links.join(known.where("sha256 IS NULL").select("attachment_id"), "attachment_id", "left_semi"),
        "to_link": links.select("message_id", "attachment_id"),
    }
