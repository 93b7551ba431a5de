"""The archive's tables: columns, keys, and how an import writes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    columns: str
    keys: tuple[str, ...]
    write: str  # append | upsert | replace (children of a parent: the first key)
    keep_old: tuple[str, ...] = ()


# Names and types of the archive's columns.
TABLES = {
    "servers": Table("id bigint, name string, type string, platform string", ("id",), "upsert"),
    "channels": Table("id bigint, server bigint, name string, parent_id bigint, position int, topic string, nsfw int, platform string, avatar_sha256 string", ("id",), "upsert", ("avatar_sha256", "parent_id", "position", "nsfw")),
    "users": Table("id bigint, name string, display_name string, avatar_url string, discriminator string, platform string, person_id bigint, avatar_sha256 string", ("id",), "append"),
    "messages": Table("message_id bigint, sender_id bigint, channel_id bigint, text string, timestamp bigint, platform string, source_key string, is_unsent int", ("message_id",), "append"),
    "attachments": Table("attachment_id bigint, name string, type string, normalized_url string, download_url string, size bigint, width int, height int, platform string, local_path string, sha256 string", ("attachment_id",), "upsert", ("sha256", "local_path", "size", "type", "width", "height", "download_url")),
    "message_attachments": Table("message_id bigint, attachment_id bigint", ("message_id", "attachment_id"), "append"),
    "message_embeds": Table("message_id bigint, json string", ("message_id",), "replace"),
    "message_reactions": Table("message_id bigint, emoji_id bigint, emoji_name string, emoji_flags int, count bigint", ("message_id",), "replace"),
    "message_reaction_actors": Table("message_id bigint, user_id bigint, emoji_name string", ("message_id", "user_id", "emoji_name"), "append"),
    "message_replied_to": Table("message_id bigint, replied_to_id bigint", ("message_id",), "upsert"),
    "message_edit_timestamps": Table("message_id bigint, edit_timestamp bigint", ("message_id",), "upsert"),
    "channel_participants": Table("channel_id bigint, user_id bigint", ("channel_id", "user_id"), "append"),
    "people": Table("person_id bigint, display string, is_self int, notes string", ("person_id",), "upsert"),
    "ingest_log": Table("run_id bigint, started_at bigint, finished_at bigint, source_kind string, source_path string, msgs_seen bigint, new_msgs bigint, dup_msgs bigint, skipped_notices bigint, status string, error string", ("run_id",), "append"),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].columns)


def shaped(rows: DataFrame, name: str) -> DataFrame:
    """Rows with exactly the table's columns: missing ones null, types cast."""
    target = empty(rows.sparkSession, name).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])
