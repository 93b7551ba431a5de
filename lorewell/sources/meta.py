"""Message exports of two services as JSON folders, in the plain and in the encrypted-chat layout, as table rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.ids import content_key, minted
from lorewell.functions.text import demojibake, is_notice, media_bucket, media_type, thread_kind, thread_title
from lorewell.sources.detect import Source

_MEDIA = "array<struct<uri:string>>"
#: share stays JSON text, so that keys beyond the known ones are kept.
DYI = f"""title string, thread_path string, participants array<struct<name:string>>, image struct<uri:string>,
messages array<struct<sender_name:string, timestamp_ms:bigint, content:string, is_unsent:boolean, photos:{_MEDIA}, videos:{_MEDIA}, audio_files:{_MEDIA}, files:{_MEDIA},
gifs:{_MEDIA}, sticker:struct<uri:string>, share:string, reactions:array<struct<reaction:string, actor:string>>>>"""
SECURE = """threadName string, participants array<string>, messages array<struct<senderName:string, timestamp:bigint, text:string, isUnsent:boolean, type:string,
media:array<struct<uri:string>>, reactions:array<struct<actor:string, reaction:string>>>>"""
# The order of media in a source key.
BUCKETS = ("photos", "videos", "audio_files", "files", "gifs")


def read_dyi(spark: SparkSession, source: Source) -> DataFrame:
    return spark.read.schema(DYI).option("multiLine", True).json(f"{source.path}/messages/inbox/*/message_*.json").withColumn("file", F.col("_metadata.file_path"))


def read_secure(spark: SparkSession, source: Source) -> DataFrame:
    """The encrypted-chat layout in terms of the plain one: unsent rows lose their text, rows without a time are dropped."""
    raw = spark.read.schema(SECURE).option("multiLine", True).json(f"{source.path}/*.json").withColumn("file", F.col("_metadata.file_path"))
    stem = F.regexp_extract(F.url_decode("file"), r"([^/]+)\.json$", 1)
    none = F.array().cast(_MEDIA)

    def bucket(m: Column, which: str) -> Column:
        return F.coalesce(F.filter(m["media"], lambda e: e["uri"].isNotNull() & (media_bucket(media_type(e["uri"])) == which)), none)

    def message(m: Column) -> Column:
        unsent = F.coalesce(m["isUnsent"], F.lit(False))
        return F.struct(
            F.coalesce(m["senderName"], F.lit("")).alias("sender_name"), m["timestamp"].alias("timestamp_ms"), F.when(~unsent, F.coalesce(m["text"], F.lit(""))).alias("content"), unsent.alias("is_unsent"),
            *[bucket(m, b).alias(b) if b != "gifs" else none.alias(b) for b in BUCKETS], F.lit(None).cast("struct<uri:string>").alias("sticker"), F.lit(None).cast("string").alias("share"),
            F.transform(m["reactions"], lambda r: F.struct(r["reaction"].alias("reaction"), r["actor"].alias("actor"))).alias("reactions"),
        )

    messages = F.transform(F.filter("messages", lambda m: m["timestamp"].isNotNull()), message)
    rows = raw.where(F.col("messages").isNotNull() & F.col("participants").isNotNull()).select(
        F.coalesce(F.nullif(F.trim("threadName"), F.lit("")), thread_title(stem)).alias("title"), F.concat(F.lit("secure/"), stem).alias("thread_path"),
        F.transform("participants", lambda p: F.struct(p.alias("name"))).alias("participants"), F.lit(None).cast("struct<uri:string>").alias("image"), messages.alias("messages"), "file",
    )
    return rows.where(F.size("messages") > 0)


def stage(spark: SparkSession, source: Source) -> dict[str, DataFrame]:
    """An export's rows by table, with an ``ordinal`` where the first of a key wins."""
    platform = F.lit(source.platform)
    raw = (read_secure if source.kind == "secure" else read_dyi)(spark, source)
    folder = F.regexp_extract(F.url_decode("file"), r"([^/]+)/[^/]+$", 1)
    threads = raw.withColumn("thread_path", F.coalesce("thread_path", F.concat(F.lit("inbox/"), folder)))
    title = F.coalesce(F.nullif(demojibake(F.col("title")), F.lit("")), folder)
    people = F.transform(F.coalesce("participants", F.array().cast("array<struct<name:string>>")), lambda p: demojibake(F.coalesce(p["name"], F.lit(""))))
    threads = threads.select("file", "thread_path", title.alias("title"), people.alias("members"), "messages", minted(platform, F.col("thread_path")).alias("channel_id"))

    rows = threads.select("file", "thread_path", "channel_id", F.posexplode("messages").alias("ordinal", "m")).select("file", "thread_path", "channel_id", "ordinal", "m.*")
    media = F.concat(*[F.coalesce(F.transform(b, lambda e: e["uri"]), F.array().cast("array<string>")) for b in BUCKETS])
    rows = rows.withColumn("uris", media)
    rows = rows.withColumn("source_key", _keys(platform, "thread_path", "sender_name", "timestamp_ms", "content", "sticker", "share", "uris"))
    rows = rows.withColumn("text", F.coalesce(demojibake(F.col("content")), F.lit(""))).withColumn("sender", F.coalesce(F.nullif(demojibake(F.col("sender_name")), F.lit("")), F.lit("(unknown)")))
    rows = rows.withColumn("entries", F.filter(F.concat("uris", F.array("sticker.uri")), lambda u: u.isNotNull()))
    rows = rows.withColumn("notice", is_notice(F.col("text")) & F.coalesce(F.col("share").isin("{}", ""), F.lit(True)) & (F.size("entries") == 0))
    kept = rows.where("NOT notice").withColumn("message_id", minted(F.col("source_key"))).withColumn("sender_id", minted(platform, F.lit("user"), F.col("sender")))

    reactions = kept.select("message_id", "channel_id", "file", "ordinal", F.posexplode("reactions").alias("at", "r")).select(
        "message_id", "file", "ordinal", "at", F.coalesce(F.nullif(demojibake(F.col("r.reaction")), F.lit("")), F.lit("?")).alias("emoji_name"), F.coalesce(F.nullif(demojibake(F.col("r.actor")), F.lit("")), F.lit("(unknown)")).alias("actor"))
    reactions = reactions.withColumn("user_id", minted(platform, F.lit("user"), F.col("actor")))
    files = kept.select("message_id", F.explode("entries").alias("uri")).withColumn("attachment_id", minted(platform, F.lit("attachment"), F.col("uri")))
    listed = threads.select("channel_id", F.explode("members").alias("name"))
    everyone = listed.select("name").unionByName(kept.select(F.col("sender").alias("name"))).unionByName(reactions.select(F.col("actor").alias("name"))).distinct().withColumn("id", minted(platform, F.lit("user"), F.col("name")))
    size = F.size("members")
    channels = threads.groupBy("channel_id").agg(F.max_by(F.struct("title", "thread_path", thread_kind(size).alias("kind")), "file").alias("t"))
    share = F.col("share").isNotNull() & ~F.col("share").isin("{}", "")
    embeds = kept.where(share).select("message_id", _share("share").alias("json"))
    return {
        "servers": channels.select(F.col("channel_id").alias("id"), F.col("t.title").alias("name"), F.col("t.kind").alias("type"), platform.alias("platform")),
        "channels": channels.select(F.col("channel_id").alias("id"), F.col("channel_id").alias("server"), F.col("t.title").alias("name"), F.col("t.thread_path").alias("topic"), F.lit(0).alias("nsfw"), platform.alias("platform")),
        "users": everyone.select("id", "name", F.col("name").alias("display_name"), platform.alias("platform")),
        "channel_participants": listed.select("channel_id", minted(platform, F.lit("user"), F.col("name")).alias("user_id")).unionByName(kept.select("channel_id", F.col("sender_id").alias("user_id"))).distinct(),
        "messages": kept.select("message_id", "sender_id", "channel_id", "text", F.col("timestamp_ms").alias("timestamp"), platform.alias("platform"), "source_key", F.coalesce(F.col("is_unsent"), F.lit(False)).cast("int").alias("is_unsent"), "file", "ordinal"),
        "attachments": files.select("attachment_id", F.regexp_extract("uri", r"([^/]+)$", 1).alias("name"), F.col("uri").alias("normalized_url"), F.lit(0).alias("size"), platform.alias("platform")).withColumn("type", media_type(F.col("name"))).dropDuplicates(["attachment_id"]),
        "message_attachments": files.select("message_id", "attachment_id").distinct(),
        "message_reaction_actors": reactions.select("message_id", "user_id", "emoji_name").distinct(),
        "message_reactions": reactions.groupBy("message_id", "emoji_name").agg(F.count("*").alias("count")).withColumn("emoji_flags", F.lit(0)),
        "message_embeds": embeds,
        "_notices": rows.where("notice").select("file", "ordinal"),
    }


def _keys(platform: Column, *columns: str) -> Column:
    @F.pandas_udf("string")
    def apply(platform: pd.Series, path: pd.Series, sender: pd.Series, ts: pd.Series, content: pd.Series, sticker: pd.DataFrame, share: pd.Series, uris: pd.Series) -> pd.Series:
        import json

        out = []
        for p, t, s, ms, c, k, sh, u in zip(platform, path, sender, ts, content, sticker["uri"], share, uris):
            link = (json.loads(sh) or {}).get("link") if sh else None
            out.append(content_key(p, t, s, None if ms is None or ms != ms else int(ms), c or "", k, link, list(u)))
        return pd.Series(out)

    return apply(platform, *columns)


def _share(column: str) -> Column:
    @F.pandas_udf("string")
    def apply(shares: pd.Series) -> pd.Series:
        import json

        def repaired(v):
            if not isinstance(v, str):
                return v
            try:
                return v.encode("latin-1").decode("utf-8")
            except UnicodeError:
                return v

        return pd.Series([json.dumps({"type": "share"} | {k: repaired(v) for k, v in json.loads(s).items()}, ensure_ascii=False) for s in shares])

    return apply(column)
