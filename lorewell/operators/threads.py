"""Threads: roll-ups, members, counterparts, pages and runs, each as one set-based plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorewell.functions.text import name_like, preview
from lorewell.functions.time import day, month


def named_users(users: DataFrame, people: DataFrame) -> DataFrame:
    """user_id, person_id, display (person's, else shown, else own name), is_self."""
    p = people.select("person_id", F.col("display").alias("person"), "is_self")
    joined = users.select(F.col("id").alias("user_id"), "name", "display_name", "person_id", "platform").join(p, "person_id", "left")
    return joined.select("user_id", "person_id", "platform", F.coalesce("person", "display_name", "name").alias("display"), F.coalesce("is_self", F.lit(0)).alias("is_self"))


def rollup(messages: DataFrame) -> DataFrame:
    """channel_id with its messages, first and last time, and latest text; ties go to the later row."""
    latest = F.max_by(F.col("text"), F.struct("timestamp", "row_id"))
    return messages.groupBy("channel_id").agg(F.count("*").alias("messages"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), preview(latest).alias("latest"))


def thread_list(messages: DataFrame, channels: DataFrame, platform: str | None = None, q: str | None = None) -> DataFrame:
    """Threads with messages, newest first. ``platform`` 'all' or None and ``q`` None don't filter."""
    if platform and platform != "all":
        channels = channels.where(F.col("platform") == platform)
    if q:
        channels = channels.where(name_like(F.col("name"), q))
    listed = channels.select(F.col("id").alias("channel_id"), "name", "kind", "platform").join(rollup(messages), "channel_id")
    return listed.orderBy(F.desc("last_ts"), "channel_id")


def members(messages: DataFrame, participants: DataFrame) -> DataFrame:
    """(channel_id, user_id): participants and senders, once each."""
    return participants.select("channel_id", "user_id").unionByName(messages.where("sender_id IS NOT NULL").select("channel_id", F.col("sender_id").alias("user_id"))).distinct()


def member_counts(messages: DataFrame, participants: DataFrame, users: DataFrame, people: DataFrame) -> DataFrame:
    """Every thread's members with their messages; silent members have 0."""
    counts = messages.groupBy("channel_id", F.col("sender_id").alias("user_id")).agg(F.count("*").alias("messages"))
    rows = members(messages, participants).join(counts, ["channel_id", "user_id"], "left").join(named_users(users, people), "user_id")
    return rows.select("channel_id", "user_id", "display", "is_self", F.coalesce("messages", F.lit(0)).alias("messages"))


def counterparts(messages: DataFrame, participants: DataFrame, users: DataFrame, people: DataFrame) -> DataFrame:
    """(channel_id, others, person_id): the person of a thread's only member beside the owner, else null."""
    rows = members(messages, participants).join(named_users(users, people), "user_id").where("is_self = 0")
    grouped = rows.groupBy("channel_id").agg(F.count("*").alias("others"), F.max("person_id").alias("person_id"))
    return grouped.select("channel_id", "others", F.when(F.col("others") == 1, F.col("person_id")).alias("person_id"))


def person_groups(messages: DataFrame, participants: DataFrame, users: DataFrame, people: DataFrame) -> DataFrame:
    """A person's threads as one entry: threads, messages, last time, and the thread with most messages."""
    mine = counterparts(messages, participants, users, people).where("person_id IS NOT NULL").select("channel_id", "person_id")
    cards = rollup(messages).join(mine, "channel_id")
    return cards.groupBy("person_id").agg(F.count("*").alias("threads"), F.sum("messages").alias("messages"), F.max("last_ts").alias("last_ts"), F.max_by("channel_id", F.struct("messages", "channel_id")).alias("main_thread"))


def months(messages: DataFrame, users: DataFrame, people: DataFrame, group: list[str], where: Column | None = None) -> DataFrame:
    """Messages a month, the owner's and the others'; ``where`` restricts what is counted."""
    rows = messages.where(F.col("timestamp").isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.select("sender_id", *group, month(F.col("timestamp")).alias("month"))
    rows = rows.groupBy("sender_id", *group, "month").agg(F.count("*").alias("n"))
    who = named_users(users, people).select(F.col("user_id").alias("sender_id"), "is_self")
    mine = F.sum(F.when(F.col("is_self") == 1, F.col("n")).otherwise(0))
    return rows.join(who, "sender_id").groupBy(*group, "month").agg(F.sum("n").alias("messages"), mine.alias("mine"), (F.sum("n") - mine).alias("theirs"))


# --- pages


def latest_page(messages: DataFrame, limit: int = 150) -> DataFrame:
    """Every thread's newest ``limit`` messages. Thread pages need no sort of the whole table: rows are ranked by thread."""
    w = W.partitionBy("channel_id").orderBy(F.desc("timestamp"), F.desc("row_id"))
    return messages.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def page(messages: DataFrame, channel_id: int, before: tuple[int, int] | None = None, after: tuple[int, int] | None = None, limit: int = 150, strict_ms: bool = False) -> DataFrame:
    """A page of one thread in time order, by the cursor (timestamp, row_id); ``strict_ms`` compares times only, and so
    skips messages of the cursor's millisecond."""
    rows = messages.where(F.col("channel_id") == channel_id)
    if after is not None:
        t, r = after
        ok = F.col("timestamp") > t if strict_ms else (F.col("timestamp") > t) | ((F.col("timestamp") == t) & (F.col("row_id") > r))
        return rows.where(ok).orderBy("timestamp", "row_id").limit(limit)
    if before is not None:
        t, r = before
        ok = F.col("timestamp") < t if strict_ms else (F.col("timestamp") < t) | ((F.col("timestamp") == t) & (F.col("row_id") < r))
        rows = rows.where(ok)
    return rows.orderBy(F.desc("timestamp"), F.desc("row_id")).limit(limit).orderBy("timestamp", "row_id")


def around(messages: DataFrame, channel_id: int, row_id: int, limit: int = 150) -> DataFrame:
    """A page centred on a message: half older, half from it on."""
    rows = messages.where(F.col("channel_id") == channel_id)
    anchor = rows.where(F.col("row_id") == row_id).select("timestamp", "row_id").first()
    if anchor is None:
        raise KeyError(row_id)
    t, r = anchor
    later = (F.col("timestamp") > t) | ((F.col("timestamp") == t) & (F.col("row_id") >= r))
    older = rows.where(~later).orderBy(F.desc("timestamp"), F.desc("row_id")).limit(limit // 2)
    return older.unionByName(rows.where(later).orderBy("timestamp", "row_id").limit(limit // 2)).orderBy("timestamp", "row_id")


def runs(messages: DataFrame, gap_ms: int = 300_000, zone: str = "UTC") -> DataFrame:
    """row_id with new_day and grouped: whether a message follows one of the same sender on the same day within the gap."""
    rows = messages.where("timestamp IS NOT NULL").withColumn("day", day(F.col("timestamp"), zone))
    w = W.partitionBy("channel_id", "day").orderBy("timestamp", "row_id")
    before = F.lag("timestamp").over(w)
    same = F.lag("sender_id").over(w).eqNullSafe(F.col("sender_id")) & (F.col("timestamp") - before < gap_ms)
    return rows.select("channel_id", "row_id", before.isNull().cast("int").alias("new_day"), F.coalesce(before.isNotNull() & same, F.lit(False)).cast("int").alias("grouped"))


def decorated(page_rows: DataFrame, messages: DataFrame, replies: DataFrame, users: DataFrame, people: DataFrame) -> DataFrame:
    """Messages with author, self flag and what they reply to (null where the target is absent)."""
    who = named_users(users, people).select(F.col("user_id").alias("sender_id"), "display", "is_self")
    target = messages.groupBy(F.col("message_id").alias("replied_to_id")).agg(F.min_by("text", F.struct("timestamp", "row_id")).alias("reply_text"))
    rows = page_rows.join(who, "sender_id", "left").join(replies, "message_id", "left").join(target, "replied_to_id", "left")
    return rows.select("row_id", "message_id", "channel_id", "sender_id", "display", "is_self", "timestamp", "text", "replied_to_id", preview(F.col("reply_text")).alias("reply_preview"))


def adorned(rows: DataFrame, message_attachments: DataFrame, attachments: DataFrame, reactions: DataFrame, actors: DataFrame, embeds: DataFrame, users: DataFrame, people: DataFrame) -> DataFrame:
    """Messages with arrays of their attachments (by name), reactions (most first, with the names of who reacted) and
    embeds. The page is joined first, so each table gives its rows of the page only."""
    page_ids = rows.select("message_id").distinct()
    who = named_users(users, people).select("user_id", "display")
    files = message_attachments.join(page_ids, "message_id", "left_semi").join(attachments, "attachment_id")
    files = files.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("name", "attachment_id", "type", "size", "width", "height", "sha256", "local_path"))).alias("attachments"))
    names = actors.join(page_ids, "message_id", "left_semi").join(who, "user_id", "left").groupBy("message_id", "emoji_name").agg(F.array_sort(F.collect_list("display")).alias("who"))
    marks = reactions.join(page_ids, "message_id", "left_semi").join(names, ["message_id", "emoji_name"], "left")
    marks = marks.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "emoji_name", "count", "who"))).alias("reactions"))
    marks = marks.withColumn("reactions", F.transform("reactions", lambda x: x.dropFields("order")))
    cards = embeds.join(page_ids, "message_id", "left_semi").groupBy("message_id").agg(F.array_sort(F.collect_list("json")).alias("embeds"))
    return rows.join(files, "message_id", "left").join(marks, "message_id", "left").join(cards, "message_id", "left")
