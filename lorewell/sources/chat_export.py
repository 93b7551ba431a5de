"""Work-chat exports: one index (messages.json) of conversations, in a folder or an uncompressed tar, with media beside it."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import EMOJI
from lorewell.operators.shapes import parsed

# Message types of the format.
MEDIA_TYPES = ("RichText/UriObject", "RichText/Media_Video", "RichText/Media_GenericFile", "RichText/Media_AudioMsg", "RichText/Media_FlikMsg", "RichText/Media_Album")
SKIPPED_PREFIXES = ("ThreadActivity/", "Event/")
SKIPPED_TYPES = ("Poll", "Translation")
CALL_LOG = r"^Call Logs for Call [0-9a-fA-F-]{36}$"
NOT_TYPED = ("quote", "legacyquote", "context", "uriobject", "swift")
LINE_TAGS = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr")


def _member(name: str) -> Column:
    return F.call_function("try_variant_get", parsed(F.col("message")), F.lit(f"$.{name}"), F.lit("string"))


def importable(records: DataFrame) -> DataFrame:
    """Records that people wrote: no polls, translations, joins, renames, calls or call logs."""
    rows = records.withColumn("_kind", F.coalesce(_member("messagetype"), F.lit(""))).withColumn("_content", F.coalesce(_member("content"), F.lit("")))
    skip = F.col("_kind").isin(*SKIPPED_TYPES) | F.col("_content").rlike(CALL_LOG)
    for prefix in SKIPPED_PREFIXES:
        skip = skip | F.col("_kind").startswith(prefix)
    return rows.where(~skip).drop("_kind", "_content")


class _Prose(HTMLParser):
    """Collects what was typed: skips scaffolding subtrees, breaks lines at block tags, draws emoticons."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        reply = tag == "blockquote" and "Reply" in (a.get("itemtype") or "")
        if tag == "ss":
            self.out.append(a.get("alt") or EMOJI.get((a.get("type") or "").lower(), ""))
            self.skip.append(tag)
        elif tag in NOT_TYPED or reply:
            self.skip.append(tag)
        elif tag == "img":
            if (alt := a.get("alt")) and not re.search("[A-Za-z]", alt):
                self.out.append(alt)
        elif tag == "at":
            self.out.append("@")
        elif tag in LINE_TAGS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in LINE_TAGS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def reduced(content: str | None, kind: str | None = None) -> str:
    """A message's content as prose."""
    if not content or kind in MEDIA_TYPES:
        return ""
    if kind == "RichText/Contacts":
        names = [html.unescape(x) for x in re.findall(r'<c\b[^>]*\bf="([^"]*)"', content)]
        return f"Shared contact: {', '.join(names)}" if names else "Shared a contact"
    if kind == "RichText/Location":
        found = re.search(r'\baddress="([^"]+)"', content) or re.search(r'\bshortAddress="([^"]+)"', content)
        return html.unescape(found.group(1)) if found else "Shared a location"
    if "<" in content or "&" in content:
        parser = _Prose()
        parser.feed(content)
        parser.close()
        content = "".join(parser.out)
    content = re.sub(r"[ \t]+", " ", content.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in content.split("\n"))).strip()


def prose(records: DataFrame) -> DataFrame:
    """(rec_id, text) of records whose content is text."""

    @F.pandas_udf("string")
    def apply(content: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([reduced(c, k) for c, k in zip(content, kind)])

    rows = records.select("rec_id", _member("content").alias("content"), _member("messagetype").alias("kind"))
    return rows.select("rec_id", apply("content", "kind").alias("text"))


# --- reading and staging an export


def read_records(spark, source) -> DataFrame:
    """(conversation, conversation_ordinal, ordinal, message) of an export: a folder or a tar, read alike. Members are VARIANT."""
    from lorewell.sources.detect import INDEX
    from lorewell.sources.readers import register

    register(spark)
    folder = source.path.is_dir()
    reader = spark.read.format("chat_index").option("path", str(source.path / INDEX if folder else source.path))
    rows = (reader if folder else reader.option("member", INDEX)).load()
    at = lambda v, p, t="variant": F.call_function("try_variant_get", v, F.lit(p), F.lit(t))
    whole = lambda c: F.coalesce(parsed(F.col(c)), F.when(F.col(c) != "null", F.raise_error(F.concat(F.lit("a record that can't be read: "), F.substring(c, 1, 200))).cast("string").cast("variant")))
    rows = rows.select("conversation_ordinal", whole("head").alias("c"), "ordinal", whole("message").alias("m"))
    return rows.where(at(F.col("c"), "$.id", "string").isNotNull() & F.col("m").isNotNull())


def stage(spark, source) -> dict[str, DataFrame]:
    """An export's rows by table."""
    from lorewell.functions.ids import chat_key, minted
    from lorewell.functions.text import account_mri, emoji_for, media_type, thread_kind
    from lorewell.functions.time import iso_ms
    from lorewell.operators.shapes import entries
    from lorewell.operators.writes import directory_vote
    from lorewell.session import written

    at = lambda v, p, t="string": F.call_function("try_variant_get", F.col(v) if isinstance(v, str) else v, F.lit(p), F.lit(t))
    raw = read_records(spark, source)
    kind, content = at("m", "$.messagetype"), at("m", "$.content")
    rows = raw.select(
        at("c", "$.id").alias("conversation"), "conversation_ordinal", "ordinal", "c", "m", F.coalesce(kind, F.lit("")).alias("kind"), content.alias("content"),
        at("m", "$.id").alias("chat_id"), at("m", "$.displayName").alias("name"),
        F.coalesce(account_mri(at("m", "$.from")), account_mri(at("m", "$.properties.importedBy.RawValue"))).alias("account"),
    )
    skip = F.col("kind").isin(*SKIPPED_TYPES) | F.coalesce(F.col("content").rlike(CALL_LOG), F.lit(False))
    for prefix in SKIPPED_PREFIXES:
        skip = skip | F.col("kind").startswith(prefix)
    rows = rows.where(~skip)

    @F.pandas_udf("string")
    def reduce_(contents: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([reduced(c, k) for c, k in zip(contents, kinds)])

    deleted = at("m", "$.properties.deletetime").isNotNull() | at("m", "$.properties.hardDeleteTime").isNotNull()
    refs = F.filter(F.transform(entries(at("m", "$.amsreferences", "variant")), lambda v: at(v, "$")), lambda r: r.isNotNull() & (r != ""))
    files = F.transform(entries(at("m", "$.properties.files", "variant")), lambda v: at(v, "$.fileName"))
    links = F.filter(F.transform(entries(at("m", "$.properties.urlpreviews", "variant")), lambda v: F.struct(
        F.lit("share").alias("type"), F.coalesce(at(v, "$.value.target_url"), at(v, "$.value.url")).alias("url"), F.coalesce(at(v, "$.value.title"), F.lit("")).alias("title"), F.coalesce(at(v, "$.value.description"), F.lit("")).alias("description"))), lambda e: e["url"].isNotNull())
    quoted = F.get(F.filter(F.transform(entries(at("m", "$.properties.qtdMsgs", "variant")), lambda v: at(v, "$.messageId")), lambda x: x.isNotNull()), F.lit(0))
    marked = F.coalesce(F.nullif(F.regexp_extract("content", r'<quote\b[^>]*\bmessageid="([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract("content", r'<blockquote\b(?=[^>]*Reply)[^>]*\bitemid="([^"]+)"', 1), F.lit("")))
    rows = rows.withColumn("deleted", deleted).withColumn("text", F.when(F.col("deleted"), "").otherwise(reduce_("content", "kind")))
    rows = rows.withColumn("refs", refs).withColumn("files", files).withColumn("links", links).withColumn("reply", F.coalesce(quoted, marked))
    rows = rows.where(F.col("deleted") | (F.col("text") != "") | (F.size("refs") > 0) | (F.size(F.filter("files", lambda f: f.isNotNull())) > 0) | (F.size("links") > 0))

    # who an account is called: what it is called most often
    names = rows.select("account", F.when(~F.col("name").isin("", "Unknown User", "Export Owner"), F.col("name")).alias("name"), (F.col("conversation_ordinal") * F.lit(1 << 32) + F.col("ordinal")).alias("ordinal"))
    called = directory_vote(names).select("account", F.col("name").alias("called"))
    known = called.groupBy("called").agg(F.min("account").alias("named_account")).withColumnRenamed("called", "name")
    rows = rows.join(called, "account", "left").join(known, "name", "left")
    placeholder = F.coalesce(F.col("name"), F.lit("")).isin("", "Unknown User", "Export Owner")
    who = F.coalesce("account", F.when(~placeholder, F.coalesce("named_account", "name")), F.lit("unknown"))
    shown = F.coalesce("called", F.when(~placeholder, F.col("name")), F.regexp_replace(F.regexp_replace("account", r"^\d+:(live:)?\.?", ""), "^cid\\.", ""), F.lit("Unknown (Teams)"))
    platform = F.lit("teams")
    rows = rows.withColumn("who", who).withColumn("shown", shown).withColumn("sender_id", minted(platform, F.lit("user"), F.col("who")))
    rows = rows.withColumn("channel_id", minted(platform, F.col("conversation"))).withColumn("source_key", chat_key(F.col("conversation"), F.col("chat_id"))).withColumn("message_id", minted(F.col("source_key")))
    rows = written(rows, "records")  # all tables below are read from it: the index is parsed once

    reactions = rows.select("message_id", F.posexplode(entries(at("m", "$.properties.emotions", "variant"))).alias("e", "emotion"))
    reactions = reactions.select("message_id", "e", at("emotion", "$.key").alias("key"), F.explode(entries(at("emotion", "$.users", "variant"))).alias("u")).where(F.col("key") != "reactionsConsumptionHorizon")
    reactions = reactions.select("message_id", "e", emoji_for(F.col("key")).alias("emoji_name"), F.coalesce(at("u", "$.DisplayName"), F.lit("")).alias("name"))
    actors = reactions.where("name NOT IN ('', 'Unknown User')").join(known, "name", "left").withColumn("user_id", minted(platform, F.lit("user"), F.coalesce("named_account", "name")))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size("refs"), F.size("files")) - 1), lambda i: F.struct(F.get("refs", i).alias("doc"), F.get("files", i).alias("name")))
    parts = rows.where((F.size("refs") > 0) | (F.size("files") > 0)).select("message_id", "source_key", F.posexplode(pieces).alias("i", "p")).where("p.doc IS NOT NULL OR p.name IS NOT NULL")
    parts = parts.select("message_id", F.coalesce("p.doc", F.concat_ws("#", "source_key", "i")).alias("key"), F.coalesce("p.name", "p.doc").alias("name"), F.col("p.doc").alias("doc")).withColumn("attachment_id", minted(platform, F.lit("attachment"), F.col("key")))
    talks = rows.groupBy("channel_id", "conversation").agg(F.min_by(F.struct(at("c", "$.displayName").alias("title"), at("c", "$.threadProperties.topic").alias("topic"), at("c", "$.threadProperties.membercount", "int").alias("n")), "ordinal").alias("t"), F.countDistinct("sender_id").alias("senders"), F.array_join(F.array_sort(F.collect_set("shown")), ", ").alias("people"))
    title = F.coalesce(F.nullif(F.trim("t.title"), F.lit("")), F.nullif("people", F.lit("")), F.col("conversation"))
    size = F.greatest("senders", F.coalesce("t.n", F.lit(0)))
    users = rows.select(F.col("sender_id").alias("id"), F.col("who").alias("key"), F.col("shown").alias("display_name")).unionByName(actors.select(F.col("user_id").alias("id"), F.coalesce("named_account", "name").alias("key"), F.col("name").alias("display_name")))
    users = users.groupBy("id").agg(F.min(F.struct("display_name", "key")).alias("u"))
    target = rows.where("reply IS NOT NULL").select("message_id", minted(chat_key(F.col("conversation"), F.col("reply"))).alias("replied_to_id"))
    there = rows.select(F.col("message_id").alias("replied_to_id")).distinct()
    return {
        "servers": talks.select(F.col("channel_id").alias("id"), title.alias("name"), thread_kind(size).alias("type"), platform.alias("platform")),
        "channels": talks.select(F.col("channel_id").alias("id"), F.col("channel_id").alias("server"), title.alias("name"), F.coalesce("t.topic", "conversation").alias("topic"), platform.alias("platform")),
        "users": users.select("id", F.col("u.display_name").alias("name"), F.col("u.display_name").alias("display_name"), platform.alias("platform")),
        "channel_participants": rows.select("channel_id", F.col("sender_id").alias("user_id")).distinct(),
        "messages": rows.select("message_id", "sender_id", "channel_id", "text", iso_ms(at("m", "$.originalarrivaltime"), F.col("chat_id")).alias("timestamp"), platform.alias("platform"), "source_key", F.col("deleted").cast("int").alias("is_unsent"), F.col("conversation").alias("file"), "ordinal"),
        "attachments": parts.select("attachment_id", "name", media_type(F.col("name")).alias("type"), F.col("key").alias("normalized_url"), F.lit(0).alias("size"), platform.alias("platform")).dropDuplicates(["attachment_id"]),
        "message_attachments": parts.select("message_id", "attachment_id").distinct(),
        "message_embeds": rows.select("message_id", F.explode("links").alias("l")).select("message_id", F.to_json("l").alias("json")),
        "message_reactions": reactions.groupBy("message_id", "emoji_name").agg(F.count("*").alias("count")).withColumn("emoji_flags", F.lit(0)),
        "message_reaction_actors": actors.select("message_id", "user_id", "emoji_name").distinct(),
        "message_replied_to": target.join(there, "replied_to_id", "left_semi").dropDuplicates(["message_id"]),
        "message_edit_timestamps": rows.select("message_id", at("m", "$.properties.edittime", "bigint").alias("edit_timestamp")).where("edit_timestamp IS NOT NULL").dropDuplicates(["message_id"]),
    }
