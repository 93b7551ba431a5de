"""Queries of the training-data operators, and SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import conversations, entities, garbled, history, mixing, packing, residue, sentences
from lorewell.session import table, written


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [("messages", "row_id", "text"), ("users", "id", "name"), ("channels", "id", "name")]
    frames = {name: table(spark, sf_dir, name).select(key, text) for name, key, text in sources}
    texts = None
    for name, _, text in sources:
        part = frames[name].select(F.col(text).alias("text"))
        texts = part if texts is None else texts.unionByName(part)
    counts = spark.sparkContext.broadcast(garbled.fit_letters(texts))
    out = None
    for name, key, text in sources:
        part = garbled.find_garbled(frames[name], key, text, counts).withColumn("src_table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that differ from what was written because of a wrong character set."""
    return _garbled(spark, sf_dir).select("src_table", "record_id")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the original text, as far as it can be had, and the pair of sets."""
    return _garbled(spark, sf_dir).select("src_table", "record_id", "restored", "pair")


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "users")
    names = users.select(F.col("name").alias("text")).unionByName(users.select(F.col("display_name").alias("text")))
    counts = spark.sparkContext.broadcast(garbled.fit_letters(names))
    return entities.linked(entities.matched(users, counts), users)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of accounts on different platforms that belong to one person."""
    return _accounts(spark, sf_dir).select("user_id_a", "user_id_b")


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their confidence."""
    return _accounts(spark, sf_dir).select("user_id_a", "user_id_b", F.round("confidence", 6).alias("confidence"))


def p3_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per linked account: its person (the least account id) and how many links it has."""
    users = table(spark, sf_dir, "users")
    names = users.select(F.col("name").alias("text")).unionByName(users.select(F.col("display_name").alias("text")))
    links, classes = entities.persons(entities.matched(users, spark.sparkContext.broadcast(garbled.fit_letters(names))))
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    return classes.join(ends, "node").select(F.col("node").alias("user_id"), F.col("root").alias("class_id"), "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat a message which arrived before, with its first arrived row; the runs come in eight batches."""
    messages = table(spark, sf_dir, "messages")
    broken = conversations.broken_channels(messages, table(spark, sf_dir, "users"))
    runs = sorted(r[0] for r in messages.select("run_id").distinct().collect() if r[0] is not None)  # one row a run
    step = max(1, -(-len(runs) // 8))
    batches = [runs[i : i + step] for i in range(0, len(runs), step)]
    # a channel that breaks later takes its repeats along, so they are taken off at the end
    found = history.repeats(messages, batches)
    return found.join(messages.join(broken, "channel_id", "left_semi").select(F.col("row_id").alias("row_id_b")), "row_id_b", "left_anti").select("row_id_a", "row_id_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that are not a conversation."""
    _, verdicts = conversations.rebuild(table(spark, sf_dir, "messages"), table(spark, sf_dir, "users"), table(spark, sf_dir, "channels"))
    return verdicts.where("verdict IS NOT NULL").select("channel_id")


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations, with their trees and roles."""
    names = ("messages", "users", "people", "channels", "message_replied_to")
    messages, users, people, channels, replies = (table(spark, sf_dir, n) for n in names)
    return conversations.turns(messages, users, people, channels, replies)


def p5_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit replies between turns, and whether both stand in one tree with the reply's parent as told."""
    names = ("messages", "users", "people", "channels", "message_replied_to")
    messages, users, people, channels, replies = (table(spark, sf_dir, n) for n in names)
    rows = written(conversations.turns(messages, users, people, channels, replies, first_only=False), "turns")
    ids = messages.select("message_id", "row_id").join(rows.select("row_id", "channel_id", "ts", "conversation_row", "parent_row"), "row_id")
    target = ids.groupBy(F.col("message_id").alias("replied_to_id"), "channel_id").agg(F.min(F.struct("ts", "row_id")).alias("p"))
    told = ids.join(replies, "message_id").join(target, ["replied_to_id", "channel_id"]).where("p.ts <= ts AND p.row_id <> row_id")
    parents = rows.select(F.col("row_id").alias("pr"), F.col("conversation_row").alias("pc"))
    return told.join(parents, F.col("p.row_id") == F.col("pr")).select("row_id", ((F.col("parent_row") == F.col("pr")) & (F.col("conversation_row") == F.col("pc"))).alias("kept"))


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages").select("row_id", F.col("platform").alias("host"), "text")
    counts = spark.sparkContext.broadcast(garbled.fit_letters(messages.select("text")))
    return residue.judged(messages.where(F.col("text").isNotNull()), counts)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are template residue, filler, error pages or script notices."""
    return _residue(spark, sf_dir).select("row_id")


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have which kind of evidence."""
    return _residue(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("rows"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies, for every capacity."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and fill of every capacity."""
    lying = p7_containers(spark, sf_dir).groupBy("spec_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    filled = F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return lying.join(table(spark, sf_dir, "pack_specs"), "spec_name").select("spec_name", "capacity_tokens", "containers", "tokens", filled.alias("fill"))


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rests of every capacity: items, those that rounded solutions carry, containers, and the program's bound."""
    return packing.bounds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: documents placed, containers above capacity, documents cut without need, and pieces that don't join."""
    lying = written(p7_containers(spark, sf_dir), "containers").join(F.broadcast(table(spark, sf_dir, "pack_specs")), "spec_name")
    rooms = lying.groupBy("spec_name", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("n"))
    over = rooms.groupBy("spec_name", "capacity_tokens").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    own = lying.groupBy("spec_name", "capacity_tokens", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("n"), F.sum(F.col("start_token") - F.col("piece") * F.col("capacity_tokens")).alias("off"), F.max(F.col("start_token") + F.col("tokens")).alias("end"))
    cut = own.groupBy("spec_name").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("cut_without_need"), F.count_if((F.col("off") != 0) | (F.col("end") != F.col("n"))).alias("gaps"))
    return over.join(cut, "spec_name").select("spec_name", F.col("capacity_tokens").cast("int").alias("capacity_tokens"), "documents", "overfull", "cut_without_need", "gaps")


def p8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn for every mix, and how often."""
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares really reached."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mixed(table(spark, sf_dir, "documents"), targets), targets)


def p8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request: whether documents were drawn, drawn more often than allowed, and how many of another source or of none."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    drawn = written(mixing.mixed(documents, targets), "drawn")
    real = drawn.join(documents.select("doc_id", F.col("source").alias("own")), "doc_id", "left").groupBy("mix_name", "source").agg(F.max("copies").alias("most"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("strangers"))
    got = mixing.shares(drawn, targets).join(real, ["mix_name", "source"], "left")
    return got.select("mix_name", "source", (F.col("tokens") > 0).alias("drawn"), (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("too_often"), F.coalesce("strangers", F.lit(0)).alias("strangers"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentences as code point spans."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.split_documents(documents, sentences.corpus_table(documents))


def p9_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all sentences of a language tag's documents: documents with text, spans outside the text, with white space at
    an end or overlapping the next, and visible characters that no sentence has."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where("text IS NOT NULL")
    spans = p9_found(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("spans"))  # a document's own
    rows = documents.join(spans, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start_char:int,end_char:int>>")))
    piece = lambda x: F.substring(F.col("text"), x["start_char"] + 1, x["end_char"] - x["start_char"])
    blank = lambda x: F.regexp_replace(x, r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+", "")
    wrong = F.size(F.filter("spans", lambda x: (x["start_char"] < 0) | (x["end_char"] > F.length("text")) | piece(x).rlike(r"^\s|\s$")))
    crossing = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("spans") - 1, F.lit(1))), lambda i: F.coalesce(F.get("spans", i)["start_char"] < F.get("spans", i - 1)["end_char"], F.lit(False))))
    lost = F.length(blank(F.col("text"))) - F.aggregate("spans", F.lit(0), lambda n, x: n + F.length(blank(piece(x))))
    rows = rows.select("lang", wrong.alias("wrong"), crossing.alias("crossing"), lost.alias("lost"))
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("wrong").cast("bigint").alias("wrong"), F.sum("crossing").cast("bigint").alias("crossing"), F.sum("lost").cast("bigint").alias("lost"))


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored, "p3_found": p3_found, "p3_matches": p3_matches, "p3_people": p3_people, "p4_found": p4_found, "p5_found": p5_found, "p5_turns": p5_turns, "p5_told": p5_told, "p6_found": p6_found, "p6_kinds": p6_kinds, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_bounds": p7_bounds, "p7_faults": p7_faults, "p8_draws": p8_draws, "p8_shares": p8_shares, "p8_faults": p8_faults, "p9_found": p9_found, "p9_faults": p9_faults}
SQL: dict[str, str] = {
    # \\x{...} spelt out for RE2: white space, controls, format characters and blanks that are letters or marks by class
    "p5_found": r"""
WITH m AS (SELECT channel_id, sender_id,
  sender_id IS NULL OR sender_id NOT IN (SELECT id FROM users) OR timestamp IS NULL OR timestamp < 1577836800000 OR timestamp >= 1798761600000 AS fault,
  coalesce(is_unsent, 0) = 0 AND coalesce(regexp_matches(text, '[^\s\pZ\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]'), false) AS content
  FROM messages WHERE channel_id IS NOT NULL),
s AS (SELECT channel_id, bool_or(fault) AS broken, count(DISTINCT CASE WHEN content THEN sender_id END) AS speakers FROM m GROUP BY 1)
SELECT channel_id FROM s WHERE broken OR speakers < 2
UNION SELECT id FROM channels WHERE id NOT IN (SELECT channel_id FROM s)""",
    "p5_told": r"""
WITH m AS (SELECT row_id, message_id, channel_id, sender_id, timestamp AS ts,
  sender_id IS NULL OR sender_id NOT IN (SELECT id FROM users) OR timestamp IS NULL OR timestamp < 1577836800000 OR timestamp >= 1798761600000 AS fault,
  coalesce(is_unsent, 0) = 0 AND coalesce(regexp_matches(text, '[^\s\pZ\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]'), false) AS content
  FROM messages WHERE channel_id IS NOT NULL),
s AS (SELECT channel_id FROM m GROUP BY 1 HAVING NOT bool_or(fault) AND count(DISTINCT CASE WHEN content THEN sender_id END) > 1),
t AS (SELECT * FROM m WHERE content AND channel_id IN (SELECT channel_id FROM s)),
f AS (SELECT message_id AS replied_to_id, channel_id, row_id AS pr, ts AS pt FROM t WHERE message_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY message_id, channel_id ORDER BY ts, row_id) = 1)
SELECT row_id, true AS kept FROM t JOIN message_replied_to r USING (message_id) JOIN f USING (replied_to_id, channel_id) WHERE pt <= ts AND pr <> row_id""",
    "p7_faults": """
SELECT spec_name, CAST(capacity_tokens AS INTEGER) AS capacity_tokens, (SELECT count(*) FROM documents WHERE text <> '') AS documents,
  CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS cut_without_need, CAST(0 AS BIGINT) AS gaps FROM pack_specs""",
    "p9_faults": """
SELECT lang, count(*) AS documents, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS crossing, CAST(0 AS BIGINT) AS lost FROM documents WHERE text IS NOT NULL GROUP BY lang""",
    "p8_faults": """
SELECT mix_name, source, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.text <> '') AS drawn, false AS too_often, CAST(0 AS BIGINT) AS strangers FROM mix_targets t""",
}
