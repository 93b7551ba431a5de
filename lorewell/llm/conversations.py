"""Conversations rebuilt from message rows: candidate reply links are scored, the likeliest parent wins, trees form.

Candidates of a message are the previous message of its channel, the latest message of each speaker it mentions and,
for each of its words, the latest message of another speaker with that word. A candidate's score falls with the time
between the two; it rises with a mention, with the rarity of a shared word, and with a change of speaker. Of two
candidates with the same mention or word the later one scores more, so no other message can win: the candidate set
loses nothing and needs no cap. A message whose best score is below ``ROOT_BELOW`` begins a new tree, so mentions and
shared words count until their score falls below that; the previous message counts however long ago it is.

Messages are worked on in slabs of ``SLAB_MS`` of a channel, so a channel that has a third of all rows is spread over
as many tasks as it has slabs. Slabs are summarised by word and speaker first, and windows over the slabs carry the
latest rows to the later slabs that have the word. A slab's task streams over its rows in time order and keeps only
the latest rows by word and speaker. Word frequencies are counted over all messages and hashed into a
table of fixed size.

Verdicts: ``broken`` if a row has a sender that is null or in no users row, or a timestamp that is null or outside
2020 to 2026; else ``empty`` if no row has content; else ``no replies`` if no link joins two speakers, which is so
exactly if all content has one sender. Defined results: null, blank, invisible and unsent text has no content; a null
is_unsent counts as 0; ties in time are ordered by row_id; rows with a null channel_id belong to no conversation;
repeated rows are turns like others unless ``first_only`` is set; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import expm1, log, log1p

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorewell.llm.graph import components
from lorewell.session import written

FIRST_MS, END_MS = 1_577_836_800_000, 1_798_761_600_000  # 2020-01-01 and 2027-01-01, UTC
SLAB_MS = 7 * 86_400_000
BUCKETS = 1 << 18
TIME, MENTION, WORD, TURN, ROOT_BELOW = 0.6, 3.0, 0.35, 1.0, -2.6

_VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]{2,}")
_SQL_SPLIT = r"[^\p{L}\p{M}\p{N}]+"


def has_content(text: Column, is_unsent: Column) -> Column:
    """Not unsent, and a visible character."""
    return (F.coalesce(is_unsent, F.lit(0)) == 0) & F.coalesce(text.rlike(_VISIBLE), F.lit(False))


def _impossible(ts: Column) -> Column:
    return ts.isNull() | (ts < FIRST_MS) | (ts >= END_MS)


def marked(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Messages with ``fault`` (what breaks their channel) and ``content``."""
    known = users.select(F.col("id").alias("sender_id"), F.lit(True).alias("known")).distinct()
    rows = messages.join(known, "sender_id", "left").where(F.col("channel_id").isNotNull())
    return rows.withColumn("fault", F.col("known").isNull() | _impossible(F.col("timestamp"))).withColumn("content", has_content(F.col("text"), F.col("is_unsent"))).drop("known")


def broken_channels(messages: DataFrame, users: DataFrame) -> DataFrame:
    """channel_id of the channels that a row breaks."""
    slim = messages.select("channel_id", "sender_id", "timestamp", F.lit(None).cast("string").alias("text"), F.lit(0).alias("is_unsent"))
    return marked(slim, users).where("fault").select("channel_id").distinct()


def word_counts(rows: DataFrame) -> np.ndarray:
    """In how many messages words occur, hashed into ``BUCKETS`` counts; the last place has the number of messages."""
    words = rows.select(F.explode(F.array_distinct(F.split(F.lower("text"), _SQL_SPLIT))).alias("w")).where(F.length("w") > 1)
    table = words.groupBy("w").agg(F.count("*").alias("n")).groupBy(F.crc32("w").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, dtype="float32")
    for b, n in table.collect():
        out[b] = n
    out[-1] = max(1.0, float(out[:-1].max()))
    return out


LINK = "channel_id bigint, row_id bigint, ts bigint, sender_id bigint, parent_row bigint, parent_ts bigint, parent_sender bigint, score double"


def links(rows: DataFrame, users: DataFrame, counts) -> DataFrame:
    """The best candidate parent of every content row (null for a channel's first). ``counts``: a broadcast of ``word_counts``.

    ``rows``: channel_id, row_id, sender_id, ts, text of content rows in channels that aren't broken.
    """
    names = users.select(F.col("id").alias("sender_id"), F.concat_ws(" ", "display_name", "name").alias("name")).dropDuplicates(["sender_id"])
    slab = F.floor(F.col("ts") / SLAB_MS).cast("bigint")
    rows = rows.join(names, "sender_id", "left").select("channel_id", "row_id", "sender_id", "ts", "text", "name", slab.alias("slab"))
    # what the previous slab with rows ended with
    ends = rows.groupBy("channel_id", "slab").agg(F.max(F.struct("ts", "row_id", "sender_id")).alias("end"))
    before = ends.select("channel_id", "slab", F.lag("end").over(W.partitionBy("channel_id").orderBy("slab")).alias("end")).where("end IS NOT NULL")
    before = before.select("channel_id", "slab", F.col("end.ts").alias("ts"), F.col("end.row_id").alias("row_id"), F.col("end.sender_id").alias("sender_id"), F.lit("").alias("text"), F.lit("").alias("name"), F.lit(0).alias("role"))
    everything = rows.withColumn("role", F.lit(2)).unionByName(_carried(rows, counts)).unionByName(before)
    placed = everything.repartition("channel_id", "slab").sortWithinPartitions("channel_id", "slab", "ts", "row_id", "role")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = _Scan(counts.value)
        for batch in batches:
            yield scan.take(batch)

    return placed.select("channel_id", "slab", "row_id", "sender_id", "ts", "text", "name", "role").mapInPandas(apply, LINK)


LATEST = "word string, first bigint, reach bigint, lt bigint, lr bigint, ls bigint, ot bigint, orow bigint, os bigint, st bigint, sr bigint, ss bigint"


def _carried(rows: DataFrame, counts) -> DataFrame:
    """Rows of earlier slabs that a slab's rows may answer, as rows of that slab with role 1: for each of the slab's
    words the latest row with it, the latest of another speaker than that, and the latest of a speaker of that name.
    Their text and name are the words they are carried for."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = _Scan(counts.value)
        for batch in batches:
            yield scan.summaries(batch)
        yield scan.summaries(None)

    placed = rows.repartition("channel_id", "slab").sortWithinPartitions("channel_id", "slab", "ts", "row_id")
    latest = placed.select("channel_id", "slab", "row_id", "sender_id", "ts", "text", "name").mapInPandas(summarise, f"channel_id bigint, slab bigint, {LATEST}")
    row = lambda t, r, s: F.when(F.col(t).isNotNull(), F.struct(F.col(t).alias("ts"), F.col(r).alias("row_id"), F.col(s).alias("sender_id")))
    latest = latest.select("channel_id", "slab", "word", "first", "reach", row("lt", "lr", "ls").alias("l"), row("ot", "orow", "os").alias("o"), row("st", "sr", "ss").alias("s"))
    earlier = W.partitionBy("channel_id", "word").orderBy("slab").rowsBetween(W.unboundedPreceding, -1)
    latest = latest.withColumn("was", F.last("l", ignorenulls=True).over(earlier)).withColumn("named", F.last("s", ignorenulls=True).over(earlier))
    # behind a slab, the latest of another speaker is the slab's own, or what was latest before, or stays
    other = F.when(F.col("o").isNotNull(), F.col("o")).when(F.col("was.sender_id") != F.col("l.sender_id"), F.col("was"))
    latest = latest.withColumn("turned", other).withColumn("other", F.last("turned", ignorenulls=True).over(earlier))
    offer = lambda c, reach, name: F.when(F.col("first") - F.col(f"{c}.ts") <= reach, F.struct(F.col(c).alias("row"), F.lit(name).alias("by_name")))
    offers = F.filter(F.array(offer("was", F.col("reach"), False), offer("other", F.col("reach"), False), offer("named", F.lit(_reach(MENTION)), True)), lambda x: x.isNotNull())
    offers = latest.select("channel_id", "slab", "word", F.explode(offers).alias("c")).select("channel_id", "slab", "word", "c.row.*", "c.by_name")
    words = lambda by_name: F.concat_ws(" ", F.collect_list(F.when(F.col("by_name") == by_name, F.col("word"))))
    return offers.groupBy("channel_id", "slab", "row_id", "ts", "sender_id").agg(words(False).alias("text"), words(True).alias("name")).withColumn("role", F.lit(1))


def _reach(gain: float) -> int:
    """Milliseconds after which a candidate with this gain scores below ``ROOT_BELOW``, and some more for rounding."""
    return int(expm1((TURN + gain - ROOT_BELOW) / TIME) * 60_000) + 1_000


class _Scan:
    """Streams over slabs in time order; keeps the latest row by word and by speaker's name."""

    def __init__(self, counts: np.ndarray):
        import zlib

        self.crc, self.counts, self.most = zlib.crc32, counts, float(counts[-1])
        self.rarity: dict[str, float] = {}
        self.slab = None

    def _rarity(self, word: str) -> float:
        x = self.rarity.get(word)
        if x is None:
            if len(self.rarity) > 60_000:
                self.rarity.clear()
            n = float(self.counts[self.crc(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)])
            x = self.rarity[word] = log((self.most + 1) / (n + 1))
        return x

    def _keep(self, own: tuple, words, name: str | None) -> None:
        # the latest row with a word, and the latest of another speaker than that one's
        for w in words:
            last = self.words.get(w)
            self.words[w] = (own,) if last is None else (own, last[0]) if last[0][2] != own[2] else (own, *last[1:])
        if name:
            for w in _TOKEN.findall(name.lower()):
                if len(w) > 2:
                    self.speakers[w] = own

    def summaries(self, batch: pd.DataFrame | None) -> pd.DataFrame:
        """What the slabs that have ended leave behind by word (``LATEST``); None: the last one has ended, too."""
        out: list[tuple] = []
        none = (None, None, None)
        rows = [] if batch is None else zip(*(batch[c].tolist() for c in batch.columns))

        def close() -> None:
            if self.slab is None:
                return
            end = (self.slab[1] + 1) * SLAB_MS
            for w in self.words.keys() | self.speakers.keys():
                reach = _reach(WORD * self._rarity(w))
                last, other, *_ = *(c if end - c[0] <= reach else none for c in self.words.get(w, ())), none, none
                speaker = self.speakers.get(w, none)
                first = self.first.get(w)
                if first is not None or speaker is not none:
                    out.append((*self.slab, w, end if first is None else first, reach, *last, *other, *speaker))

        for channel, slab, row, sender, ts, text, name in rows:
            if (channel, slab) != self.slab:
                close()
                self.slab, self.words, self.speakers, self.first = (channel, slab), {}, {}, {}
            words = set(_TOKEN.findall(text.lower())) if text else ()
            for w in words:
                self.first.setdefault(w, ts)
            self._keep((ts, row, sender), words, name)
        if batch is None:
            close()
        names = ["channel_id", "slab", *(x.split()[0] for x in LATEST.split(", "))]
        columns = list(zip(*out)) if out else [()] * len(names)
        return pd.DataFrame({n: pd.array(list(c), dtype="string" if n == "word" else "Int64") for n, c in zip(names, columns)})

    def take(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for channel, slab, row, sender, ts, text, name, role in zip(*(batch[c].tolist() for c in batch.columns)):
            if (channel, slab) != self.slab:
                self.slab = (channel, slab)
                self.words: dict[str, tuple] = {}
                self.speakers: dict[str, tuple] = {}
                self.previous = None
            own = (ts, row, sender)
            words = set(_TOKEN.findall(text.lower())) if text else ()
            if role == 2:
                best = None
                if (p := self.previous) is not None:
                    best = (self._time(ts - p[0]) + (TURN if p[2] != sender else 0.0), p)
                for w in words:
                    c = self.speakers.get(w)
                    if c is not None and c[2] != sender:
                        score = self._time(ts - c[0]) + TURN + MENTION
                        if score >= ROOT_BELOW and score > best[0]:
                            best = (score, c)
                    for c in self.words.get(w, ()):
                        if c[2] != sender:
                            score = self._time(ts - c[0]) + TURN + WORD * self._rarity(w)
                            if score >= ROOT_BELOW and score > best[0]:
                                best = (score, c)
                            break
                out.append((channel, row, ts, sender, *((best[1][1], best[1][0], best[1][2], best[0]) if best else (None, None, None, None))))
            self._keep(own, words, name)
            self.previous = own
        names = ["channel_id", "row_id", "ts", "sender_id", "parent_row", "parent_ts", "parent_sender", "score"]
        columns = list(zip(*out)) if out else [()] * len(names)
        # Int64 from the start: ids with gaps would lose digits as floats
        return pd.DataFrame({n: pd.array(list(c), dtype="Float64" if n == "score" else "Int64") for n, c in zip(names, columns)})

    @staticmethod
    def _time(gap: int) -> float:
        return -TIME * log1p(gap / 60_000)


def rebuild(messages: DataFrame, users: DataFrame, channels: DataFrame, counts=None) -> tuple[DataFrame, DataFrame]:
    """(links, verdicts). ``verdicts``: channel_id, verdict (null for a conversation) of every channel, with or without rows."""
    spark = messages.sparkSession
    rows = marked(messages.select("channel_id", "row_id", "sender_id", "timestamp", "text", "is_unsent"), users)
    state = rows.groupBy("channel_id").agg(F.max("fault").alias("broken"), F.max("content").alias("filled"))
    state = written(state, "channels")
    sound = state.where("NOT broken AND filled").select("channel_id")
    content = rows.where("content").join(sound, "channel_id", "left_semi").select("channel_id", "row_id", "sender_id", F.col("timestamp").alias("ts"), "text")
    if counts is None:
        counts = spark.sparkContext.broadcast(word_counts(messages.where(has_content(F.col("text"), F.col("is_unsent"))).select("text")))
    found = links(content, users, counts)
    replied = found.groupBy("channel_id").agg(F.max(F.coalesce(F.col("parent_sender") != F.col("sender_id"), F.lit(False))).alias("replied"))
    every = channels.select(F.col("id").alias("channel_id")).unionByName(state.select("channel_id")).distinct()
    verdict = F.when(F.col("broken"), "broken").when(~F.coalesce("filled", F.lit(False)), "empty").when(~F.coalesce("replied", F.lit(False)), "no replies")
    verdicts = every.join(state, "channel_id", "left").join(replied, "channel_id", "left").select("channel_id", verdict.alias("verdict"))
    return found, verdicts


def tree_roots(turns_: DataFrame) -> DataFrame:
    """(row_id, root): the first row of every row's tree. ``turns_``: channel_id, row_id, ts, parent_row.

    A slab's scan meets parents before children, so within a slab each row has its root at once. What is left are links
    from a slab's own roots to rows of earlier slabs: only these are connected, not all links."""
    slab = F.floor(F.col("ts") / SLAB_MS).cast("bigint")
    placed = turns_.select("channel_id", slab.alias("slab"), "ts", "row_id", F.coalesce("parent_row", "row_id").alias("parent")).repartition("channel_id", "slab").sortWithinPartitions("channel_id", "slab", "ts", "row_id")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known = None, {}
        for batch in batches:
            out = []
            for channel, own_slab, ts, row, parent in zip(*(batch[c].tolist() for c in batch.columns)):
                if (channel, own_slab) != at:
                    at, known = (channel, own_slab), {}
                root = known[row] = known.get(parent, (ts, row))
                out.append((row, *root, parent))
            yield pd.DataFrame(out, columns=["row_id", "root_ts", "root_row", "parent"])

    local = written(placed.mapInPandas(apply, "row_id bigint, root_ts bigint, root_row bigint, parent bigint"), "roots")
    # a row that is its slab's root, but has a parent elsewhere
    outward = local.where("row_id = root_row AND parent <> row_id").select(F.struct(F.col("root_ts").alias("ts"), F.col("root_row").alias("row_id")).alias("a"), F.col("parent").alias("p"))
    edges = outward.join(local.select(F.col("row_id").alias("p"), F.struct(F.col("root_ts").alias("ts"), F.col("root_row").alias("row_id")).alias("b")), "p").select("a", "b")
    joined = components(edges).select(F.col("node.row_id").alias("root_row"), F.col("root.row_id").alias("root"))
    return local.join(joined, "root_row", "left").select("row_id", F.coalesce("root", "root_row").alias("root"))


def turns(messages: DataFrame, users: DataFrame, people: DataFrame, channels: DataFrame, replies: DataFrame | None = None, first_only: bool = True) -> DataFrame:
    """The turns of all conversations: channel_id, conversation_row (the tree's first row), row_id, parent_row, role, ts.

    Explicit replies (message_id, replied_to_id) take the place of the guessed parent where their target is a turn.
    """
    if first_only:
        first = messages.groupBy("channel_id", "message_id").agg(F.min(F.struct("run_id", "row_id")).alias("f")).select(F.col("f.row_id").alias("row_id"))
        messages = messages.join(first, "row_id", "left_semi")
    found, verdicts = rebuild(messages, users, channels)
    found = written(found, "links")
    kept = found.join(verdicts.where("verdict IS NULL").select("channel_id"), "channel_id", "left_semi")
    parent = F.when(F.col("score") >= ROOT_BELOW, F.col("parent_row"))
    kept = kept.select("channel_id", "row_id", "ts", "sender_id", parent.alias("parent_row"), F.when(parent.isNotNull(), F.col("parent_ts")).alias("parent_ts"))
    if replies is not None:
        ids = messages.select("message_id", "row_id").join(kept.select("row_id", "ts", "channel_id"), "row_id")
        told = ids.join(replies, "message_id").select("row_id", F.col("replied_to_id").alias("target"), "channel_id", "ts")
        target = ids.groupBy(F.col("message_id").alias("target"), "channel_id").agg(F.min(F.struct(F.col("ts").alias("t"), F.col("row_id").alias("r"))).alias("p"))
        told = told.join(target, ["target", "channel_id"]).where("p.t <= ts AND p.r <> row_id").groupBy("row_id").agg(F.max("p").alias("p"))
        kept = kept.join(told, "row_id", "left").withColumn("parent_ts", F.coalesce("p.t", "parent_ts")).withColumn("parent_row", F.coalesce("p.r", "parent_row")).drop("p")
    kept = written(kept, "turns")
    roots = tree_roots(kept)
    owner = users.select(F.col("id").alias("sender_id"), "person_id").join(people.where("is_self = 1").select("person_id"), "person_id", "left_semi").select("sender_id", F.lit(True).alias("own"))
    out = kept.join(roots, "row_id", "left").join(owner, "sender_id", "left")
    return out.select("channel_id", F.coalesce("root", "row_id").alias("conversation_row"), "row_id", "parent_row", F.when(F.col("own"), "owner").otherwise("other").alias("role"), "ts")
