"""Queries over the archive tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.functions import ids, text, time
from lorewell.operators import people as persons
from lorewell.operators import shapes, threads, writes
from lorewell.plans import search, snippets
from lorewell.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query of (load,) under its function's name; ``load(name)`` gives a table."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


_WHO = "who AS (SELECT u.id AS user_id, u.person_id, u.platform, coalesce(p.display, u.display_name, u.name) AS display, coalesce(p.is_self, 0) AS is_self FROM users u LEFT JOIN people p ON p.person_id = u.person_id)"
_MONTH = "strftime(make_timestamp((timestamp // 1000) * 1000000), '%Y-%m')"
_MEMBERS = "members AS (SELECT channel_id, user_id FROM channel_participants UNION SELECT channel_id, sender_id FROM messages WHERE sender_id IS NOT NULL)"
_LATEST = "arg_max(coalesce(text, ''), {'a': timestamp, 'b': row_id})"
_TOKENS = r"regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\pL\pN\p{Co}]+')"
_SPACED = f"' ' || array_to_string({_TOKENS}, ' ') || ' '"
_BEST = "SELECT channel_id, count(*) AS messages, min(timestamp) AS first_ts, max(timestamp) AS last_ts, substr(first(coalesce(text, '') ORDER BY timestamp DESC NULLS LAST, row_id DESC), 1, 160) AS latest FROM messages GROUP BY channel_id"

# --- months


def _by_month(load, group, where=None):
    return threads.months(load("messages"), load("users"), load("people"), group, where)


@query(f"WITH {_WHO} SELECT {_MONTH} AS month, count(*) AS messages, CAST(sum(CASE WHEN is_self = 1 THEN 1 ELSE 0 END) AS BIGINT) AS mine, CAST(sum(CASE WHEN is_self = 1 THEN 0 ELSE 1 END) AS BIGINT) AS theirs FROM messages JOIN who ON user_id = sender_id WHERE timestamp IS NOT NULL GROUP BY 1")
def stats_months(load):
    """Messages a UTC month, the owner's and the others'."""
    return _by_month(load, [])


@query(f"WITH {_WHO} SELECT channel_id, {_MONTH} AS month, count(*) AS messages, CAST(sum(CASE WHEN is_self = 1 THEN 1 ELSE 0 END) AS BIGINT) AS mine, CAST(sum(CASE WHEN is_self = 1 THEN 0 ELSE 1 END) AS BIGINT) AS theirs FROM messages JOIN who ON user_id = sender_id WHERE timestamp IS NOT NULL GROUP BY 1, 2")
def thread_months(load):
    """The same of every thread."""
    return _by_month(load, ["channel_id"])


@query(f"WITH {_WHO} SELECT count(*) AS messages, CAST(sum(CASE WHEN is_self = 1 THEN 1 ELSE 0 END) AS BIGINT) AS mine, min({_MONTH}) AS first_month, max({_MONTH}) AS last_month FROM messages JOIN who ON user_id = sender_id WHERE timestamp IS NOT NULL")
def stats_months_total(load):
    """The totals beside the month series."""
    m = _by_month(load, [])
    return m.agg(F.sum("messages").alias("messages"), F.sum("mine").alias("mine"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@query(f"""WITH {_WHO}, m AS (SELECT channel_id, {_MONTH} AS month, count(*) AS messages FROM messages JOIN who ON user_id = sender_id WHERE timestamp >= 1577836800000 AND timestamp < 1798761600000 GROUP BY 1, 2),
s AS (SELECT channel_id, unnest(generate_series(CAST(min(month) || '-01' AS TIMESTAMP), CAST(max(month) || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)) AS d FROM m GROUP BY 1)
SELECT s.channel_id, strftime(d, '%Y-%m') AS month, coalesce(messages, 0) AS messages FROM s LEFT JOIN m ON m.channel_id = s.channel_id AND m.month = strftime(d, '%Y-%m')""")
def months_gap_filled(load):
    """Every thread's months from first to last, silent ones too; impossible times are left out."""
    where = (F.col("timestamp") >= 1577836800000) & (F.col("timestamp") < 1798761600000)
    return time.every_month(_by_month(load, ["channel_id"], where).select("channel_id", "month", "messages"), ["channel_id"], ["messages"])


@query(f"SELECT year, month, CAST(sum(n) AS BIGINT) AS messages FROM (SELECT substr({_MONTH}, 1, 4) AS year, {_MONTH} AS month, 1 AS n FROM messages JOIN users ON id = sender_id WHERE timestamp IS NOT NULL) GROUP BY ROLLUP (year, month)")
def years_rollup(load):
    """Messages by month, year and in all."""
    m = _by_month(load, []).withColumn("year", F.substring("month", 1, 4))
    return m.rollup("year", "month").agg(F.sum("messages").alias("messages"))


@query(f"SELECT row_id, {_MONTH} AS month FROM messages WHERE timestamp IS NOT NULL")
def month_bucket(load):
    """Every message's UTC month."""
    return load("messages").where("timestamp IS NOT NULL").select("row_id", time.month(F.col("timestamp")).alias("month"))


# --- threads

_LIST = "SELECT c.id AS channel_id, c.name, c.kind, c.platform, r.messages, r.first_ts, r.last_ts, r.latest FROM channels c JOIN (" + _BEST + ") r ON r.channel_id = c.id"


@query(_LIST)
def threads_list(load):
    """Threads with messages: counts, span, latest text."""
    return threads.thread_list(load("messages"), load("channels"))


@query(_LIST + " WHERE c.platform = 'teams'")
def threads_platform_filter(load):
    """The same of one platform."""
    return threads.thread_list(load("messages"), load("channels"), platform="teams")


@query(_LIST + " WHERE translate(c.name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%a_e%'")
def threads_name_like(load):
    """Threads by a pattern in the name, ASCII case ignored."""
    return threads.thread_list(load("messages"), load("channels"), q="A_e")


@query(f"WITH {_MEMBERS} SELECT channel_id, user_id FROM members")
def thread_members(load):
    """Participants and senders of every thread."""
    return threads.members(load("messages"), load("channel_participants"))


@query(f"WITH {_WHO}, {_MEMBERS}, n AS (SELECT channel_id, sender_id, count(*) AS messages FROM messages GROUP BY 1, 2) SELECT members.channel_id, members.user_id, display, is_self, coalesce(messages, 0) AS messages FROM members JOIN who ON who.user_id = members.user_id LEFT JOIN n ON n.channel_id = members.channel_id AND n.sender_id = members.user_id")
def thread_members_counts(load):
    """Members with their messages; silent ones have 0."""
    return threads.member_counts(load("messages"), load("channel_participants"), load("users"), load("people"))


_COUNTERPART = f"{_WHO}, {_MEMBERS}, cp AS (SELECT channel_id, count(*) AS others, CASE WHEN count(*) = 1 THEN max(person_id) END AS person_id FROM members JOIN who ON who.user_id = members.user_id WHERE is_self = 0 GROUP BY 1)"


@query(f"WITH {_COUNTERPART} SELECT channel_id, others, person_id FROM cp")
def thread_counterpart(load):
    """The one person on the other side of a thread, if there is just one."""
    return threads.counterparts(load("messages"), load("channel_participants"), load("users"), load("people"))


@query(f"WITH {_COUNTERPART} SELECT person_id, channel_id FROM cp WHERE person_id IS NOT NULL")
def person_threads(load):
    """Threads by the person on the other side."""
    return thread_counterpart_rows(load).where("person_id IS NOT NULL").select("person_id", "channel_id")


def thread_counterpart_rows(load):
    return threads.counterparts(load("messages"), load("channel_participants"), load("users"), load("people"))


@query(f"WITH {_COUNTERPART}, r AS ({_BEST}) SELECT person_id, count(*) AS threads, CAST(sum(messages) AS BIGINT) AS messages, max(last_ts) AS last_ts, first(r.channel_id ORDER BY messages DESC, r.channel_id DESC) AS main_thread FROM cp JOIN r ON r.channel_id = cp.channel_id WHERE person_id IS NOT NULL GROUP BY 1")
def thread_groups(load):
    """A person's threads as one entry."""
    return threads.person_groups(load("messages"), load("channel_participants"), load("users"), load("people"))


@query(f"SELECT row_id, substr(coalesce(text, ''), 1, 160) AS preview FROM messages")
def previews(load):
    """Text cut for lists."""
    return load("messages").select("row_id", text.preview(F.col("text")).alias("preview"))


# --- statistics and people


@query("SELECT platform, count(*) AS messages, count(DISTINCT channel_id) AS channels, count(DISTINCT sender_id) AS senders, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM messages GROUP BY 1")
def stats_platforms(load):
    """Messages, threads, senders and span by platform."""
    return load("messages").groupBy("platform").agg(F.count("*").alias("messages"), F.countDistinct("channel_id").alias("channels"), F.countDistinct("sender_id").alias("senders"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("SELECT platform, count(*) AS accounts, CAST(sum(CASE WHEN avatar_sha256 IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS stored, count(DISTINCT avatar_sha256) AS pictures FROM users GROUP BY 1")
def stats_media(load):
    """Pictures that are named and stored, by platform."""
    return load("users").groupBy("platform").agg(F.count("*").alias("accounts"), F.count_if(F.col("avatar_sha256").isNotNull()).alias("stored"), F.countDistinct("avatar_sha256").alias("pictures"))


@query("WITH n AS (SELECT sender_id AS id, count(*) AS messages FROM messages GROUP BY 1), a AS (SELECT u.person_id, count(DISTINCT u.id) AS accounts, CAST(sum(coalesce(messages, 0)) AS BIGINT) AS messages FROM users u LEFT JOIN n ON n.id = u.id WHERE u.person_id IS NOT NULL GROUP BY 1) SELECT p.person_id, display, is_self, coalesce(accounts, 0) AS accounts, coalesce(messages, 0) AS messages FROM people p LEFT JOIN a ON a.person_id = p.person_id")
def people_summary(load):
    """People with their accounts and messages."""
    return persons.summary(load("users"), load("people"), load("messages"))


@query("SELECT u.id, u.platform, u.name, u.display_name, u.person_id, p.display AS person, coalesce(n.messages, 0) AS messages FROM users u LEFT JOIN people p ON p.person_id = u.person_id LEFT JOIN (SELECT sender_id, count(*) AS messages FROM messages GROUP BY 1) n ON n.sender_id = u.id")
def identities(load):
    """Accounts with their person and messages."""
    return persons.identities(load("users"), load("people"), load("messages"))


@query("SELECT id, platform, name, display_name FROM users WHERE person_id IS NULL AND contains(lower(concat_ws(' ', name, display_name)), 'an')")
def unmapped_identities(load):
    """Accounts without a person, by a part of the name."""
    return persons.unmapped(load("users"), "AN")


@query(f"WITH {_WHO}, {_MEMBERS}, n AS (SELECT channel_id, sender_id, count(*) AS messages FROM messages GROUP BY 1, 2) SELECT members.channel_id, coalesce('p' || person_id, 'u' || who.user_id) AS entity, min(display) AS display, count(*) AS accounts, CAST(sum(coalesce(messages, 0)) AS BIGINT) AS messages FROM members JOIN who ON who.user_id = members.user_id LEFT JOIN n ON n.channel_id = members.channel_id AND n.sender_id = members.user_id GROUP BY 1, 2")
def participants_merged(load):
    """Participants by person."""
    return persons.merged_participants(threads.members(load("messages"), load("channel_participants")), load("users"), load("people"), load("messages"))


@query("SELECT (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM channels) AS channels, (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM people) AS people")
def archive_summary(load):
    """Sizes of the archive's tables."""
    counts = [load(n).agg(F.count("*").alias(n)) for n in ("messages", "channels", "users", "people")]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])  # four single rows


@query("SELECT run_id, source_kind, source_path, status, finished_at - started_at AS took_ms, error FROM ingest_log ORDER BY run_id DESC LIMIT 50")
def ingest_history(load):
    """The last 50 runs."""
    return load("ingest_log").orderBy(F.desc("run_id")).limit(50).select("run_id", "source_kind", "source_path", "status", (F.col("finished_at") - F.col("started_at")).alias("took_ms"), "error")


@query("SELECT l.run_id, count(m.row_id) AS delivered, count(DISTINCT m.message_id) AS distinct_ids FROM ingest_log l LEFT JOIN messages m ON m.run_id = l.run_id GROUP BY 1")
def run_counts(load):
    """What every run delivered."""
    m = load("messages").groupBy("run_id").agg(F.count("*").alias("delivered"), F.countDistinct("message_id").alias("distinct_ids"))
    return load("ingest_log").select("run_id").join(m, "run_id", "left").select("run_id", F.coalesce("delivered", F.lit(0)).alias("delivered"), F.coalesce("distinct_ids", F.lit(0)).alias("distinct_ids"))


# --- pages


@query("SELECT channel_id, row_id, timestamp, row_number() OVER (PARTITION BY channel_id ORDER BY timestamp DESC NULLS LAST, row_id DESC) AS place FROM messages QUALIFY place <= 150")
def page_latest(load):
    """The newest page of every thread."""
    return threads.latest_page(load("messages").select("channel_id", "row_id", "timestamp"))


_BUSY = "(SELECT channel_id FROM messages WHERE channel_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, channel_id LIMIT 1)"
_MIDDLE = f"(SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY timestamp, row_id) AS k, count(*) OVER () AS n FROM messages WHERE channel_id = {_BUSY} AND timestamp IS NOT NULL) WHERE k = n // 2 + 1)"


def _busy(load) -> tuple[int, tuple[int, int]]:
    """The thread with most messages, and the cursor of its middle one."""
    m = load("messages").where("channel_id IS NOT NULL")
    channel = m.groupBy("channel_id").count().orderBy(F.desc("count"), "channel_id").first()[0]
    rows = m.where((F.col("channel_id") == channel) & F.col("timestamp").isNotNull())
    t, r = rows.orderBy("timestamp", "row_id").select("timestamp", "row_id").offset(rows.count() // 2).first()
    return channel, (t, r)


_CURSOR = f"c AS (SELECT timestamp AS t, row_id AS r FROM messages WHERE row_id = {_MIDDLE})"
_ROWS = f"FROM messages, c WHERE channel_id = {_BUSY}"


@query(f"WITH {_CURSOR} SELECT row_id, timestamp {_ROWS} AND (timestamp < t OR (timestamp = t AND row_id < r)) ORDER BY timestamp DESC, row_id DESC LIMIT 150")
def page_before(load):
    """The page before a message of the busiest thread."""
    channel, cursor = _busy(load)
    return threads.page(load("messages"), channel, before=cursor).select("row_id", "timestamp")


@query(f"WITH {_CURSOR} SELECT row_id, timestamp {_ROWS} AND (timestamp > t OR (timestamp = t AND row_id > r)) ORDER BY timestamp, row_id LIMIT 150")
def page_after(load):
    """The page after it."""
    channel, cursor = _busy(load)
    return threads.page(load("messages"), channel, after=cursor).select("row_id", "timestamp")


@query(f"WITH {_CURSOR} (SELECT row_id, timestamp {_ROWS} AND (timestamp < t OR (timestamp = t AND row_id < r)) ORDER BY timestamp DESC, row_id DESC LIMIT 75) UNION ALL (SELECT row_id, timestamp {_ROWS} AND (timestamp > t OR (timestamp = t AND row_id >= r)) ORDER BY timestamp, row_id LIMIT 75)")
def page_around(load):
    """The page centred on it."""
    channel, cursor = _busy(load)
    return threads.around(load("messages"), channel, cursor[1]).select("row_id", "timestamp")


@query(f"WITH {_CURSOR} SELECT row_id, timestamp {_ROWS} AND timestamp < t ORDER BY timestamp DESC, row_id DESC LIMIT 150")
def page_same_ts_compat(load):
    """The page before it by times alone, which skips the cursor's millisecond."""
    channel, cursor = _busy(load)
    return threads.page(load("messages"), channel, before=cursor, strict_ms=True).select("row_id", "timestamp")


@query("""WITH m AS (SELECT channel_id, row_id, sender_id, timestamp, CAST(make_timestamp(timestamp * 1000) AS DATE) AS day FROM messages WHERE timestamp IS NOT NULL),
w AS (SELECT *, lag(timestamp) OVER x AS pt, lag(sender_id) OVER x AS ps FROM m WINDOW x AS (PARTITION BY channel_id, day ORDER BY timestamp, row_id))
SELECT channel_id, row_id, CAST(pt IS NULL AS INTEGER) AS new_day, CAST(coalesce(pt IS NOT NULL AND ps IS NOT DISTINCT FROM sender_id AND timestamp - pt < 300000, false) AS INTEGER) AS grouped FROM w""")
def message_runs(load):
    """Which messages continue their sender's run."""
    return threads.runs(load("messages"))


@query(f"""WITH {_WHO}, t AS (SELECT message_id AS replied_to_id, first(text ORDER BY timestamp NULLS FIRST, row_id) AS reply_text FROM messages GROUP BY 1)
SELECT m.row_id, m.message_id, m.channel_id, m.sender_id, display, is_self, m.timestamp, m.text, r.replied_to_id, substr(coalesce(reply_text, ''), 1, 160) AS reply_preview
FROM messages m LEFT JOIN who ON user_id = sender_id LEFT JOIN message_replied_to r ON r.message_id = m.message_id LEFT JOIN t ON t.replied_to_id = r.replied_to_id""")
def decorate_messages(load):
    """Messages with author, self flag and the text they reply to."""
    m = load("messages")
    return threads.decorated(m, m, load("message_replied_to"), load("users"), load("people"))


_REACTIONS = """r AS (SELECT rec_id, unnest(from_json(CASE json_type(e) WHEN 'ARRAY' THEN e WHEN 'OBJECT' THEN '[' || e || ']' END, '["JSON"]')) AS x FROM (SELECT rec_id, CAST(message AS JSON) -> '$.properties.emotions' AS e FROM decoded)),
a AS (SELECT rec_id, x ->> '$.key' AS emoji, unnest(from_json(CASE json_type(x -> '$.users') WHEN 'ARRAY' THEN x -> '$.users' WHEN 'OBJECT' THEN '[' || (x -> '$.users') || ']' END, '["JSON"]')) AS u FROM r)"""


def _actors(load):
    rows = shapes.child_rows(load("decoded")).where("child_kind = 'reaction'")
    m = shapes.parsed(F.col("message"))
    keys = load("decoded").select("rec_id", F.posexplode(F.transform(shapes.entries(F.call_function("try_variant_get", m, F.lit("$.properties.emotions"), F.lit("variant"))), lambda e: F.call_function("try_variant_get", e, F.lit("$.key"), F.lit("string")))).alias("pos", "emoji"))
    actors = rows.select("rec_id", "pos", F.call_function("try_variant_get", "node", F.lit("$.DisplayName"), F.lit("string")).alias("actor"))
    return actors.join(keys, ["rec_id", "pos"])


@query(f"WITH {_REACTIONS} SELECT rec_id, emoji, count(*) AS n, string_agg(DISTINCT u ->> '$.DisplayName', ', ' ORDER BY u ->> '$.DisplayName') AS actors FROM a WHERE json_type(u) = 'OBJECT' AND emoji <> 'reactionsConsumptionHorizon' GROUP BY 1, 2")
def reaction_counts(load):
    """Reactions by message and emoji, with who reacted, in order."""
    rows = _actors(load).where("emoji <> 'reactionsConsumptionHorizon'")
    return rows.groupBy("rec_id", "emoji").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("actor")), ", ").alias("actors"))


# --- search


def _hits(load, q, **scope):
    return search.search(search.index(load("messages")), q, **scope)


def _search_sql(test: str) -> str:
    return f"SELECT row_id FROM (SELECT *, {_SPACED} AS toks FROM messages) WHERE {test}"


def _searching(name: str, doc: str, q: str, test: str) -> None:
    def f(load):
        return _hits(load, q).select("row_id")

    f.__name__, f.__doc__ = name, doc
    query(_search_sql(test))(f)


def _has(*options: str) -> str:
    return "(" + " OR ".join(f"contains(toks, ' {o} ')" for o in options) + ")"


_searching("search_word", "One word.", "tent", _has("tent", "t ent", "ten t"))
_searching("search_and", "Two words.", "tent room", _has("tent", "t ent", "ten t") + " AND " + _has("room", "r oom", "roo m"))
_searching("search_or", "Either word.", "playlist OR timetable", "(" + _has("playlist", "p laylist", "playlis t") + " OR " + _has("timetable", "t imetable") + ")")
_searching("search_not", "A word without another.", "tent -room", _has("tent", "t ent", "ten t") + " AND NOT " + _has("room", "r oom", "roo m"))
_searching("search_group", "Brackets, and an exclusion of a group.", "(tent | playlist) NOT (room maybe)", "(" + _has("tent", "t ent", "ten t") + " OR " + _has("playlist", "p laylist", "playlis t") + ") AND NOT (" + _has("room", "r oom", "roo m") + " AND " + _has("maybe", "m aybe") + ")")
_searching("search_phrase", "A phrase.", '"tram stop"', _has("tram stop"))
_searching("search_prefix", "The beginning of a word.", "harr*", "contains(toks, ' harr')")
_searching("search_folded", "Diacritics and case don't matter.", "KVĚTA", _has("kveta", "k veta"))
_searching("search_apostrophe", "Both spellings around an apostrophe.", "doesn't", _has("doesnt", "doesn t"))


@query(f"SELECT row_id, timestamp FROM (SELECT *, {_SPACED} AS toks FROM messages) WHERE {_has('tent', 't ent', 'ten t')} AND platform = 'facebook' AND channel_id IN (SELECT channel_id FROM messages WHERE channel_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, channel_id LIMIT 5)")
def search_scope(load):
    """A search in the five busiest threads of one platform."""
    top = [r[0] for r in load("messages").where("channel_id IS NOT NULL").groupBy("channel_id").count().orderBy(F.desc("count"), "channel_id").limit(5).collect()]
    return _hits(load, "tent", platform="facebook", channels=top).select("row_id", "timestamp")


@query(f"SELECT row_id, timestamp FROM (SELECT *, {_SPACED} AS toks FROM messages) WHERE {_has('tent', 't ent', 'ten t')} ORDER BY timestamp DESC NULLS LAST, row_id DESC LIMIT 60 OFFSET 60")
def search_page(load):
    """The second page of hits."""
    return search.search_page(_hits(load, "tent"), 60, 60).select("row_id", "timestamp")


@query(f"SELECT {_MONTH} AS month, count(*) AS hits FROM (SELECT *, {_SPACED} AS toks FROM messages) WHERE {_has('tent', 't ent', 'ten t')} AND timestamp IS NOT NULL GROUP BY 1")
def search_months(load):
    """Hits a month, by the same predicate as the search."""
    return _hits(load, "tent").where("timestamp IS NOT NULL").groupBy(time.month(F.col("timestamp")).alias("month")).agg(F.count("*").alias("hits"))


#: A small paradigm table for the widening query: (form, lemma).
_PARADIGM = [("stan", "stan"), ("stanu", "stan"), ("stany", "stan"), ("foťák", "foťák"), ("foťáku", "foťák"), ("nabíječka", "nabíječka"), ("nabíječku", "nabíječka"), ("mapa", "mapa"), ("mapu", "mapa")]


@query(f"SELECT row_id FROM (SELECT *, {_SPACED} AS toks FROM messages) WHERE {_has('mapu', 'm apu', 'map u', 'mapa')}".replace(", 'map u'", ""))
def search_widened(load):
    """A word widened to its paradigm by a lexicon."""
    lexicon = search.build_lexicon(load("messages").sparkSession.createDataFrame(_PARADIGM, "word string, lemma string"))
    return _hits(load, "mapu", lexicon=lexicon).select("row_id")


SQL["search_widened"] = f"SELECT row_id FROM (SELECT *, {_SPACED} AS toks FROM messages) WHERE {_has('mapu', 'm apu', 'mapa')}"


@query(f"SELECT t AS token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS t FROM messages) WHERE regexp_matches(t, '^[a-z0-9]+$') GROUP BY 1")
def tokens_vocab(load):
    """How often tokens of plain letters occur."""
    toks = load("messages").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return toks.where(F.col("token").rlike("^[a-z0-9]+$")).groupBy("token").agg(F.count("*").alias("n"))


@query()
def search_snippets(load):
    """A page of hits with the best fragment of each; SQL has no fragments."""
    q = search.compile_query("tent OR playlist")
    page = search.search_page(_hits(load, "tent OR playlist"))
    return page.select("row_id", "timestamp", snippets.snippet(F.col("text"), q.words()).alias("snippet"))


# --- writes as plans


@query("SELECT message_id, row_id, run_id FROM messages WHERE message_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY run_id, row_id) = 1")
def dedup_first_wins(load):
    """The first delivery of every message_id."""
    return writes.first_wins(load("messages").select("message_id", "row_id", "run_id"), ["message_id"], ["run_id", "row_id"])


@query("SELECT message_id, row_id FROM messages WHERE run_id > 16 AND message_id NOT IN (SELECT message_id FROM messages WHERE run_id <= 16 AND message_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY run_id, row_id) = 1")
def append_new_only(load):
    """What the later half of the runs adds to the earlier half."""
    m = load("messages").select("message_id", "row_id", "run_id")
    return writes.append_new(m.where("run_id <= 16"), m.where("run_id > 16"), ["message_id"], ["run_id", "row_id"]).select("message_id", "row_id")


@query("""WITH l AS (SELECT message_id, text, is_unsent FROM messages WHERE run_id > 16 QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY run_id DESC, row_id DESC) = 1),
o AS (SELECT message_id, text, is_unsent FROM messages WHERE run_id <= 16 QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY run_id, row_id) = 1)
SELECT coalesce(o.message_id, l.message_id) AS message_id, coalesce(l.text, o.text) AS text, CASE WHEN l.message_id IS NOT NULL THEN l.is_unsent ELSE o.is_unsent END AS is_unsent FROM o FULL JOIN l ON l.message_id = o.message_id""")
def upsert_last_wins(load):
    """The earlier half with the later half written over it; a null text leaves the old one."""
    m = load("messages").select("message_id", "text", "is_unsent", "run_id", "row_id")
    old = writes.first_wins(m.where("run_id <= 16"), ["message_id"], ["run_id", "row_id"]).select("message_id", "text", "is_unsent")
    new = writes.first_wins(m.where("run_id > 16").withColumn("a", -F.col("run_id")).withColumn("b", -F.col("row_id")), ["message_id"], ["a", "b"]).select("message_id", "text", "is_unsent")
    return writes.upsert(old, new, ["message_id"], ["text", "is_unsent"], ["text"])


@query("SELECT channel_id, user_id FROM channel_participants WHERE channel_id NOT IN (SELECT channel_id FROM messages WHERE platform = 'discord' AND channel_id IS NOT NULL AND sender_id IS NOT NULL) UNION ALL SELECT DISTINCT channel_id, sender_id FROM messages WHERE platform = 'discord' AND channel_id IS NOT NULL AND sender_id IS NOT NULL")
def delete_insert_children(load):
    """Participants of threads with new rows replaced by who wrote there."""
    new = load("messages").where("platform = 'discord' AND channel_id IS NOT NULL AND sender_id IS NOT NULL").select("channel_id", F.col("sender_id").alias("user_id")).distinct()
    return writes.replace_children(load("channel_participants").select("channel_id", "user_id"), new, "channel_id")


@query("SELECT n.row_id FROM messages n WHERE n.run_id > 16 AND NOT EXISTS (SELECT 1 FROM messages o WHERE o.run_id <= 16 AND o.channel_id IS NOT DISTINCT FROM n.channel_id AND o.source_key IS NOT DISTINCT FROM n.source_key AND o.text IS NOT DISTINCT FROM n.text)")
def null_safe_anti(load):
    """Later rows that no earlier row equals on nullable columns."""
    m = load("messages").select("row_id", "run_id", "channel_id", "source_key", "text")
    return writes.absent_null_safe(m.where("run_id > 16"), m.where("run_id <= 16"), ["channel_id", "source_key", "text"]).select("row_id")


@query("SELECT message_id, replied_to_id FROM message_replied_to WHERE replied_to_id NOT IN (SELECT message_id FROM messages WHERE message_id IS NOT NULL) AND replied_to_id IS NOT NULL")
def dangling_replies(load):
    """Replies whose target is absent."""
    return writes.dangling(load("message_replied_to").where("replied_to_id IS NOT NULL"), load("messages"))


@query("SELECT avatar_sha256, count(DISTINCT name) AS keys FROM users WHERE name IS NOT NULL AND avatar_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 1")
def collision_audit(load):
    """Ids that stand for several keys: pictures that stand for several names (message ids never do in these tables)."""
    return ids.collisions(load("users").where("avatar_sha256 IS NOT NULL"), "avatar_sha256", "name")


@query("SELECT source_key, count(DISTINCT message_id) AS ids, count(*) AS n FROM messages WHERE source_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT message_id) > 1")
def source_key_audit(load):
    """Source keys that came under several ids."""
    return load("messages").where("source_key IS NOT NULL").groupBy("source_key").agg(F.countDistinct("message_id").alias("ids"), F.count("*").alias("n")).where("ids > 1")


@query(r"""WITH v AS (SELECT row_id, coalesce(CASE WHEN row_id % 7 = 0 THEN 'Ann reacted 👍 to your message' WHEN row_id % 11 = 0 THEN 'liked a message ' ELSE text END, '') AS text FROM messages)
SELECT row_id FROM v WHERE regexp_matches(text, '(?i)^\s*(\S+\s+)?(reacted\s+\S{1,8}\s+to\s+your\s+message|liked\s+a\s+message)\s*$')""")
def notice_filter(load):
    """Reaction notices among messages (some planted, as the table has none)."""
    planted = F.when(F.col("row_id") % 7 == 0, "Ann reacted 👍 to your message").when(F.col("row_id") % 11 == 0, "liked a message ").otherwise(F.col("text"))
    return load("messages").withColumn("t", planted).where(text.is_notice(F.col("t"))).select("row_id")


@query("WITH p AS (SELECT sender_id AS account, platform || ' ' || coalesce(text, '') AS name, min(row_id) AS seen, count(*) AS votes FROM messages WHERE sender_id IS NOT NULL GROUP BY 1, 2) SELECT account, name, votes FROM p QUALIFY row_number() OVER (PARTITION BY account ORDER BY votes DESC, seen, name) = 1")
def directory_vote(load):
    """What every account says most often; of equals, what it said first."""
    pairs = load("messages").select(F.col("sender_id").alias("account"), F.concat_ws(" ", "platform", F.coalesce("text", F.lit(""))).alias("name"), F.col("row_id").alias("ordinal"))
    return writes.directory_vote(pairs)


@query("SELECT name, count(DISTINCT id) AS accounts FROM users WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) > 1")
def name_clash(load):
    """Names that several accounts bear."""
    return writes.name_clashes(load("users").where("name IS NOT NULL").select(F.col("id").alias("account"), "name"))


@query("SELECT channel_id FROM channel_participants UNION SELECT channel_id FROM messages WHERE channel_id IS NOT NULL")
def set_union_distinct(load):
    """Threads with members or messages."""
    return load("channel_participants").select("channel_id").unionByName(load("messages").where("channel_id IS NOT NULL").select("channel_id")).distinct()


@query("SELECT id AS channel_id FROM channels EXCEPT SELECT channel_id FROM messages")
def set_difference(load):
    """Threads without messages."""
    return load("channels").select(F.col("id").alias("channel_id")).join(load("messages").select("channel_id").distinct(), "channel_id", "left_anti").distinct()


@query("SELECT user_id FROM channel_participants INTERSECT SELECT sender_id FROM messages")
def set_intersection(load):
    """Participants who write."""
    return load("channel_participants").select("user_id").distinct().join(load("messages").select(F.col("sender_id").alias("user_id")).distinct(), "user_id", "left_semi")


# --- JSON, arrays and text of raw records


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(load):
    """A member of embedded JSON."""
    return load("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT rec_id, CAST(message AS JSON) ->> '$.messagetype' AS kind, coalesce(CAST(epoch_ms(try_cast(CAST(message AS JSON) ->> '$.originalarrivaltime' AS TIMESTAMP)) AS BIGINT), try_cast(CAST(message AS JSON) ->> '$.id' AS BIGINT), 0) AS ts FROM decoded")
def variant_extract(load):
    """Members of records by path, and their arrival as milliseconds."""
    get = lambda name: F.call_function("try_variant_get", shapes.parsed(F.col("message")), F.lit(f"$.{name}"), F.lit("string"))
    arrival = F.regexp_extract(get("originalarrivaltime"), r"^\d{4}-\d\d-\d\dT.*$", 0)
    return load("decoded").select("rec_id", get("messagetype").alias("kind"), time.iso_ms(F.nullif(arrival, F.lit("")), get("id")).alias("ts"))


@query(r"SELECT rec_id FROM decoded WHERE NOT coalesce(CAST(message AS JSON) ->> '$.messagetype', '') IN ('Poll', 'Translation') AND NOT starts_with(coalesce(CAST(message AS JSON) ->> '$.messagetype', ''), 'ThreadActivity/') AND NOT starts_with(coalesce(CAST(message AS JSON) ->> '$.messagetype', ''), 'Event/') AND NOT regexp_matches(coalesce(CAST(message AS JSON) ->> '$.content', ''), '^Call Logs for Call [0-9a-fA-F-]{36}$')")
def importable_records(load):
    """Records that are conversation and not bookkeeping."""
    from lorewell.sources import chat_export

    return chat_export.importable(load("decoded")).select("rec_id")


@query()
def record_text(load):
    """Records' content as prose: markup reduced, emoticons drawn, quotes left out. SQL can't follow nested markup."""
    from lorewell.sources import chat_export

    return chat_export.prose(load("decoded")).select("rec_id", "text")


@query(f"WITH {_REACTIONS} SELECT DISTINCT emoji FROM a WHERE json_type(u) = 'OBJECT'")
def reaction_keys(load):
    """The shortcodes in use."""
    return _actors(load).select("emoji").distinct()


@query()
def reaction_emoji(load):
    """The shortcodes in use, drawn; a lookup that SQL would only repeat."""
    return _actors(load).select("emoji").distinct().select("emoji", text.emoji_for(F.col("emoji")).alias("drawn"))


@query("SELECT id, CASE WHEN trim(name) = '' THEN NULL WHEN regexp_matches(trim(name), '^\\d+:') THEN trim(name) ELSE '8:' || trim(name) END AS mri FROM users WHERE platform = 'teams'".replace("\\\\d", "\\d"))
def account_ids(load):
    """Account ids in one spelling."""
    return load("users").where("platform = 'teams'").select("id", text.account_mri(F.col("name")).alias("mri"))


# --- ids and text repair (H1, T4, T5)


@query()
def synth_ids(load):
    """Ids minted from platform and path; no SQL has the digest."""
    return load("channels").select("id", ids.minted(F.col("platform"), F.col("topic")).alias("minted"))


@query()
def mojibake_repair(load):
    """Latin-1 garbled texts repaired; DuckDB has no such encoding."""
    return load("messages").where(F.col("text").isNotNull()).select("row_id", text.demojibake(F.col("text")).alias("text")).where("text <> ''")


@query("SELECT name AS form, CASE WHEN starts_with(lower(name), 'ne') THEN false ELSE starts_with(regexp_replace(lower(name), '^nej', ''), 'ne') END AS neg FROM users WHERE name IS NOT NULL")
def negation(load):
    """The polarity test over names as forms of themselves."""
    return load("users").where("name IS NOT NULL").select(F.col("name").alias("form"), text.negated(F.lower("name"), F.lower("name")).alias("neg"))


@query("SELECT event_type, to_timestamp(0)::TIMESTAMP + INTERVAL 1 HOUR * CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_hourly(load):
    """Events by type and hour: the batch form of the streaming window."""
    hour = F.date_trunc("hour", F.col("ts"))
    return load("events").groupBy("event_type", hour.cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))


# --- reading helpers (T24, T25, D5, A17 top, N2, F5)


@query(r"SELECT row_id, unnest(regexp_extract_all(coalesce(text, ''), 'https?://[^\s<]+')) AS link FROM messages")
def text_links(load):
    """The web links of every message."""
    return load("messages").select("row_id", F.explode(text.links(F.col("text"))).alias("link"))


@query("SELECT row_id, CAST((make_timestamp(timestamp * 1000) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague' AS DATE) AS day FROM messages WHERE timestamp >= 1577836800000 AND timestamp < 1798761600000")
def local_days(load):
    """Every message's calendar day in a viewer's time zone; impossible times have none."""
    return load("messages").where("timestamp >= 1577836800000 AND timestamp < 1798761600000").select("row_id", time.day(F.col("timestamp"), "Europe/Prague").alias("day"))


@query("SELECT channel_id, sender_id, n AS messages, place FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY n DESC, sender_id) AS place FROM (SELECT channel_id, sender_id, count(*) AS n FROM messages WHERE sender_id IS NOT NULL GROUP BY 1, 2)) WHERE place <= 12")
def top_senders(load):
    """The twelve who write most in every thread."""
    counts = load("messages").where("sender_id IS NOT NULL").groupBy("channel_id", "sender_id").agg(F.count("*").alias("messages"))
    w = W.partitionBy("channel_id").orderBy(F.desc("messages"), "sender_id")
    return counts.withColumn("place", F.row_number().over(w)).where("place <= 12")


@query("SELECT month, messages FROM (SELECT strftime(make_timestamp((timestamp // 1000) * 1000000), '%Y-%m') AS month, count(*) AS messages FROM messages WHERE timestamp IS NOT NULL GROUP BY 1) ORDER BY messages DESC, month LIMIT 1")
def peak_month(load):
    """The month with most messages."""
    m = load("messages").where("timestamp IS NOT NULL").groupBy(time.month(F.col("timestamp")).alias("month")).agg(F.count("*").alias("messages"))
    return m.orderBy(F.desc("messages"), "month").limit(1)


@query("SELECT m.message_id, m.row_id FROM messages m WHERE m.message_id IN (SELECT message_id FROM message_replied_to) AND m.message_id IN (SELECT replied_to_id FROM message_replied_to)")
def replied_and_replying(load):
    """Messages that reply and are replied to (semi-joins)."""
    r = load("message_replied_to")
    m = load("messages").select("message_id", "row_id")
    return m.join(r.select("message_id"), "message_id", "left_semi").join(r.select(F.col("replied_to_id").alias("message_id")), "message_id", "left_semi")
