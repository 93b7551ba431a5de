import pytest
from pyspark.sql import functions as F

from lorewell.archive import Archive
from lorewell.sources.detect import detect, media_index
from tests import exports

TABLES = ["messages", "users", "channels", "message_reactions", "message_embeds", "message_attachments", "message_replied_to", "channel_participants"]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    src = tmp_path_factory.mktemp("src")
    exports.dyi(src / "meta")
    exports.secure(src / "e2ee")
    exports.chat_folder(src / "teams")
    exports.tracker(src / "t.dht")
    a = Archive(spark, str(root))
    a.paths = [src / "meta", src / "e2ee" / "messages", src / "teams", src / "t.dht"]
    for p in a.paths:
        list(a.ingest(p))
    return a


def test_detect(tmp_path):
    exports.dyi(tmp_path / "m")
    exports.chat_tar(tmp_path / "t.tar")
    exports.tracker(tmp_path / "x.dht")
    kinds = [s.kind for s in detect(tmp_path)]
    assert sorted(kinds) == ["dyi", "dyi", "teams", "tracker"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        detect(tmp_path / "none")
    with pytest.raises(ValueError):
        detect(tmp_path / "absent")


def test_counts(archive):
    by = {r["platform"]: r["count"] for r in archive.table("messages").groupBy("platform").count().collect()}
    assert by == {"facebook": 52, "instagram": 4, "teams": 8, "discord": 3}
    assert archive.table("channels").count() == 7  # the empty plain thread has a row, the empty encrypted one has none
    assert archive.table("messages").where("is_unsent = 1").count() == 2
    assert archive.table("ingest_log").where("status = 'ok'").count() == 5
    assert archive.table("ingest_log").agg(F.sum("skipped_notices")).first()[0] == 2


def test_rows(archive):
    m = archive.table("messages")
    assert m.where("text = 'trasa 3: pořád šeříky'").count() == 1
    assert m.where("text = 'kdo veze stan? 😆'").count() == 1
    assert m.where("text LIKE 'Call Logs%'").count() == 0
    assert m.where("platform <> 'discord' AND message_id >= 0").count() == 0
    assert m.where("source_key IS NOT NULL").groupBy("source_key").count().where("count > 1").count() == 0
    assert archive.table("message_replied_to").count() == 2  # the dangling one is left out
    assert {r[0] for r in archive.table("message_reactions").select("emoji_name").collect()} == {"😂", "👍", "✔"}
    share = archive.table("message_embeds").where("json LIKE '%odd%'").first()["json"]
    assert '"share_text": "šeřík"' in share
    found = archive.table("attachments").where("sha256 IS NOT NULL").collect()
    assert len(found) == 1 and found[0]["type"] == "image/png" and found[0]["size"] == 4
    senders = m.select(F.col("sender_id").alias("id")).distinct()
    assert senders.join(archive.table("users"), "id", "left_anti").count() == 0


def test_again_changes_nothing(archive):
    before = {t: archive.table(t).count() for t in TABLES}
    for p in archive.paths:
        events = list(archive.ingest(p))
        assert all(e["new_msgs"] == 0 for e in events if e["event"] == "done")
    assert before == {t: archive.table(t).count() for t in TABLES}


def test_tar_reads_as_folder(spark, tmp_path):
    a, b = Archive(spark, str(tmp_path / "a")), Archive(spark, str(tmp_path / "b"))
    list(a.ingest(exports.chat_folder(tmp_path / "f")))
    list(b.ingest(exports.chat_tar(tmp_path / "t.tar")))
    for t in TABLES:
        rows = [sorted(map(str, x.table(t).collect())) for x in (a, b)]
        assert rows[0] == rows[1], t


def test_failed_import_changes_nothing(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"))
    src = exports.tracker(tmp_path / "x.dht")
    source = detect(src)[0]
    src.unlink()
    with pytest.raises(Exception):
        a.ingest_source(source)
    assert a.table("messages").count() == 0
    assert a.table("ingest_log").first()["status"] == "failed"


def test_archive_reads(archive):
    assert archive.search("veze").count() == 1
    assert archive.search("STAN -vezu").count() == 1
    assert archive.threads(platform="facebook").count() == 3
    person = archive.create_person("Brynn")
    ids = [r[0] for r in archive.table("users").where("name LIKE 'Brynn%'").select("id").collect()]
    archive.link(ids, person)
    assert archive.people().where(F.col("person_id") == person).first()["accounts"] == len(ids)
    channels = [r[0] for r in archive.table("channels").select("id").collect()]
    assert archive.months(channels).agg(F.sum("messages")).first()[0] == archive.table("messages").count()
    with pytest.raises(ValueError):
        archive.create_person("Brynn")
    archive.update_person(person, notes="x")
    archive.unlink(ids[:1])
    assert archive.table("users").where(F.col("person_id") == person).count() == len(ids) - 1
    archive.delete_person(person)
    assert archive.table("people").count() == 0 and archive.table("users").where("person_id IS NOT NULL").count() == 0
    found = archive.searched("stan | trasa", limit=5)
    assert (found.page.count(), found.total, found.expression) == (5, 44, '((stan OR "s tan" OR "sta n") OR (trasa OR "t rasa"))')


def test_pages_have_all_that_hangs_on_messages(archive):
    thread = archive.table("messages").where("text = 'kdo veze stan? 😆'").first()["channel_id"]
    first = archive.page(thread, limit=5)
    rest = archive.page(thread, limit=5, before=first["before"])
    assert first["more"] and not rest["more"] and len(first["rows"]) == 5 and len(rest["rows"]) == 3
    rows = {r["text"]: r for r in rest["rows"] + first["rows"]}
    assert rows["kdo veze stan? 😆"]["reactions"][0]["who"] == ["Wendla Ōya"] and rows["stan vezu"]["reply_preview"] == "kdo veze stan? 😆"
    assert [a["name"] for r in rows.values() for a in r["attachments"] or []] == ["mapa.pdf"] and "example.org" in rows["tady"]["embeds"][0]


def test_bytes_are_stored(archive):
    row = archive.table("attachments").where("sha256 IS NOT NULL").first()
    with open(f"{archive.root}/media/{row['local_path']}", "rb") as f:
        assert f.read() == b"\x89PNG"


def test_imports_write_only_new_rows(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"))
    list(a.ingest(exports.chat_folder(tmp_path / "f")))
    old = a.manifest()
    list(a.ingest(exports.tracker(tmp_path / "x.dht")))
    new = a.manifest()
    assert new["messages"][: len(old["messages"])] == old["messages"] and len(new["messages"]) == 2
    written = [spark.read.parquet(f"{a.root}/{new[t][-1]}").count() for t in ("messages", "messages_idx")]
    assert written == [3, 3] and a.table("messages").count() == 11 and a.search("hi").count() == 3


def test_a_commit_that_dies_is_in_nobodys_way(spark, tmp_path):
    class Dead:
        """A file system on which no manifest can be created."""

        def __getattr__(self, name):
            return getattr(real, name)

        def create(self, *_):
            raise OSError("lost")

    a = Archive(spark, str(tmp_path / "a"))
    real, a._fs = a._fs, Dead()
    with pytest.raises(OSError):
        list(a.ingest(exports.tracker(tmp_path / "x.dht")))
    a._fs = real
    assert a.version() == 0
    list(a.ingest(tmp_path / "x.dht"))
    assert a.table("messages").count() == 3


def test_a_large_index_is_read_in_parts(spark, tmp_path):
    """More than one VARIANT may hold: some 200 MB in one index."""
    talks = [{"id": f"19:{k}", "displayName": f"t{k}", "MessageList": [{"id": str(i), "messagetype": "Text", "content": f"m{i} \\\" ]}}" + "x" * 2_000, "from": "8:live:a", "displayName": "A", "originalarrivaltime": "2022-06-14T13:23:27Z"} for i in range(24)]} for k in range(2)]
    import json

    folder = tmp_path / "f"
    folder.mkdir()
    one, two = (json.dumps(t) for t in talks)
    with (folder / "messages.json").open("w") as f:
        f.write('{"conversations": [' + one + ", " + two)
        for k in range(2, 4_000):
            f.write(", " + one.replace('"19:0"', f'"19:{k}"'))
        f.write('], "userId": "8:live:a"}')
    assert (folder / "messages.json").stat().st_size > 190_000_000
    from lorewell.sources import chat_export

    rows = chat_export.read_records(spark, detect(folder)[0])
    assert rows.agg(F.count("*"), F.countDistinct("conversation_ordinal")).first() == (96_000, 4_000)
    bad = tmp_path / "g"
    bad.mkdir()
    (bad / "messages.json").write_text('{"userId": "x", "conversations": [{"id": "a", "MessageList": [{"id": }]}]}')
    with pytest.raises(Exception):
        chat_export.read_records(spark, detect(bad)[0]).count()


def test_purge(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "a"))
    list(a.ingest(exports.tracker(tmp_path / "x.dht")))
    rows = a.table("messages").withColumn("text", F.when(F.col("message_id").isin(10, 11), "liked a message").otherwise(F.col("text")))
    a.commit({"messages": rows})
    assert a.purge_notices() == 1  # the one with a picture stays
    assert a.table("messages").count() == 2


def test_media_index():
    assert media_index(["media/a.1.png", "media/a.2.png", "b.1.jpg", "b"]) == {"a": "media/a.1.png", "b": "b.1.jpg"}
