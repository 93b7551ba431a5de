import json

import pytest
from pyspark.sql import functions as F

from lorewell.functions import text
from lorewell.sources import dictionary, package, vault


def test_vault(spark, tmp_path):
    rows = [("a/x.PNG", bytearray(b"one")), ("b/y.png", bytearray(b"one")), ("c", bytearray(b"two")), ("d.gif", bytearray(b""))]
    files = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    first = vault.put(files, str(tmp_path / "v")).collect()
    assert sum(r["is_new"] for r in first) == 3 and len({r["local_path"] for r in first}) == 3
    assert not any(r["is_new"] for r in vault.put(files, str(tmp_path / "v")).collect())
    stored = tmp_path / "v" / first[0]["local_path"]
    assert stored.read_bytes() == b"one" and stored.name == first[0]["sha256"] + ".png"
    assert not list((tmp_path / "v").rglob("*.tmp"))


def test_resolve(spark):
    wanted = spark.createDataFrame([("your_x/m/a.jpg",), ("m/b.jpg",), ("none",)], "uri string")
    listing = spark.createDataFrame([("/r/your_x/m/a.jpg",), ("/r/your_x/m/b.jpg",)], "path string")
    got = {r["uri"]: r["path"] for r in vault.resolve(wanted, listing, "/r", "/r/your_x").collect()}
    assert got == {"your_x/m/a.jpg": "/r/your_x/m/a.jpg", "m/b.jpg": "/r/your_x/m/b.jpg"}


def test_dimensions(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    gif = b"GIF89a" + (3).to_bytes(2, "little") + (4).to_bytes(2, "little")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (5).to_bytes(2, "big") + (6).to_bytes(2, "big") + b"\0" * 8
    assert [vault.size_of(x) for x in (png, gif, jpeg, b"", None, b"text text text")] == [(7, 9), (3, 4), (6, 5), None, None, None]
    out = spark.createDataFrame([(bytearray(png),), (None,)], "b binary").select(vault.dimensions(F.col("b")).alias("d")).collect()
    assert out[0]["d"]["width"] == 7 and (out[1]["d"] is None or out[1]["d"]["width"] is None)


def test_package(spark, tmp_path):
    folder = tmp_path / "c42"
    folder.mkdir()
    link = "https://media.example/attachments/42/7/a%20b.png?ex=1"
    rows = [{"ID": 1, "Timestamp": "2020-09-13 12:26:40", "Contents": "hi", "Attachments": f"{link} https://x.example/none"}, {"ID": 2, "Timestamp": "bad", "Contents": None, "Attachments": ""}]
    (folder / "messages.json").write_text(json.dumps(rows))
    df = package.read(spark, str(tmp_path))
    got = {(r["message_id"], r["link"]): r for r in df.collect()}
    assert len(got) == 3 and got[1, link]["timestamp"] == 1_600_000_000_000 and got[2, None]["timestamp"] is None and got[2, None]["channel_id"] == 42
    attachments = spark.createDataFrame([(7, None)], "attachment_id bigint, sha256 string")
    plan = package.plan(df, attachments)
    assert plan["absent"].count() == 0 and plan["without_bytes"].first()["name"] == "a b.png" and plan["to_link"].count() == 1


def test_dictionary(spark, tmp_path):
    (tmp_path / "w").write_text("stan\nstany\nmapa\n", encoding="utf-8")
    (tmp_path / "l").write_text("mapa\nstan\n", encoding="utf-8")
    (tmp_path / "n").write_bytes(b"".join(i.to_bytes(3, "big") for i in (1, 1, 0)))
    paths = [str(tmp_path / x) for x in "wnl"]
    assert sorted(tuple(r) for r in dictionary.read(spark, *paths).collect()) == [("mapa", "mapa"), ("stan", "stan"), ("stany", "stan")]
    (tmp_path / "n").write_bytes(b"\0\0")
    with pytest.raises(ValueError):
        dictionary.read(spark, *paths)


def test_reading_helpers(spark):
    row = spark.range(1).select(
        text.links(F.lit("see https://a.b/c and http://d<br>")).alias("l"), text.file_size(F.lit(1536)).alias("s"), text.file_size(F.lit(0)).alias("z"), text.file_size(F.lit(20 << 20)).alias("m"),
        text.avatar_document(F.lit("https://x/objects/0-a/views")).alias("d"), text.account_handle(F.lit("8:live:.cid.abc")).alias("h"), text.account_handle(F.lit("8:unknown_user_123456789")).alias("u"),
    ).first()
    assert row["l"] == ["https://a.b/c", "http://d"] and (row["s"], row["z"], row["m"]) == ("1.5 KB", "0 B", "20 MB")
    assert (row["d"], row["h"], row["u"]) == ("0-a", "abc", "Unknown account (12345678)")
