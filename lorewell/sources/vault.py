"""A content-addressed store of media: ``<root>/<first two of the digest>/<digest><suffix>``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def named(files: DataFrame) -> DataFrame:
    """``path, content`` with sha256, size and local_path; bytes that come often are kept once for each suffix."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    digest = F.sha2("content", 256)
    rows = files.select("path", "content", digest.alias("sha256"), F.length("content").cast("bigint").alias("size"), suffix.alias("suffix"))
    return rows.withColumn("local_path", F.concat(F.substring("sha256", 1, 2), F.lit("/"), "sha256", "suffix"))


def put(files: DataFrame, root: str) -> DataFrame:
    """Stores ``path, content`` and gives (path, sha256, size, local_path, is_new). Tasks write under a temporary name
    and rename, and what is there already is left, so a repeated task changes nothing. Lazy: stored when read."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            new = []
            for content, local in zip(batch["content"], batch["local_path"]):
                path = f"{base}/{local}"
                there = store.get_file_info(path).type == pafs.FileType.File
                if not there:
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
                    with store.open_output_stream(temporary) as out:
                        out.write(content)
                    store.move(temporary, path)
                new.append(not there)
            yield batch.assign(is_new=new)[["path", "sha256", "size", "local_path", "is_new"]]

    return named(files).drop("suffix").mapInPandas(apply, "path string, sha256 string, size bigint, local_path string, is_new boolean")


def put_blobs(blobs: DataFrame, attachments: DataFrame, root: str) -> int:
    """Stores the bytes of attachments that a tracker file holds (``normalized_url, blob``); how many were new."""
    named_ = attachments.where("normalized_url IS NOT NULL").groupBy("normalized_url").agg(F.min("name").alias("name"))
    files = blobs.where("blob IS NOT NULL").join(named_, "normalized_url").select(F.col("name").alias("path"), F.col("blob").alias("content"))
    return put(files, root).agg(F.count_if("is_new")).first()[0]


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, content`` of files; bytes are read only where they are used."""
    return spark.read.format("binaryFile").load(pattern).select("path", "content")


def resolve(wanted: DataFrame, listing: DataFrame, media_root: str, marker: str) -> DataFrame:
    """Which file a media URI means: below the media root, below the marker folder, or there without the marker's name;
    the first that exists. ``wanted``: uri; ``listing``: path."""
    name = marker.rstrip("/").rsplit("/", 1)[-1]
    bare = F.regexp_replace("uri", f"^{name}/", "")
    options = F.array(F.concat(F.lit(f"{media_root}/"), "uri"), F.concat(F.lit(f"{marker}/"), "uri"), F.concat(F.lit(f"{marker}/"), bare))
    rows = wanted.select("uri", F.posexplode(options).alias("rank", "path"))
    return rows.join(listing.select("path"), "path").groupBy("uri").agg(F.min_by("path", "rank").alias("path"))


def dimensions(content: Column) -> Column:
    """struct<width, height> from the header of a PNG, GIF, JPEG or WebP; null for others."""

    @F.pandas_udf("struct<width:int,height:int>")
    def apply(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([size_of(b) or (None, None) for b in blobs], columns=["width", "height"]).astype("Int32")

    return apply(content)


def size_of(b: bytes | None) -> tuple[int, int] | None:
    """Width and height by the public file formats."""
    if not b or len(b) < 10:
        return None
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little")
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        if b[12:16] == b"VP8X":
            return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
        if b[12:16] == b"VP8L":
            bits = int.from_bytes(b[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if b[12:16] == b"VP8 ":
            return int.from_bytes(b[26:28], "little") & 0x3FFF, int.from_bytes(b[28:30], "little") & 0x3FFF
    if b[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(b):
            if b[i] != 0xFF:
                i += 1
                continue
            kind = b[i + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[i + 7 : i + 9], "big"), int.from_bytes(b[i + 5 : i + 7], "big")
            i += 1 if kind == 0xFF else 2 if kind in (0x01, *range(0xD0, 0xD9)) else 2 + int.from_bytes(b[i + 2 : i + 4], "big")
    return None
