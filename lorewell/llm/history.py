"""New batches against all history: exact and near duplicates without reading the history again.

Every row has a few 64-bit keys: hashes of its ids, of its text at its second within the hour, and of the winnowed
fingerprints of its content (scoped by channel, sender and minute). ``History.append`` takes ONE new batch. It
fingerprints the batch's rows only, sorts their keys by partition and key, and the task of a partition streams over
them: it

1. tests the keys against the partition's Bloom filters (one block for each row group of a store segment, over the
   group's range of keys),
2. looks up the positives, and only those, in the partition's fingerprint store: a row group is read only if its own
   block has a positive key,
3. links rows that share a key, within the batch and with history, and
4. writes the batch's segment of store and Bloom blocks.

Links by content are then verified: equal words need nothing more; for the others the words of both rows are looked up
by row_id in a second store of the same form and must say the same (``same_text``). Segments are merged by level
(``FAN`` of one level become one of the next), so a key is looked up in few segments however many batches there were.

The state is what the newest ``manifest-<n>.json`` below the root lists: segments, links, letter counts (kept up to
date batch by batch). Tasks write files under names of their own and the manifest names those of the tasks that
counted, so a lost executor, a task run twice or a driver that dies leaves files that nobody reads, and a history can
be opened again in another session. A task holds one chunk and the rows of one key at a time; exact copies are reduced
to their first row before anything is shuffled by key, so a message that came a million times costs one row.

Defined results: rows with a null scope column are not compared; a null text says the same as another blank one; a
null timestamp has only id keys; rows that are there twice under one row_id count once; an empty batch adds nothing.
"""

from __future__ import annotations

import html
import json
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import regex
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.garbled import Restorer, fit_letters, local_restorer
from lorewell.llm.graph import components
from lorewell.session import drop_path, scratch_path, written

SHINGLE, WINDOW = 2, 12  # words of a fingerprint, and fingerprints of which the least is kept
LONG = 12  # letters from which a run without spaces counts as several words
NEAR_MS, HOUR_MS, DAY_MS, MINUTE_MS = 2_000, 3_600_000, 86_400_000, 60_000
BY_ID, BY_SOURCE, BY_HOUR, BY_CONTENT = range(4)

_TAG = regex.compile(r"</?[A-Za-z][^<>]{0,400}>")
_TOKEN = regex.compile(r"[\p{L}\p{N}�\x01]+")
_PLAIN = str.maketrans({"ł": "l", "đ": "d", "ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "þ": "th", "ð": "d"})
_REMARK = regex.compile(r"(?<=\S\s)(?=(?:\([^()]{1,40}\)|\*\s?\p{L}+)\s*$)")  # "(sorry, typo)", "*edited": added, not cut off
_ADDED = "\x01"


@lru_cache(maxsize=50_000)
def _folded(token: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", token.casefold()) if not unicodedata.combining(c)).translate(_PLAIN)


class Normaliser:
    """A text to what it says: encoding restored, markup, case, accents, punctuation, spacing and emoji taken off."""

    def __init__(self, restorer: Restorer):
        self.restorer = restorer

    def __call__(self, text: str | None) -> tuple[str, bool]:
        """The words, one space between; and if the encoding was damaged."""
        if not text or text.isspace():
            return "", False
        damaged = False
        if not text.isascii() or "&" in text or "\\u" in text:
            text, pair = self.restorer.restore(text)
            damaged = pair is not None
        if "<" in text:
            text = _TAG.sub(" ", text)
        if "&" in text:
            text = html.unescape(text)
        if text.rstrip()[-1:] == ")" or "*" in text:
            text = _REMARK.sub(_ADDED, text, count=1)
        if text.isascii():
            words = " ".join(_TOKEN.findall(text.lower()))
        else:
            words = " ".join(_TOKEN.findall(" ".join(map(_folded, text.split()))))
        if not words:  # emoji only: they are what it says
            words = "".join(c for c in text if ord(c) > 0x2000 and not c.isspace() and c not in "️​⁠﻿‌‍")[:1]
        return words, damaged


@lru_cache(maxsize=50_000)
def _hash(unit: str) -> int:
    return xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass"))


def winnowed(words: str) -> list[int]:
    """Fingerprints of a normalised text: its numbers, how it begins, and the least shingle hash of every window."""
    units = words.split()
    out = {_hash("#" + " ".join(u for u in units if u.isdigit())), _hash("^" + words.replace(" ", "")[:6])}
    if any(len(u) > LONG for u in units):  # scripts without spaces
        units = [u[i : i + 4] for u in units for i in range(0, max(1, len(u) - 3), 1 if len(u) > LONG else LONG)]
    hashes = [_hash(a) * 31 + _hash(b) & 0xFFFFFFFFFFFFFFFF for a, b in zip(units, units[1:])]
    for i in range(0, max(1, len(hashes) - WINDOW + 1)) if hashes else ():
        out.add(min(hashes[i : i + WINDOW]))
    return sorted(map(_signed, out))


def _distance(a: str, b: str, most: int) -> int:
    """Edits (a swap of neighbours is one) between two texts, or ``most`` + 1; U+FFFD equals anything."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = 0 if x == y or "�" in (x, y) else 1
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + cost)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def same_text(a: str, b: str, damaged: bool = False) -> bool:
    """Whether two normalised texts say the same: equal, or one is the other cut off, or a letter or two differ."""
    s, t = a.replace(" ", ""), b.replace(" ", "")
    if s == t:
        return True
    if not s or not t:
        return False
    if len(s) > len(t):
        s, t, a, b = t, s, b, a
    if (_ADDED in s) != (_ADDED in t):
        return False
    if len(s) >= 6 and len(s) >= 0.4 * len(t) and t.startswith(s):
        return True
    numbers, others = regex.findall(r"\p{N}+", a), regex.findall(r"\p{N}+", b)
    if damaged:
        if numbers == others and _distance(s, t, max(2, len(t) // 4)) <= max(2, len(t) // 4):
            return True
        head = t[: len(s)]
        return len(s) >= 10 and numbers == others[: len(numbers)] and _distance(s, head, 2) <= 2
    if numbers != others:
        # a cut end with a typo before it
        return len(s) >= 16 and len(s) >= 0.4 * len(t) and numbers == regex.findall(r"\p{N}+", t[: len(s)]) and _distance(s, t[: len(s)], 2) <= 2
    if len(s) < 4:
        return False
    left, right = a.split(), b.split()
    if len(left) == len(right):
        # the same words but for letters: a word as a whole may not change
        edits = 0
        for x, y in zip(left, right):
            if x != y:
                d = _distance(x, y, 2)
                if d > 2 or d >= max(len(x), len(y)) - 1 or (x.isdigit() or y.isdigit()):
                    return False
                edits += d
        return edits <= 2
    most = 1 if len(s) < 10 else 2
    return _distance(s, t, most) <= most or (len(s) >= 16 and len(s) >= 0.4 * len(t) and _distance(s, t[: len(s)], 2) <= 2)


# --- keys


def fingerprinted(rows: DataFrame, counts) -> DataFrame:
    """Rows with their words and keys. ``counts``: the letter model's broadcast.

    Exact copies in a partition of the input get ``copy_of`` (the row_id of the first seen) and no keys, so of a
    message that came very often only one row a partition is shuffled by key.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norm = Normaliser(local_restorer(counts.value))
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        for batch in batches:
            rows = list(zip(batch["run_id"].tolist(), batch["row_id"].tolist()))
            first = [seen.setdefault(k, r) for k, r in zip(zip(batch["h"].tolist(), batch["g"].tolist()), rows)]
            batch["copy_run"] = pd.array([None if c == r else c[0] for c, r in zip(first, rows)], dtype="Int64")
            batch["copy_of"] = pd.array([None if c == r else c[1] for c, r in zip(first, rows)], dtype="Int64")
            codes, distinct = pd.factorize(batch["text"], use_na_sentinel=True)
            done = [norm(t) for t in distinct] + [("", False)]
            prints = [winnowed(w) for w, _ in done]
            hashes = [_hash(w) & 0x7FFFFFFF for w, _ in done]
            batch["words"] = [done[c][0] for c in codes]
            batch["damaged"] = [done[c][1] for c in codes]
            batch["wh"] = [hashes[c] for c in codes]
            batch["fps"] = [prints[c] for c in codes]
            yield batch.drop(columns=["text", "h", "g"])

    ids = ["channel_id", "sender_id", "message_id", "source_key", "ts"]
    # hashes of null are 0: a column of long integers with gaps would lose digits on its way through pandas
    every = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in [*ids, "text"]]
    hashed = rows.select("row_id", F.col("run_id").cast("bigint").alias("run_id"), F.xxhash64("channel_id", "sender_id").alias("scope"), "ts",
                         *[F.when(F.col(c).isNotNull(), F.xxhash64(c)).otherwise(F.lit(0)).alias(n) for c, n in (("message_id", "m"), ("source_key", "s"), ("text", "t"))],
                         F.xxhash64(*every).alias("h"), F.xxhash64(F.lit(7), *reversed(every)).alias("g"), "text")
    out = hashed.mapInPandas(apply, "row_id bigint, run_id bigint, scope bigint, ts bigint, m bigint, s bigint, t bigint, copy_run bigint, copy_of bigint, words string, damaged boolean, wh int, fps array<bigint>")
    return out.select("row_id", "run_id", "copy_run", "copy_of", "ts", F.col("t").bitwiseAND(0x7FFFFFFF).cast("int").alias("th"), "words", "damaged", "wh", F.when(F.col("copy_of").isNull(), _keys()).alias("keys"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys():
    """Every key of a row; the two lowest bits of a key say what it is of."""
    tag = lambda h, kind: h.bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(kind).cast("bigint"))
    none = F.array().cast("array<bigint>")
    minute = F.floor(F.col("ts") / MINUTE_MS)
    edge = F.pmod(F.col("ts"), F.lit(MINUTE_MS)) < NEAR_MS
    return F.array_distinct(F.concat(
        F.when(F.col("m") != 0, F.array(tag(F.xxhash64("scope", F.lit(0), "m"), BY_ID))).otherwise(none),
        F.when(F.col("s") != 0, F.array(tag(F.xxhash64("scope", F.lit(1), "s"), BY_SOURCE))).otherwise(none),
        F.when(F.col("ts").isNotNull() & (F.col("t") != 0), F.array(tag(F.xxhash64("scope", F.lit(2), F.pmod("ts", F.lit(HOUR_MS)), "t"), BY_HOUR))).otherwise(none),
        F.when(F.col("ts").isNotNull(), F.transform("fps", lambda f: tag(F.xxhash64("scope", minute, f), BY_CONTENT))).otherwise(none),
        # near the start of a minute a row also stands in the minute before
        F.when(edge, F.transform("fps", lambda f: tag(F.xxhash64("scope", minute - 1, f), BY_CONTENT))).otherwise(none),
    ))


def keyed(prints: DataFrame) -> DataFrame:
    """(key, row_id, run, ts, th, wh): every key of every row that is no copy; th and wh are hashes of text and words."""
    return prints.where("copy_of IS NULL").select(F.explode("keys").alias("key"), "row_id", F.col("run_id").alias("run"), F.coalesce("ts", F.lit(0)).alias("ts"), F.coalesce("th", F.lit(0)).alias("th"), "wh")


# --- Bloom filters and store

GROUP, FAN = 8_192, 8  # rows of a row group; segments of a level that are merged
_BITS = 12
_PROBES = 6


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    k = keys.view(np.uint64)
    a = (k ^ (k >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    b = ((k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    i = np.arange(_PROBES, dtype=np.uint64)[:, None]
    return (a[None, :] + i * b[None, :]) % np.uint64(bits)


def bloom_of(keys: np.ndarray) -> np.ndarray:
    """A Bloom segment of distinct keys: ``_BITS`` bits a key."""
    bits = max(64, len(keys) * _BITS)
    flags = np.zeros(bits, dtype=bool)
    flags[_places(keys, bits).ravel().astype(np.int64)] = True
    return np.concatenate([np.array([bits], dtype="<u8").view(np.uint8), np.packbits(flags)])


def bloom_has(segment: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(segment[:8].view("<u8")[0])
    packed = segment[8:]
    at = _places(keys, bits)
    return ((packed[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=0)


def _filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


class _Writer:
    """Writes the segment of one partition: rows sorted by key in row groups, and a Bloom block for each group."""

    def __init__(self, files: pafs.FileSystem, path: str, size: int):
        self.files, self.path, self.size, self.held, self.rows, self.blocks, self.out = files, path, size, [], 0, [], None
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)

    def add(self, frame: pd.DataFrame) -> None:
        self.held.append(frame)
        self.rows += len(frame)
        if self.rows >= self.size:
            whole = pd.concat(self.held, ignore_index=True)
            n = self.rows // self.size * self.size
            for i in range(0, n, self.size):
                self._group(whole.iloc[i : i + self.size])
            self.held, self.rows = [whole.iloc[n:]], self.rows - n

    def _group(self, frame: pd.DataFrame) -> None:
        batch = pa.Table.from_pandas(frame, preserve_index=False)
        if self.out is None:
            self.sink = self.files.open_output_stream(self.path)
            delta = {c: "DELTA_BINARY_PACKED" for c in ("row_id", "run", "ts") if c in batch.schema.names}
            self.out = pq.ParquetWriter(self.sink, batch.schema, compression="zstd", use_dictionary=False, column_encoding=delta or None)
        self.out.write_table(batch.cast(self.out.schema), row_group_size=self.size)
        keys = np.unique(frame["key"].to_numpy())
        self.blocks.append((int(keys[0]), int(keys[-1]), bloom_of(keys)))

    def close(self) -> str | None:
        if self.rows:
            self._group(pd.concat(self.held, ignore_index=True))
        if self.out is None:
            return None
        self.out.close()
        self.sink.close()
        with self.files.open_output_stream(f"{self.path}.bloom") as out:
            head = np.array([[lo, hi, len(b)] for lo, hi, b in self.blocks], dtype="<i8")
            out.write(np.array([len(head)], dtype="<i8").tobytes() + head.tobytes() + b"".join(b.tobytes() for _, _, b in self.blocks))
        return self.path


class _Reader:
    """Looks keys up in the segment of one partition. ``read``: how many rows were read for it."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.files, self.path, self.file, self.read, self.last = files, path, None, 0, (None, None)
        with files.open_input_stream(f"{path}.bloom") as f:
            raw = f.read()
        n = int(np.frombuffer(raw[:8], dtype="<i8")[0])
        head = np.frombuffer(raw[8 : 8 + 24 * n], dtype="<i8").reshape(n, 3)
        self.lo, self.hi = head[:, 0], head[:, 1]
        ends = 8 + 24 * n + np.cumsum(head[:, 2])
        self.blocks = [np.frombuffer(raw[e - s : e], dtype=np.uint8) for e, s in zip(ends.tolist(), head[:, 2].tolist())]

    def find(self, keys: np.ndarray) -> list[pa.Table]:
        """The rows of sorted, distinct keys."""
        out = []
        for g in range(int(np.searchsorted(self.hi, keys[0])), int(np.searchsorted(self.lo, keys[-1], side="right"))):
            own = keys[np.searchsorted(keys, self.lo[g]) : np.searchsorted(keys, self.hi[g], side="right")]
            if len(own):
                own = own[bloom_has(self.blocks[g], own)]
            if len(own):
                if self.last[0] != g:
                    self.file = self.file or pq.ParquetFile(self.path, filesystem=self.files)
                    self.last = (g, self.file.read_row_group(g))
                    self.read += self.last[1].num_rows
                rows = self.last[1]
                at = np.minimum(np.searchsorted(own, k := rows["key"].to_numpy()), len(own) - 1)
                out.append(rows.filter(pa.array(own[at] == k)))
        return [x for x in out if x.num_rows]


def _whole_keys(chunks: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Sorted rows in frames that hold whole keys of one partition."""
    rest = None
    for chunk in chunks:
        df = chunk if rest is None or not len(rest) else pd.concat([rest, chunk], ignore_index=True)
        if not len(df):
            continue
        part, key = df["part"].to_numpy(), df["key"].to_numpy()
        cut = int(np.flatnonzero((part == part[-1]) & (key == key[-1]))[0])
        rest = df.iloc[cut:]
        for p in np.unique(part[:cut]):
            yield int(p), df.iloc[:cut][part[:cut] == p]
    if rest is not None and len(rest):
        yield int(rest["part"].iloc[0]), rest


LINKED = "a_run bigint, a_row bigint, b_run bigint, b_row bigint, kind int, same boolean, part int, file string, read bigint"


class History:
    """The state below ``root``: opened if it is there, else begun with ``parts`` partitions and ``group`` rows in a row group."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 32, group: int = GROUP):
        self.spark, self.root = spark, root.rstrip("/")
        files, base = _filesystem(self.root)
        files.create_dir(base, recursive=True)
        found = sorted(int(x.base_name[9:-5]) for x in files.get_file_info(pafs.FileSelector(base)) if x.base_name.startswith("manifest-") and x.base_name.endswith(".json"))
        self.state = {"batches": 0, "parts": parts, "group": group, "prints": [], "texts": [], "links": [], "letters": None}
        if found:
            with files.open_input_stream(f"{base}/manifest-{found[-1]}.json") as f:
                self.state = json.loads(f.read())
        self.parts = self.state["parts"]
        self.read_rows = 0  # rows of the stores that the last batch had to read

    def _commit(self, state: dict) -> None:
        files, base = _filesystem(self.root)
        path = f"{base}/manifest-{state['batches']}.json"
        if files.get_file_info(path).type != pafs.FileType.NotFound:
            raise RuntimeError(f"another batch was appended meanwhile: {path}")
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(tmp) as out:
            out.write(json.dumps(state).encode())
        files.move(tmp, path)
        self.state = state

    def letters(self, texts: DataFrame) -> np.ndarray:
        """The letter counts of all batches so far and of ``texts``."""
        counts = fit_letters(texts)
        if self.state["letters"]:
            files, base = _filesystem(self.root)
            with files.open_input_stream(f"{base}/{self.state['letters']}") as f:
                counts = counts + np.frombuffer(f.read(), dtype="<f4")
        return counts.astype("float32")

    def append(self, rows: DataFrame) -> DataFrame:
        """Adds one batch. Gives its links (a_run, a_row, b_run, b_row): its rows that say what a row before them says, or in the batch.

        ``rows``: row_id, run_id, channel_id, sender_id, message_id, source_key, timestamp and text.
        """
        spark, state = self.spark, json.loads(json.dumps(self.state))
        stale = [f for kind in ("prints", "texts") for f in self._merged(state[kind], kind)]
        columns = ["row_id", "run_id", "channel_id", "sender_id", "message_id", "source_key", F.col("timestamp").alias("ts"), "text"]
        rows = rows.select(*columns).where("channel_id IS NOT NULL AND sender_id IS NOT NULL AND run_id IS NOT NULL")
        table = self.letters(rows.select("text"))
        prints_path = scratch_path(spark, "prints")
        # small row groups: a writer holds one in memory, beside the Python workers
        fingerprinted(rows, spark.sparkContext.broadcast(table)).write.option("parquet.block.size", 16 << 20).parquet(prints_path)
        prints = spark.read.parquet(prints_path)
        own = prints.where("copy_of IS NULL")
        texts = self._written(own.select(F.col("row_id").alias("key"), "words", "damaged"), "texts")
        state["texts"].append([0, texts])
        linked = written(self._linked(keyed(prints), [x for _, x in state["prints"]]), "linked")
        state["prints"].append([0, {str(r["part"]): r["file"] for r in linked.where("file IS NOT NULL").select("part", "file").collect()}])  # a row a partition
        links = linked.where("file IS NULL")
        ends = ["a_run", "a_row", "b_run", "b_row"]
        sure = links.where((F.col("kind") < BY_CONTENT) | F.col("same")).select(*ends)
        near = links.where((F.col("kind") == BY_CONTENT) & ~F.col("same")).select(*ends).distinct().join(sure.distinct(), ends, "left_anti")
        checked = written(self._same(near, [x for _, x in state["texts"]]), "checked")
        copies = prints.where("copy_of IS NOT NULL").select(F.col("copy_run").alias("a_run"), F.col("copy_of").alias("a_row"), F.col("run_id").alias("b_run"), F.col("row_id").alias("b_row"))
        name = f"links/{uuid.uuid4().hex}"
        sure.unionByName(checked.where("same").select(*ends)).unionByName(copies).distinct().write.parquet(f"{self.root}/{name}")
        self.read_rows = sum(int(x.agg(F.sum("read")).first()[0] or 0) for x in (linked, checked))
        state["links"].append(name)
        state["letters"] = f"letters-{uuid.uuid4().hex}.bin"
        files, base = _filesystem(self.root)
        with files.open_output_stream(f"{base}/{state['letters']}") as out:
            out.write(table.astype("<f4").tobytes())
        state["batches"] += 1
        self._commit(state)
        for path in stale:  # merged into a larger segment, and named by no manifest but older ones
            for f in (path, f"{path}.bloom"):
                files.delete_file(f)
        drop_path(spark, prints_path)
        spark.sparkContext._jvm.System.gc()  # lets go of the batch's shuffles: the next batch needs the room
        return self._links([name])

    def _links(self, names: list[str]) -> DataFrame:
        schema = "a_run bigint, a_row bigint, b_run bigint, b_row bigint"
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def repeats(self) -> DataFrame:
        """(row_id_a, row_id_b): every row so far that repeats a message, and the first arrived row of that message.
        Reads the links, no texts or keys."""
        node = lambda x: F.struct(F.col(f"{x}_run").alias("run"), F.col(f"{x}_row").alias("row"))
        groups = components(self._links(self.state["links"]).select(node("a").alias("a"), node("b").alias("b")))
        return groups.where("node <> root").select(F.col("root.row").alias("row_id_a"), F.col("node.row").alias("row_id_b"))

    # --- segments

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with ``part``, all of a partition in one task, sorted by key."""
        rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int"))
        order = [c for c in ("part", "key", "ts", "row_id") if c in rows.columns]
        return rows.repartition(min(self.parts, 4096), "part").sortWithinPartitions(*order)

    def _written(self, rows: DataFrame, kind: str) -> dict[str, str]:
        """Writes a segment; its file by partition."""
        root, size = self.root, self.state["group"]

        def apply(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, base = _filesystem(root)
            done, writer, at = [], None, None
            for p, frame in _whole_keys(chunks):
                if p != at:
                    done += [(at, writer.close())] if writer else []
                    writer, at = _Writer(files, f"{base}/{kind}/{p}-{uuid.uuid4().hex}.parquet", size), p
                writer.add(frame.drop(columns="part"))
            done += [(at, writer.close())] if writer else []
            yield pd.DataFrame(done, columns=["part", "file"])

        return {str(r["part"]): r["file"] for r in self._placed(rows).mapInPandas(apply, "part int, file string").collect()}  # a row a partition

    def _merged(self, segments: list, kind: str) -> list[str]:
        """Makes ``FAN`` segments of one level one of the next, as long as there are so many; the files that went into them."""
        level, gone = 0, []
        while any(x[0] >= level for x in segments):
            own = [x for x in segments if x[0] == level]
            if len(own) >= FAN:
                paths = [f for _, files in own for f in files.values()]
                scheme = self.root.split("://")[0] + "://" if "://" in self.root else ""
                merged = self._written(self.spark.read.parquet(*[scheme + p for p in paths]), kind) if paths else {}
                segments[:] = [x for x in segments if x[0] != level] + [[level + 1, merged]]
                gone += paths
            level += 1
        return gone

    def _linked(self, keys: DataFrame, segments: list[dict[str, str]]) -> DataFrame:
        """Links of the batch (``LINKED``), and a row for each partition with its new segment's file."""
        root, size = self.root, self.state["group"]

        def apply(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, base = _filesystem(root)
            writer, at, readers = None, None, []
            names = [x.split()[0] for x in LINKED.split(", ")]

            def close() -> pd.DataFrame:
                row = (None, None, None, None, -1, None, at, writer.close(), sum(r.read for r in readers))
                return pd.DataFrame([row], columns=names)

            for p, frame in _whole_keys(chunks):
                if p != at:
                    if writer:
                        yield close()
                    writer, at = _Writer(files, f"{base}/prints/{p}-{uuid.uuid4().hex}.parquet", size), p
                    readers = [_Reader(files, s[str(p)]) for s in segments if str(p) in s]
                frame = frame.drop(columns="part").drop_duplicates(["key", "row_id"])
                keys, at_key, times = np.unique(frame["key"].to_numpy(), return_inverse=True, return_counts=True)
                found = [t.to_pandas() for r in readers for t in r.find(keys)]
                old = pd.concat(found, ignore_index=True) if found else frame.iloc[:0]
                known = np.isin(keys, old["key"].to_numpy())
                positive = frame[((times > 1) | known)[at_key]]
                if len(positive):
                    yield _links(pd.concat([positive.assign(new=True), old.assign(new=False)], ignore_index=True)).assign(part=None, file=None, read=None)
                writer.add(frame)
            if writer:
                yield close()

        return self._placed(keys).mapInPandas(apply, LINKED)

    def _same(self, pairs: DataFrame, segments: list[dict[str, str]]) -> DataFrame:
        """Pairs with ``same``: whether their words say the same. Words are looked up where they are stored."""
        root = self.root

        def lookup(side: str, last: bool):
            def apply(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                files, _ = _filesystem(root)
                readers, at = [], None
                memo: dict = {}
                for p, frame in _whole_keys(chunks):
                    if p != at:
                        readers, at = [_Reader(files, s[str(p)]) for s in segments if str(p) in s], p
                    before = sum(r.read for r in readers)
                    keys = np.unique(frame["key"].to_numpy())
                    found = pa.concat_tables([t.select(["key", "words", "damaged"]) for r in readers for t in r.find(keys)]).to_pandas().drop_duplicates("key").set_index("key")
                    frame = frame.drop(columns=["part"])
                    frame[f"{side}_words"], frame[f"{side}_damaged"] = (frame["key"].map(found[c]) for c in ("words", "damaged"))
                    frame = frame.drop(columns=["key"])
                    frame["read"] = frame["read"] + np.where(np.arange(len(frame)) == 0, sum(r.read for r in readers) - before, 0)
                    if last:
                        out = []
                        for x in zip(frame["a_words"], frame["b_words"], frame["a_damaged"] | frame["b_damaged"]):
                            if x not in memo:
                                if len(memo) > 50_000:
                                    memo.clear()
                                memo[x] = same_text(*x)
                            out.append(memo[x])
                        frame["same"] = out
                        frame = frame.drop(columns=["a_words", "a_damaged", "b_words", "b_damaged"])
                    yield frame

            return apply

        ends = "a_run bigint, a_row bigint, b_run bigint, b_row bigint, read bigint"
        first = self._placed(pairs.withColumn("read", F.lit(0).cast("bigint")).withColumn("key", F.col("a_row"))).mapInPandas(lookup("a", False), f"{ends}, a_words string, a_damaged boolean")
        return self._placed(first.withColumn("key", F.col("b_row"))).mapInPandas(lookup("b", True), f"{ends}, same boolean")


def _links(both: pd.DataFrame) -> pd.DataFrame:
    """Links among rows that share a key: by id to the first, by hour and content to those near enough in time. Rows of
    the history aren't linked with each other again."""
    out: list[tuple] = []
    kinds = both["key"].to_numpy() & 3
    for kind in range(4):
        own = both[kinds == kind].sort_values(["key", "run", "row_id"] if kind < BY_HOUR else ["key", "ts", "th", "run", "row_id"])
        key, row, run, ts, th, wh, new = (own[c].tolist() for c in ("key", "row_id", "run", "ts", "th", "wh", "new"))

        def link(i: int, j: int) -> None:
            if new[i] or new[j]:
                out.append((run[i], row[i], run[j], row[j], kind, wh[i] == wh[j]))

        heads: list[int] = []  # of a content key, the first row of each moment and text
        first = 0
        for i in range(len(own)):
            if i == 0 or key[i] != key[first]:
                first, heads = i, [i]
            elif kind < BY_HOUR:
                link(first, i)
            elif kind == BY_HOUR:
                if ts[i] - ts[i - 1] < DAY_MS:
                    link(i - 1, i)
            elif ts[i] == ts[heads[-1]] and th[i] == th[heads[-1]]:
                link(heads[-1], i)
            else:
                for j in reversed(heads):
                    if ts[i] - ts[j] > NEAR_MS:
                        break
                    link(j, i)
                heads.append(i)
    return pd.DataFrame(out, columns=["a_run", "a_row", "b_run", "b_row", "kind", "same"])


def repeats(messages: DataFrame, batches: list[list[int]], parts: int = 32, root: str | None = None) -> DataFrame:
    """(row_id_a, row_id_b) after the batches have been appended one by one to the history at ``root`` (a new one if
    none is named). ``batches`` are the run_ids of each batch in order of arrival."""
    history = History(messages.sparkSession, root or scratch_path(messages.sparkSession, "history"), parts)
    for runs in batches:
        history.append(messages.where(F.col("run_id").isin(runs)))
    return history.repeats()
