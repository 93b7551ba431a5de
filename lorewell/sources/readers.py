"""Python data sources: members of uncompressed tars by byte range, and tables of SQLite files by rowid range."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Members(InputPartition):
    def __init__(self, members: list[tuple[str, int, int]]):
        self.members = members


class TarReader(DataSourceReader):
    """The tar is indexed once; tasks seek to their members, nothing is unpacked."""

    def __init__(self, options: dict):
        self.path, self.per_task = options["path"], int(options.get("bytespertask", 64 << 20))
        self.pattern = options.get("pattern", "")

    def partitions(self) -> list[_Members]:
        import re
        import tarfile

        groups, size = [[]], 0
        with tarfile.open(self.path, "r:") as tar:
            for m in tar:
                name = m.name.lstrip("./")
                if not m.isfile() or (self.pattern and not re.search(self.pattern, name)):
                    continue
                if size and size + m.size > self.per_task:
                    groups.append([])
                    size = 0
                groups[-1].append((name, m.offset_data, m.size))
                size += m.size
        return [_Members(g) for g in groups]

    def read(self, partition: _Members) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            for name, offset, size in partition.members:
                f.seek(offset)
                yield name, size, f.read(size)


class TarSource(DataSource):
    """``spark.read.format("tar_members").option("path", p)``: name, size, content."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "name string, size bigint, content binary"

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options)


#: Strings, brackets and what parts members: all a scan for places needs.
_MARKS = rb'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{},:]'


def top_members(data, begin: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of the members of the JSON object at ``begin`` of a buffer, in order, without building any."""
    import json
    import re

    depth, name, start, text = 0, None, 0, None
    for m in re.compile(_MARKS, re.DOTALL).finditer(data, begin, len(data) if end is None else end):
        c = m.group()
        if c[:1] == b'"':
            text = c if depth == 1 and name is None else text
        elif c in b"[{":
            depth += 1
        elif c == b":" and depth == 1 and name is None:
            name, start = json.loads(text), m.end()
        elif (c == b"," and depth == 1) or (c in b"]}" and depth == 1):
            if name is not None:
                yield name, start, m.start()
            name = None
            if c != b",":
                return
        elif c in b"]}":
            depth -= 1


def items_of(data, begin: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the items of the JSON array that lies in ``begin``..``end`` of a buffer."""
    import re

    out, depth, start = [], 0, 0
    for m in re.compile(_MARKS, re.DOTALL).finditer(data, begin, end):
        c = m.group()
        if c in (b"[", b"{"):
            depth += 1
            if depth == 1:
                start = m.end()
        elif (c == b"," and depth == 1) or (c in (b"]", b"}") and depth == 1):
            if data[start : m.start()].strip():
                out.append((start, m.start()))
            start = m.end()
            if c != b",":
                break
        elif c in (b"]", b"}"):
            depth -= 1
    return out


class _Talks(InputPartition):
    def __init__(self, talks: list[tuple[int, int, int]]):
        self.talks = talks


class IndexReader(DataSourceReader):
    """Conversations of a JSON index, in a file or an uncompressed tar: places are found by one scan over a mapped file,
    tasks read theirs and give a row a message. No more than a conversation is held at a time, however large the index."""

    def __init__(self, options: dict):
        self.path, self.member, self.per_task = options["path"], options.get("member", ""), int(options.get("bytespertask", 64 << 20))

    def partitions(self) -> list[_Talks]:
        import mmap
        import tarfile

        begin, size = 0, None
        if self.member:
            with tarfile.open(self.path, "r:") as tar:
                found = [m for m in tar if m.isfile() and m.name.lstrip("./") == self.member]
            begin, size = found[-1].offset_data, found[-1].size
        with open(self.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            end = len(data) if size is None else begin + size
            spans = {name: (a, b) for name, a, b in top_members(data, begin, end)}
            if "conversations" not in spans:
                raise ValueError(f"{self.path} has no conversations")
            talks = items_of(data, *spans["conversations"])
        groups, held = [[]], 0
        for i, (a, b) in enumerate(talks):
            if held and held + b - a > self.per_task:
                groups.append([])
                held = 0
            groups[-1].append((i, a, b))
            held += b - a
        return [_Talks(g) for g in groups]

    def read(self, partition: _Talks) -> Iterator[tuple]:
        import json

        with open(self.path, "rb") as f:
            for ordinal, a, b in partition.talks:
                f.seek(a)
                talk = json.loads(f.read(b - a))
                if not isinstance(talk, dict):
                    continue
                messages = talk.pop("MessageList", None)
                head = json.dumps(talk, ensure_ascii=False)
                for i, message in enumerate([messages] if isinstance(messages, dict) else messages or []):
                    yield ordinal, head, i, json.dumps(message, ensure_ascii=False)


class IndexSource(DataSource):
    """``spark.read.format("chat_index").option("path", p)``: conversation_ordinal, head, ordinal, message (JSON text)."""

    @classmethod
    def name(cls) -> str:
        return "chat_index"

    def schema(self) -> str:
        return "conversation_ordinal int, head string, ordinal int, message string"

    def reader(self, schema: StructType) -> IndexReader:
        return IndexReader(self.options)


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """A table in ranges of rowid. Columns that the file doesn't have are null."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rowspertask", 100_000))
        self.columns = [(f.name, f.dataType.typeName()) for f in schema.fields]

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[_Rows]:
        con = self._connect()
        try:
            if not con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (self.table,)).fetchone():
                return [_Rows(0, -1)]
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        finally:
            con.close()
        return [_Rows(0, -1)] if low is None else [_Rows(a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        if partition.high < partition.low:
            return
        con = self._connect()
        try:
            there = {r[1] for r in con.execute(f'PRAGMA table_info("{self.table}")')}
            wanted = ", ".join(f'"{c}"' if c in there else f'NULL AS "{c}"' for c, _ in self.columns)
            for row in con.execute(f'SELECT {wanted} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high)):
                yield tuple(None if v is None else str(v) if kind == "string" else bytes(v) if kind == "binary" else int(v) for v, (_, kind) in zip(row, self.columns))
        finally:
            con.close()


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").schema(s).option("path", p).option("table", t)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarSource)
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(IndexSource)
