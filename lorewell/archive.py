"""An archive: versioned tables below one folder, written by idempotent imports and read as DataFrames.

``root/tables/<table>/v<n>-<id>`` are immutable; ``root/manifest-<n>.json`` names each table's folders. An import of rows that
are only added writes the new rows into a folder of its own, and their tokens beside them; after ``FOLDERS`` such
folders a table is written anew as one. Folder names are never used twice, so what an import that died left behind is
in nobody's way. The highest manifest is the archive's state, so an import shows completely or not at all, readers keep what they opened, and every earlier
state is a backup. Manifests are created, never overwritten: of two writers at a time one fails and starts again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell import schema
from lorewell.functions import ids
from lorewell.functions.text import tokens
from lorewell.operators import people, threads, writes
from lorewell.plans import search
from lorewell.session import ship_package, written
from lorewell.sources import chat_export, meta, tracker, vault
from lorewell.sources.detect import Source, detect

FOLDERS = 16  # of a table, until it is written anew as one
STAGES = {"dyi": meta.stage, "secure": meta.stage, "teams": chat_export.stage, "tracker": tracker.stage}


class Archive:
    """Opens (or creates) the archive at ``root``, a path of any file system Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        ship_package(spark)
        self.spark, self.root = spark, str(root).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(path):
            self._fs.mkdirs(path)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # --- states

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max([int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/manifest-{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _read(self, name: str, paths: list[str] | str | None) -> DataFrame | None:
        """The folders of a table as one; those partitioned by platform have different roots, so they are united."""
        if not paths:
            return None
        full = [f"{self.root}/{p}" for p in ([paths] if isinstance(paths, str) else paths)]
        # with the schema given: a folder of no rows has no file to tell it
        columns = schema.TABLES["messages"].columns + ", tok array<string>" if name == "messages_idx" else schema.TABLES[name].columns
        parts = [self.spark.read.schema(columns).parquet(p) for p in full] if name in ("messages", "messages_idx") else [self.spark.read.schema(columns).parquet(*full)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def table(self, name: str, version: int | None = None) -> DataFrame:
        found = self._read(name, self.manifest(version).get(name))
        return schema.empty(self.spark, name) if found is None else found

    def _write(self, name: str, rows: DataFrame, version: int) -> str:
        path = f"tables/{name}/v{version}-{uuid.uuid4().hex[:12]}"
        if name in ("messages", "messages_idx"):
            # pruned by platform, and by thread and time through the row groups' ranges
            rows.sortWithinPartitions("channel_id", "timestamp").write.partitionBy("platform").parquet(f"{self.root}/{path}")
        else:
            rows.write.parquet(f"{self.root}/{path}")
        return path

    def commit(self, tables: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> int:
        """Makes the tables' next states the archive's: ``tables`` are written whole, ``added`` are new rows of theirs."""
        version = self.version() + 1
        state = self.manifest(version - 1)
        for name, rows in (added or {}).items():
            old = state.get(name) or []
            old = [old] if isinstance(old, str) else old
            if len(old) >= FOLDERS:
                tables = tables | {name: self.table(name, version - 1).unionByName(rows)}
                continue
            state[name] = [*old, self._write(name, rows, version)]
            if name == "messages":
                new = self._read(name, state[name][-1:])
                if not new.isEmpty():
                    state["messages_idx"] = [*state.get("messages_idx", []), self._write("messages_idx", new.withColumn("tok", tokens(F.col("text"))), version)]
                else:
                    state[name] = old
        for name, rows in tables.items():
            state[name] = [self._write(name, rows, version)]
            if name == "messages":
                state["messages_idx"] = [self._write("messages_idx", self._read(name, state[name]).withColumn("tok", tokens(F.col("text"))), version)]
        out = self._fs.create(self._path(f"{self.root}/manifest-{version}.json"), False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        return version

    # --- imports

    def ingest(self, path: str | Path) -> Iterator[dict]:
        """Imports all exports at a path; yields what happens: detected, done for each source, or error."""
        sources = detect(path)
        yield {"event": "detected", "sources": [f"{s.kind}: {s.path}" for s in sources]}
        for source in sources:
            yield {"event": "done", "source": str(source.path), **self.ingest_source(source)}

    def ingest_source(self, source: Source) -> dict:
        began = int(time.time() * 1000)
        run = (self.table("ingest_log").agg(F.max("run_id")).first()[0] or 0) + 1
        stats = {"msgs_seen": 0, "new_msgs": 0, "dup_msgs": 0, "skipped_notices": 0}
        try:
            staged = STAGES[source.kind](self.spark, source)
            tables, added = self._next(source, staged)
            if "messages" in staged:
                clash = ids.collisions(staged["messages"].select("message_id", "source_key").where("source_key IS NOT NULL"), "message_id", "source_key").first()
                if clash is not None:
                    raise ValueError(f"one id stands for several messages: {clash[0]}")
            if source.kind == "tracker" and "_blobs" in staged:
                vault.put_blobs(staged["_blobs"], staged["attachments"], f"{self.root}/media")
            stats |= {"msgs_seen": staged["messages"].count(), "skipped_notices": staged["_notices"].count() if "_notices" in staged else 0}
            if "messages" in added:
                added["messages"] = written(added["messages"], "new")  # they are counted and written from it
                stats["new_msgs"] = added["messages"].count()
            stats["dup_msgs"] = stats["msgs_seen"] - stats["new_msgs"]
        except Exception as e:
            self._log(run, began, source, stats, "failed", str(e)[:500])
            raise
        row = self._log_row(run, began, source, stats, "ok", None)
        try:
            self.commit(tables, added | {"ingest_log": row})
        except Exception as e:
            self._log(run, began, source, stats | {"new_msgs": 0, "dup_msgs": 0}, "failed", str(e)[:500])
            raise
        return {"run_id": run} | stats

    def _log_row(self, run, began, source, stats, status, error) -> DataFrame:
        row = (run, began, int(time.time() * 1000), source.kind, str(source.path), stats["msgs_seen"], stats["new_msgs"], stats["dup_msgs"], stats["skipped_notices"], status, error)
        return self.spark.createDataFrame([row], schema.TABLES["ingest_log"].columns)

    def _log(self, run, began, source, stats, status, error) -> None:
        self.commit({}, {"ingest_log": self._log_row(run, began, source, stats, status, error)})

    def _next(self, source: Source, staged: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """The tables' next states by each table's way of writing: those written whole, and rows that are only added."""
        out, added = {}, {}
        for name, rows in staged.items():
            if name.startswith("_"):
                continue
            spec, old = schema.TABLES[name], self.table(name)
            if name == "attachments" and "_blobs" in staged:
                rows = tracker.recovered(rows, staged["_blobs"])
            order = [c for c in ("file", "ordinal") if c in rows.columns] or list(spec.keys)
            keys = list(spec.keys)
            if source.kind == "tracker" and name == "message_embeds":
                new = schema.shaped(rows, name)
                added[name] = new.join(old, ["message_id", "json"], "left_anti").select(*new.columns)
            elif source.kind == "tracker" and name == "message_reactions":
                new = schema.shaped(rows, name)
                added[name] = (writes.absent_null_safe(new, old, ["message_id", "emoji_id", "emoji_name", "emoji_flags"])).select(*new.columns)
            elif spec.write == "append" or source.kind == "tracker":
                first = writes.append_new(old, rows, keys, order)
                added[name] = schema.shaped(first, name)
            elif spec.write == "upsert":
                new = schema.shaped(writes.first_wins(rows, keys, order), name)
                out[name] = writes.upsert(old, new, keys, [c for c in new.columns if c not in keys], list(spec.keep_old))
            else:
                out[name] = writes.replace_children(old, schema.shaped(rows, name), keys[0])
        return out, added

    def purge_notices(self) -> int:
        """Removes reaction notices that nothing hangs on, and the rows that belong to them; says how many."""
        m = self.table("messages")
        gone = writes.notices(m, self.table("message_attachments"), self.table("message_embeds"), self.table("message_reactions")).cache()
        n = gone.count()
        if n:
            self.commit({t: self.table(t).join(gone, "message_id", "left_anti") for t in ("messages", "message_reaction_actors", "message_replied_to")})
        gone.unpersist()
        return n

    # --- reading

    def describe(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in ("messages", "channels", "users", "people")}

    def _rows(self) -> DataFrame:
        return self.table("messages").withColumn("row_id", F.col("message_id"))

    def threads(self, platform: str | None = None, q: str | None = None) -> DataFrame:
        channels = self.table("channels").join(self.table("servers").select(F.col("id").alias("server"), F.col("type").alias("kind")), "server", "left")
        return threads.thread_list(self._rows(), channels, platform, q)

    def messages(self, channel_id: int, **cursor) -> DataFrame:
        return threads.page(self._rows(), channel_id, **cursor)

    def search(self, text: str, lexicon: DataFrame | None = None, **scope) -> DataFrame:
        return search.search(self._indexed(), text, lexicon, **scope)

    def searched(self, text: str, lexicon: DataFrame | None = None, limit: int = 60, offset: int = 0, **scope) -> search.Result:
        """A page of hits with the total, how the query was read, and what it was widened to."""
        return search.searched(self._indexed(), text, lexicon, limit, offset, **scope)

    def _indexed(self) -> DataFrame:
        rows = self._read("messages_idx", self.manifest().get("messages_idx"))
        return (search.index(self.table("messages")) if rows is None else rows).withColumn("row_id", F.col("message_id"))

    def months(self, channels: list[int], q: str | None = None, lexicon: DataFrame | None = None) -> DataFrame:
        """Messages a month of chosen threads, or of a search's hits in them."""
        rows = self.search(q, lexicon, channels=channels) if q else self._rows().where(F.col("channel_id").isin(channels))
        return threads.months(rows, self.table("users"), self.table("people"), [])

    def people(self) -> DataFrame:
        return people.summary(self.table("users"), self.table("people"), self.table("messages"))

    def link(self, ids: list[int], person_id: int | None) -> None:
        self.commit({"users": people.link(self.table("people"), self.table("users"), ids, person_id)})

    def create_person(self, display: str, is_self: bool = False) -> int:
        rows, person_id = people.create(self.table("people"), display, is_self)
        self.commit({"people": rows})
        return person_id

    def update_person(self, person_id: int, display: str | None = None, is_self: bool | None = None, notes: str | None = None) -> None:
        self.commit({"people": people.update(self.table("people"), person_id, display, is_self, notes)})

    def delete_person(self, person_id: int) -> None:
        rows, users = people.delete(self.table("people"), self.table("users"), person_id)
        self.commit({"people": rows, "users": users})

    def unlink(self, ids: list[int]) -> None:
        """Takes accounts from whatever person they are given to."""
        self.link(ids, None)

    def page(self, channel_id: int, limit: int = 60, **cursor) -> dict:
        """A page of a thread with all that hangs on its messages: rows (oldest first), whether there are more, and the
        cursor that goes on from it."""
        rows = threads.page(self._rows(), channel_id, limit=limit + 1, **cursor)
        found = threads.adorned(
            threads.decorated(rows, self._rows(), self.table("message_replied_to"), self.table("users"), self.table("people")),
            self.table("message_attachments"), self.table("attachments"), self.table("message_reactions"), self.table("message_reaction_actors"), self.table("message_embeds"), self.table("users"), self.table("people"),
        ).collect()  # fmt: skip  # a page
        found = sorted((r.asDict(recursive=True) for r in found), key=lambda r: (r["timestamp"], r["row_id"]))
        more = len(found) > limit
        if more:
            found = found[1:] if "after" not in cursor else found[:limit]
        ends = [(r["timestamp"], r["row_id"]) for r in found]
        return {"rows": found, "more": more, "before": ends[0] if ends else None, "after": ends[-1] if ends else None}
