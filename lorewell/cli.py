"""python -m lorewell.cli ROOT COMMAND ...: ingest PATH | clean | threads | search TEXT | stats | people | history"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.archive import Archive
from lorewell.session import build_session

#: Ids are written as text: readers of JSON lose the last digits of 64-bit numbers.
ID_FIELDS = ("id", "channel_id", "message_id", "sender_id", "user_id", "person_id", "row_id", "main_thread", "replied_to_id")


def id_safe(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast("string").alias(c) if c in ID_FIELDS else F.col(c) for c in rows.columns])


def _print(rows: DataFrame, limit: int) -> None:
    for line in id_safe(rows).limit(limit).toJSON().toLocalIterator():
        print(line)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lorewell", description=__doc__)
    parser.add_argument("root")
    parser.add_argument("command", choices=["ingest", "clean", "threads", "search", "stats", "people", "history", "db"])
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--limit", type=int, default=60)
    args = parser.parse_args(argv)
    archive = Archive(build_session(), args.root)
    if args.command == "ingest":
        for event in archive.ingest(args.argument):
            print(json.dumps(event, ensure_ascii=False))
    elif args.command == "clean":
        print(json.dumps({"purged": archive.purge_notices()}))
    elif args.command == "db":
        print(json.dumps(archive.describe()))
    elif args.command == "threads":
        _print(archive.threads(q=args.argument), args.limit)
    elif args.command == "search":
        _print(archive.search(args.argument or "").orderBy(F.desc("timestamp"), F.desc("message_id")).drop("tok"), args.limit)
    elif args.command == "stats":
        _print(archive.table("messages").groupBy("platform").agg(F.count("*").alias("messages"), F.countDistinct("channel_id").alias("threads")), args.limit)
    elif args.command == "people":
        _print(archive.people(), args.limit)
    else:
        _print(archive.table("ingest_log").orderBy(F.desc("run_id")), args.limit)


if __name__ == "__main__":
    main()
