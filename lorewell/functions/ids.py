"""Deterministic ids and source keys."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\x1f"


def mint(parts: list) -> int:
    """A negative 62-bit id from parts; None counts as empty. The same parts give the same id everywhere."""
    raw = SEP.join("" if p is None else str(p) for p in parts).encode("utf-8", "surrogatepass")
    return -((int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big") & ((1 << 62) - 1)) + 1)


def minted(*parts: Column) -> Column:
    """``mint`` over columns, in Arrow batches."""
    joined = F.concat_ws(SEP, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])

    @F.pandas_udf("bigint")
    def apply(raw: pd.Series) -> pd.Series:
        return pd.Series([mint([x]) for x in raw], dtype="int64")

    return apply(joined)


def content_key(platform: str, thread: str, sender: str | None, ts: int | None, content, kind, share, uris: list[str]) -> str:
    """The key of a message from an export without ids: what it is, where, who and when, and a digest of what it says."""
    digest = hashlib.sha1(json.dumps({"c": content, "k": kind, "s": share, "u": uris}, sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()
    return SEP.join([platform, thread, sender or "", "" if ts is None else str(ts), digest])


def chat_key(conversation: Column, message_id: Column) -> Column:
    return F.concat_ws(SEP, F.lit("teams"), conversation, message_id)


def collisions(rows: DataFrame, id_column: str, key_column: str) -> DataFrame:
    """Ids that stand for more than one key: there must be none."""
    return rows.where(F.col(key_column).isNotNull()).groupBy(id_column).agg(F.countDistinct(key_column).alias("keys")).where("keys > 1")
