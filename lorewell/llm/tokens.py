"""Token counts by a public tokenizer, and ranks within groups of any size."""

from __future__ import annotations

import base64
import os
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A parameter of every operator that counts tokens: ranks (.tiktoken) or a tokenizer's description (.json).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level vocabularies given as ranks cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 128  # texts encoded at a time: encodings are many times larger than their texts
_LOADED: dict[str, object] = {}


def _counter(path: str):
    """A function from texts to their numbers of tokens; loaded once a process."""
    if path not in _LOADED:
        if path.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
            encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's tasks share its cores already
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _LOADED[path] = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[path]


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """How many tokens a whole text has; 0 for null and empty text."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        counter, sizes = _counter(path), []
        for i in range(0, len(texts), CHUNK):
            sizes += counter([t or "" for t in texts.iloc[i : i + CHUNK]])
        return pd.Series(sizes, dtype="int64")

    return count(text)


def ranged(rows: DataFrame, group: list[str], order: Column, largest: int, add: Column | None = None, name: str = "rank", per_task: int = 200_000) -> DataFrame:
    """``rows`` with the sum of ``add`` (1 if none) over the rows before them in their group, by the 64-bit hash
    ``order``; ties by all other columns. ``largest``: rows of the largest group, or more.

    A group is cut into ranges of the hash, as many as keep a range near ``per_task`` rows; ranges are summed up
    first, and rows within their range. So a group that holds a third of all rows is spread.
    """
    cuts = max(1, -(-largest // per_task))
    rest = [c for c in rows.columns if c not in group]
    # the hash's upper bits, scaled: ranges are in the order of the hash
    upper = F.shiftright(order, 33) + F.lit(1 << 30)
    rows = rows.withColumn("_h", order).withColumn("_range", F.least(F.lit(cuts - 1), F.floor(upper * cuts / F.lit(1 << 31))).cast("int")).withColumn("_add", F.lit(1) if add is None else add)
    before = W.partitionBy(*group, "_range").orderBy("_h", *rest).rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn(name, F.coalesce(F.sum("_add").over(before), F.lit(0)))
    if cuts > 1:
        sizes = rows.groupBy(*group, "_range").agg(F.sum("_add").alias("_n"))
        sizes = sizes.select(*group, "_range", (F.sum("_n").over(W.partitionBy(*group).orderBy("_range")) - F.col("_n")).alias("_before"))
        numbered = numbered.join(sizes, [*group, "_range"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")
    return numbered.withColumn(name, F.col(name).cast("bigint")).drop("_h", "_range", "_add")


def ranked(rows: DataFrame, group: list[str], order: Column, name: str = "rank", per_task: int = 200_000) -> DataFrame:
    """``rows`` with a 0-based rank within ``group`` by the 64-bit hash ``order``; ties by all other columns."""
    largest = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    return ranged(rows, group, order, largest, None, name, per_task)
