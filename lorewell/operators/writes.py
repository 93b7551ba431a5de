"""Idempotent writes as plans: each takes the old and the new rows and gives the table's next state or what to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorewell.functions.text import is_notice


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first by ``order``. Rows with a null key are dropped, as a primary key would."""
    w = W.partitionBy(*keys).orderBy(*order)
    present = rows.dropna(subset=keys)
    return present.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def append_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` to append: first of their key, and of a key that ``old`` doesn't have."""
    return first_wins(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], keep_old: list[str] = ()) -> DataFrame:
    """The table with ``new`` written over it: ``columns`` from new, but old values where new has null in ``keep_old``."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(n, keys, "full")
    out = []
    for c in old.columns:
        if c in columns:
            value = F.coalesce(f"_n_{c}", c) if c in keep_old else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c))
            out.append(value.alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of parents in ``new`` are replaced; a parent without new children keeps its old ones."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def absent_null_safe(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` with no row of ``old`` equal on ``keys``, null being equal to null."""
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys]).distinct()
    test: Column = F.lit(True)
    for k in keys:
        test = test & new[k].eqNullSafe(o[f"_o_{k}"])
    return new.join(o, test, "left_anti")


def same_columns(source: DataFrame, target_columns: list[str]) -> tuple[DataFrame, list[str]]:
    """The source cut to the target's columns, and the names that the target doesn't know."""
    shared = [c for c in target_columns if c in source.columns]
    return source.select(*shared), [c for c in source.columns if c not in target_columns]


def dangling(replies: DataFrame, messages: DataFrame) -> DataFrame:
    """Replies to messages that aren't there."""
    return replies.join(messages.select(F.col("message_id").alias("replied_to_id")).distinct(), "replied_to_id", "left_anti").select("message_id", "replied_to_id")


def notices(messages: DataFrame, *children: DataFrame) -> DataFrame:
    """message_ids of reaction notices that nothing hangs on. ``children``: tables with message_id."""
    found = messages.where(is_notice(F.col("text"))).select("message_id").distinct()
    for child in children:
        found = found.join(child.select("message_id").distinct(), "message_id", "left_anti")
    return found


def directory_vote(pairs: DataFrame) -> DataFrame:
    """account -> the name it bears most often; of equals the one seen first. ``pairs``: account, name, ordinal."""
    counted = pairs.where("account IS NOT NULL AND name IS NOT NULL").groupBy("account", "name").agg(F.count("*").alias("votes"), F.min("ordinal").alias("seen"))
    w = W.partitionBy("account").orderBy(F.desc("votes"), "seen", "name")
    return counted.withColumn("n", F.row_number().over(w)).where("n = 1").select("account", "name", "votes")


def name_clashes(directory: DataFrame) -> DataFrame:
    """Names that more than one account bears."""
    return directory.groupBy("name").agg(F.countDistinct("account").alias("accounts")).where("accounts > 1")
