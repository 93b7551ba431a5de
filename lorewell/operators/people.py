"""People and their accounts: summaries, and edits of the mapping as new states of two small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators.threads import named_users


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(F.col("sender_id").alias("id")).agg(F.count("*").alias("messages"))


def identities(users: DataFrame, people: DataFrame, messages: DataFrame) -> DataFrame:
    """Every account with its person and messages."""
    rows = users.select("id", "platform", "name", "display_name", "person_id").join(people.select("person_id", F.col("display").alias("person")), "person_id", "left")
    return rows.join(message_counts(messages), "id", "left").select("id", "platform", "name", "display_name", "person_id", "person", F.coalesce("messages", F.lit(0)).alias("messages"))


def summary(users: DataFrame, people: DataFrame, messages: DataFrame) -> DataFrame:
    """Every person with their accounts and messages."""
    counted = users.where("person_id IS NOT NULL").select("id", "person_id").join(message_counts(messages), "id", "left")
    per = counted.groupBy("person_id").agg(F.countDistinct("id").alias("accounts"), F.sum(F.coalesce("messages", F.lit(0))).alias("messages"))
    return people.select("person_id", "display", "is_self").join(per, "person_id", "left").select("person_id", "display", "is_self", F.coalesce("accounts", F.lit(0)).alias("accounts"), F.coalesce("messages", F.lit(0)).alias("messages"))


def merged_participants(members: DataFrame, users: DataFrame, people: DataFrame, messages: DataFrame) -> DataFrame:
    """A thread's participants by person: accounts of one person count as one."""
    who = named_users(users, people)
    counts = messages.groupBy("channel_id", F.col("sender_id").alias("user_id")).agg(F.count("*").alias("messages"))
    rows = members.join(who, "user_id").join(counts, ["channel_id", "user_id"], "left")
    entity = F.coalesce(F.concat(F.lit("p"), F.col("person_id").cast("string")), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return rows.groupBy("channel_id", entity.alias("entity")).agg(F.min("display").alias("display"), F.count("*").alias("accounts"), F.sum(F.coalesce("messages", F.lit(0))).alias("messages"))


def unmapped(users: DataFrame, q: str | None = None) -> DataFrame:
    rows = users.where("person_id IS NULL")
    if q:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "name", "display_name")), F.lit(q.lower())))
    return rows.select("id", "platform", "name", "display_name")


# --- edits


def _clean(display: str) -> str:
    if not (out := (display or "").strip()):
        raise ValueError("a person needs a name")
    return out


def create(people: DataFrame, display: str, is_self: bool = False, notes: str | None = None) -> tuple[DataFrame, int]:
    """The table with one more person, and their id. Names are unique; the owner is one person."""
    display = _clean(display)
    if people.where(F.col("display") == display).take(1):
        raise ValueError(f"{display!r} is there already")
    person_id = (people.agg(F.max("person_id")).first()[0] or 0) + 1
    if is_self:
        people = people.withColumn("is_self", F.lit(0))
    row = people.sparkSession.createDataFrame([(person_id, display, int(is_self), notes)], "person_id bigint, display string, is_self int, notes string")
    return people.select("person_id", "display", F.col("is_self").cast("int").alias("is_self"), "notes").unionByName(row), person_id


def update(people: DataFrame, person_id: int, display: str | None = None, is_self: bool | None = None, notes: str | None = None) -> DataFrame:
    known(people, person_id)
    this = F.col("person_id") == person_id
    if display is not None:
        display = _clean(display)
        if people.where((F.col("display") == display) & ~this).take(1):
            raise ValueError(f"{display!r} is there already")
        people = people.withColumn("display", F.when(this, F.lit(display)).otherwise(F.col("display")))
    if is_self is not None:
        people = people.withColumn("is_self", F.when(this, F.lit(int(is_self))).otherwise(F.lit(0) if is_self else F.col("is_self")))
    if notes is not None:
        people = people.withColumn("notes", F.when(this, F.lit(notes)).otherwise(F.col("notes")))
    return people


def known(people: DataFrame, person_id: int) -> None:
    if not people.where(F.col("person_id") == person_id).take(1):
        raise KeyError(person_id)


def delete(people: DataFrame, users: DataFrame, person_id: int) -> tuple[DataFrame, DataFrame]:
    """Removes a person; their accounts stay, without a person."""
    known(people, person_id)
    return people.where(F.col("person_id") != person_id), users.withColumn("person_id", F.when(F.col("person_id") != person_id, F.col("person_id")))


def link(people: DataFrame, users: DataFrame, ids: list[int], person_id: int | None) -> DataFrame:
    """Gives accounts to a person, or to none."""
    if person_id is not None:
        known(people, person_id)
    return users.withColumn("person_id", F.when(F.col("id").isin(ids), F.lit(person_id).cast("bigint")).otherwise(F.col("person_id")))
