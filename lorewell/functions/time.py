"""Time functions; instants are epoch milliseconds, months are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(ms: Column) -> Column:
    """A timestamp of whole seconds; division rounds towards zero."""
    return F.timestamp_seconds((ms / 1000).cast("bigint"))


def month(ms: Column) -> Column:
    return F.date_format(instant(ms), "yyyy-MM")


def day(ms: Column, zone: str = "UTC") -> Column:
    """The calendar day in a viewer's time zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def iso_ms(text: Column, fallback: Column) -> Column:
    """ISO text to milliseconds (naive is UTC); else the digits of an id; else 0."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), fallback.try_cast("bigint"), F.lit(0))


def every_month(counted: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Adds the silent months between each group's first and last month, with zeros."""
    first = F.to_date(F.concat("month", F.lit("-01")))
    spans = counted.groupBy(*group).agg(F.explode(F.sequence(F.min(first), F.max(first), F.expr("interval 1 month"))).alias("d"))
    months = spans.select(*group, F.date_format("d", "yyyy-MM").alias("month"))
    return months.join(counted, [*group, "month"], "left").select(*group, "month", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])
