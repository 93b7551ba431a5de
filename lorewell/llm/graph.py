"""Connected components of link tables, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has a link, and the least node it is connected with.

    ``edges`` has the columns a and b of one orderable type (structs compare by their fields). Large-star and
    small-star steps alternate until nothing changes. Minima are combined before the shuffle, and the joins are left
    to adaptive execution, so a node with very many links is neither collected nor paired with itself. Links from a
    node to itself and repeated links are harmless; an empty table gives no rows.
    """
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        cur = written(small, "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    tops = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)
