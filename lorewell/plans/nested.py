"""Queries and SQL of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import shapes
from lorewell.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per child entry of a decoded row."""
    return shapes.child_rows(table(spark, sf_dir, "decoded")).select("rec_id", "child_kind", "pos", "sub_pos")


def p1_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries each typed subtype table has, and how many records they belong to."""
    rows = shapes.child_rows(table(spark, sf_dir, "decoded")).groupBy("child_kind", "shape", "rec_id").agg(F.count("*").alias("n"))
    return rows.groupBy("child_kind", "shape").agg(F.sum("n").alias("entries"), F.count("*").alias("records"))


def p1_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed reaction table with the parent's keys."""
    reactions = shapes.subtype_table(shapes.child_rows(table(spark, sf_dir, "decoded")), "reaction")
    return reactions.select("rec_id", "pos", "sub_pos", "display_name", "time")


def p1_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every emotion with its key, its typed state by its users' states, and how many reactions link to it."""
    rows = shapes.child_rows(table(spark, sf_dir, "decoded"), parents=True).where("child_kind IN ('emotion', 'reaction')")
    emotions = shapes.subtype_table(rows, "emotion").select("rec_id", "pos", "key", "shape")
    own = rows.where("child_kind = 'reaction'").groupBy("rec_id", "pos").agg(F.count("*").alias("reactions"))
    return emotions.join(own, ["rec_id", "pos"], "left").select("rec_id", "pos", "key", (F.col("shape") == "emotion_used").alias("used"), F.coalesce("reactions", F.lit(0)).alias("reactions"))


QUERIES = {"p1_emotions": p1_emotions, "p1_found": p1_found, "p1_subtypes": p1_subtypes, "p1_reactions": p1_reactions}


def _list(x: str) -> str:
    """SQL for a JSON node as a list of nodes: arrays, JSON text of arrays, a single object."""
    inner = f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) END ELSE {x} END)"
    return f"(CASE json_type({inner}) WHEN 'ARRAY' THEN from_json({inner}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{inner}] END)"


_ENTRY = "(x IS NOT NULL AND json_type(x) <> 'NULL' AND CAST(x AS VARCHAR) NOT IN ('\"\"', '{}'))"
_CTE = f"""
WITH m AS (SELECT rec_id, attachments, CAST(CASE WHEN json_valid(message) THEN message END AS JSON) AS j,
                  list_transform(embeds, lambda e: CASE WHEN json_valid(e) THEN CAST(e AS JSON) END) AS embeds FROM decoded),
l AS (SELECT rec_id, attachments, embeds, {_list("(j -> '$.properties.emotions')")} AS emotions, {_list("(j -> '$.properties.files')")} AS files,
             {_list("(j -> '$.properties.qtdMsgs')")} AS quotes, {_list("(j -> '$.properties.urlpreviews')")} AS previews,
             {_list("(j -> '$.amsreferences')")} AS refs FROM m),
flat AS (
  SELECT rec_id, 'embed' AS child_kind, unnest(embeds) AS x, generate_subscripts(embeds, 1) - 1 AS pos FROM l
  UNION ALL SELECT rec_id, 'emotion', unnest(emotions), generate_subscripts(emotions, 1) - 1 FROM l
  UNION ALL SELECT rec_id, 'file', unnest(files), generate_subscripts(files, 1) - 1 FROM l
  UNION ALL SELECT rec_id, 'quote', unnest(quotes), generate_subscripts(quotes, 1) - 1 FROM l
  UNION ALL SELECT rec_id, 'preview', unnest(previews), generate_subscripts(previews, 1) - 1 FROM l
  UNION ALL SELECT rec_id, 'amsref', unnest(refs), generate_subscripts(refs, 1) - 1 FROM l),
inner_lists AS (
  SELECT rec_id, 'embed_field' AS child_kind, pos, {_list("(x -> '$.fields')")} AS xs FROM flat WHERE child_kind = 'embed'
  UNION ALL SELECT rec_id, 'reaction', pos, {_list("(x -> '$.users')")} FROM flat WHERE child_kind = 'emotion'),
deep AS (SELECT rec_id, child_kind, pos, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS sub_pos FROM inner_lists),
files_of AS (SELECT rec_id, unnest(attachments) AS a, generate_subscripts(attachments, 1) - 1 AS pos FROM l)
"""

SQL = {
    "p1_emotions": f"""{_CTE}, e AS (SELECT rec_id, pos, x ->> '$.key' AS key FROM flat WHERE child_kind = 'emotion' AND {_ENTRY}),
r AS (SELECT rec_id, pos, count(*) AS n, bool_and(json_type(x) = 'OBJECT' AND json_type(x -> '$.DisplayName') = 'VARCHAR' AND (x ->> '$.DisplayName') <> '') AS typed
  FROM deep WHERE child_kind = 'reaction' AND {_ENTRY} GROUP BY 1, 2)
SELECT rec_id, CAST(e.pos AS INTEGER) AS pos, key, coalesce(typed, false) AND coalesce(key, '') <> '' AS used, coalesce(n, 0) AS reactions FROM e LEFT JOIN r USING (rec_id, pos)""",
    "p1_found": f"""{_CTE}
SELECT rec_id, child_kind, CAST(pos AS INTEGER) AS pos, -1 AS sub_pos FROM flat WHERE child_kind <> 'emotion' AND {_ENTRY}
UNION ALL SELECT rec_id, child_kind, CAST(pos AS INTEGER), CAST(sub_pos AS INTEGER) FROM deep WHERE {_ENTRY}
UNION ALL SELECT rec_id, 'attachment', CAST(pos AS INTEGER), -1 FROM files_of
WHERE a.doc_id IS NOT NULL OR a.name IS NOT NULL OR a.size IS NOT NULL OR a.width IS NOT NULL OR a.height IS NOT NULL OR a.url IS NOT NULL""",
    "p1_reactions": f"""{_CTE}
SELECT rec_id, CAST(pos AS INTEGER) AS pos, CAST(sub_pos AS INTEGER) AS sub_pos, x ->> '$.DisplayName' AS display_name,
       CAST(x ->> '$.time' AS BIGINT) AS time FROM deep WHERE child_kind = 'reaction' AND {_ENTRY}""",
}
