"""A dictionary in three files: words by line, a 3-byte big-endian lemma number for each, lemmas by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, words: str, numbers: str, lemmas: str) -> DataFrame:
    """(word, lemma). ValueError if the files' lengths don't fit."""

    def lines(path: str, name: str) -> DataFrame:
        # a file is one row; its lines are numbered by their place in it
        text = spark.read.text(path, wholetext=True)
        return text.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("at", name))

    blob = spark.read.format("binaryFile").load(numbers).select(F.hex("content").alias("h"), F.length("content").alias("n"))
    w, le = lines(words, "word"), lines(lemmas, "lemma")
    size, count = blob.first()["n"], w.count()
    if size != 3 * count:
        raise ValueError(f"{count} words, but {size} bytes of numbers")
    ids = blob.select(F.posexplode(F.regexp_extract_all("h", F.lit("(.{6})"), F.lit(1))).alias("at", "x")).select("at", F.conv("x", 16, 10).cast("bigint").alias("lemma_id"))
    return w.join(ids, "at").join(le.withColumnRenamed("at", "lemma_id"), "lemma_id").select("word", "lemma")
