"""Bases as tables: (idx, level, element)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trees, words


def word_table(spark: SparkSession, dimension: int, degree: int) -> DataFrame:
    """All words, made by repeated explosion on the executors; idx is bijective base `dimension`."""
    letters = F.array(*[F.lit(k) for k in range(dimension)])
    level = spark.range(1).select(F.array().cast("array<int>").alias("word"), F.lit(0).cast("long").alias("idx"))
    out = None
    for _ in range(degree):
        level = level.select("word", "idx", F.explode(letters).alias("x")).select(F.concat("word", F.array("x")).alias("word"), (F.col("idx") * dimension + F.col("x") + 1).alias("idx"))
        out = level if out is None else out.union(level)
    return out.select((F.col("idx") - 1).alias("idx"), F.size("word").alias("level"), F.array_join(F.transform("word", lambda x: x.cast("string")), ",").alias("word"))


def lyndon_word_table(spark: SparkSession, dimension: int, degree: int) -> DataFrame:
    """Words that are smaller than all of their proper suffixes, numbered in order."""
    rows = [(i, len(w), ",".join(map(str, w))) for i, w in enumerate(words.lyndon_words(dimension, degree))]
    return spark.createDataFrame(rows, "idx long, level int, word string")


def element_table(spark: SparkSession, dimension: int, degree: int, kind: str = "tree") -> DataFrame:
    """Trees, planar forests or Lyndon forests with canonical strings."""
    found = {"tree": trees.trees, "forest": trees.forests, "lyndon": trees.lyndon_forests}[kind](dimension, degree)
    size = trees.nodes if kind == "tree" else lambda f: sum(map(trees.nodes, f))
    return spark.createDataFrame([(i, size(e), repr(e).replace(" ", "")) for i, e in enumerate(found)], "idx long, level int, element string")
