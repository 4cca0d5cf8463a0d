"""Tables as ordered observations: (key, order columns, channels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def points(df: DataFrame, key: str, order: list[str], channels: dict) -> DataFrame:
    """(key, i, x0, x1, ...): i counts a key's rows from 0 in the given order, which must be total; channels are
    expressions, cast to double, and may use i."""
    i = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")
    return df.withColumn("i", i).select(F.col(key).alias("key"), "i", *[c.cast("double").alias(n) for n, c in channels.items()])


def event_points(spark: SparkSession, folder: str) -> DataFrame:
    """Users' events: x0 the value over 97 (a prime, so that no sum ends on half a rounding unit), x1 the count of earlier events in hundreds."""
    return points(table(spark, folder, "events"), "user_id", ["ts", "event_id"], {"x0": F.col("value") / 97, "x1": F.col("i") / 100})


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' orders: x0 the price in 97,000s, x1 the order's number in hundreds."""
    return points(table(spark, folder, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], {"x0": F.col("o_totalprice") / 97000, "x1": F.col("i") / 100})


def vector_paths(spark: SparkSession, folder: str, dimension: int = 2) -> DataFrame:
    """Embeddings as short paths: (key, label, path) with `dimension` channels."""
    e = table(spark, folder, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    n = F.floor(F.size("embedding") / dimension).cast("int")
    path = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(v, k * dimension + 1, dimension))
    return e.select(F.col("vec_id").alias("key"), F.col("label").cast("int"), path.alias("path"))
