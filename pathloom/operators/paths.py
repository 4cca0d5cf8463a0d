"""Long and packed paths, and their transforms in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channels(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[:1] == "x" and c[1:].isdigit()]


def pack(points: DataFrame) -> DataFrame:
    """(key, i, x0, ...) -> (key, path): one shuffle, points sorted within the row. A null channel makes the path null."""
    xs = channels(points)
    rows = points.select("key", F.struct("i", F.array(*xs).alias("x")).alias("p"))
    path = F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"])
    bad = F.exists("path", lambda x: F.exists(x, lambda v: v.isNull()))
    return rows.groupBy("key").agg(path.alias("path")).withColumn("path", F.when(~bad, F.col("path")))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("key", F.posexplode("path").alias("i", "x"))


def time_augment(points: DataFrame, end_time: float = 1.0) -> DataFrame:
    """A last channel i * end_time / (length - 1)."""
    n = F.count("*").over(Window.partitionBy("key"))
    name = f"x{len(channels(points))}"
    return points.withColumn(name, F.when(n > 1, F.col("i") * end_time / (n - 1)))


def lead_lag(points: DataFrame) -> DataFrame:
    """2L - 1 points with channels (lag, lead); points (x_i, x_i) and (x_i, x_{i+1}) in turn."""
    xs = channels(points)
    w = Window.partitionBy("key").orderBy("i")
    nxt = [F.lead(x).over(w) for x in xs]
    d = points.select("key", "i", *xs, *[n.alias(f"n{k}") for k, n in enumerate(nxt)], F.lead("i").over(w).isNotNull().alias("more"))
    here = F.struct((F.col("i") * 2).alias("i"), *[F.col(x).alias(f"x{k}") for k, x in enumerate(xs * 2)])
    step = F.struct((F.col("i") * 2 + 1).alias("i"), *[F.col(x).alias(f"x{k}") for k, x in enumerate(xs + [f"n{j}" for j in range(len(xs))])])
    both = F.when(F.col("more"), F.array(here, step)).otherwise(F.array(here))
    return d.select("key", F.explode(both).alias("p")).select("key", "p.*")


def linear_sig(delta: list[Column], degree: int, name: str = "s") -> dict[str, Column]:
    """exp of a displacement: the product of the letters' increments over the factorial of the length, a column a word."""
    from math import factorial

    from ..functions.words import words

    out = {}
    for w in words(len(delta), degree):
        c = delta[w[0]]
        for letter in w[1:]:
            c = c * delta[letter]
        out[name + "".join(map(str, w))] = c / F.lit(float(factorial(len(w))))
    return out
