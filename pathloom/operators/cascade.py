"""Word coefficients in window expressions alone: one shuffle and one sort, whatever the words."""

from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paths import channels


def name(word) -> str:
    return "s" + "".join(map(str, word))


def running(points: DataFrame, words, partition=("key",)) -> DataFrame:
    """Adds, for each word and prefix of a word, its coefficient over the path up to this point.

    C_n = running sum of sum_j C_j(before) * product of the increments of letters j + 1..n / (n - j)!. All windows
    share partition and order, so they run on one sorted exchange.
    """
    w = Window.partitionBy(*partition).orderBy("i")
    total = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = points.withColumns({f"d{k}": F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0.0)) for k, x in enumerate(channels(points))})
    prefixes = sorted({tuple(word[: k + 1]) for word in words for k in range(len(word))}, key=lambda p: (len(p), p))
    for p in prefixes:
        inc = None
        for j in range(len(p)):
            term = reduce(lambda a, b: a * b, [F.col(f"d{x}") for x in p[j:]])
            before = F.coalesce(F.lag(name(p[:j])).over(w), F.lit(0.0)) if j else None
            term = term / F.lit(float(factorial(len(p) - j)))
            term = before * term if before is not None else term
            inc = term if inc is None else inc + term
        df = df.withColumn(name(p), F.sum(inc).over(total))
    return df


def coefficients(points: DataFrame, words, prefixes: bool = False, partition=("key",)) -> DataFrame:
    """(key, s...): the coefficients of whole paths. Words of one letter alone need no window, only the end points."""
    if not len(words):
        raise ValueError("no words were given")
    wanted = sorted({tuple(w[: k + 1]) for w in words for k in range(len(w))} if prefixes else {tuple(w) for w in words if len(w)}, key=lambda p: (len(p), p))
    if all(len(w) <= 1 for w in words):
        ends = [(F.max_by(f"x{w[0]}", "i") - F.min_by(f"x{w[0]}", "i")).alias(name(w)) for w in wanted]
        return points.groupBy(*partition).agg(*ends)
    df = running(points, words, partition)
    return df.groupBy(*partition).agg(*[F.max_by(name(w), "i").alias(name(w)) for w in wanted])
