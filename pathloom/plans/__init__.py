"""Choice of a plan for a signature before Catalyst sees it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import words
from ..operators import cascade, features, paths


def signature(points: DataFrame, degree: int, long_paths: bool = False) -> DataFrame:
    """(key, s: array<double>) in coordinate order.

    Degree 1, and one channel of any degree: only the end points, a partial aggregate without a sort. Degree 2 with up
    to three channels: window expressions. Otherwise packed paths through Arrow batches, in chunks if paths are long.
    """
    xs = paths.channels(points)
    d = len(xs)
    features.guard(d, degree)
    if degree == 1 or d == 1:
        ends = points.groupBy("key").agg(*[(F.max_by(x, "i") - F.min_by(x, "i")).alias(x) for x in xs])
        if degree == 1:
            return ends.select("key", F.array(*xs).alias("s"))
        powers = [F.pow("x0", F.lit(k)) / F.lit(1.0 * _factorial(k)) for k in range(1, degree + 1)]
        return ends.select("key", F.array(*powers).alias("s"))
    if degree == 2 and d <= 3 and not long_paths:
        w = words(d, 2)
        return cascade.coefficients(points, w, prefixes=True).select("key", F.array(*[cascade.name(x) for x in w]).alias("s"))
    if long_paths:
        return features.long_path_sig(points, degree)
    return paths.pack(points).select("key", features.sig("path", degree).alias("s"))


def _factorial(k: int) -> int:
    from math import factorial

    return factorial(k)
