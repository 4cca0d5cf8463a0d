"""The same over DataFrames: prefix tables, intervals, count windows; and keyed Structured Streaming."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import tensor
from ..functions.words import sig_length, words
from ..operators import cascade, features, paths
from . import state


def prefix_table(points: DataFrame, degree: int) -> DataFrame:
    """(key, i, s): the signature up to each point. Degree 2 in window expressions, others along packed paths."""
    xs = paths.channels(points)
    d = len(xs)
    if degree <= 2:
        w = words(d, degree)
        return cascade.running(points, w).select("key", "i", F.array(*[cascade.name(x) for x in w]).alias("s"))

    def prefixes(x):
        s, out = tensor.levels(tensor.zeros(len(x), d, degree), d, degree), []
        out.append(np.concatenate(s, axis=1))
        for k in range(x.shape[1] - 1):
            s = tensor.step(s, x[:, k + 1] - x[:, k])
            out.append(np.concatenate(s, axis=1))
        return np.stack(out, axis=1)

    @arrow_udf("array<array<double>>")
    def run(p: pa.Array) -> pa.Array:
        size = sig_length(d, degree)
        flat = features.lists(len(p), [(at, prefixes(x).reshape(len(at), -1)) for at, (x,) in features.stacks([p])])
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat.values) + 1, size), pa.int32()), flat.values)
        return pa.ListArray.from_arrays(pa.array(flat.offsets.to_numpy() // size, pa.int32()), rows, mask=flat.is_null())

    return paths.pack(points).select("key", F.posexplode(run("path")).alias("i", "s"))


def intervals(prefixes: DataFrame, wanted: DataFrame, dimension: int, degree: int) -> DataFrame:
    """(key, a, b, s) for rows (key, a, b): the inverse of the prefix at a times the prefix at b; two equi-joins."""
    a = prefixes.select("key", F.col("i").alias("a"), F.col("s").alias("sa"))
    b = prefixes.select("key", F.col("i").alias("b"), F.col("s").alias("sb"))
    both = wanted.join(a, ["key", "a"]).join(b, ["key", "b"])
    fn = lambda x, y: tensor.combine(tensor.inverse(x, dimension, degree), y, dimension, degree)
    return both.select("key", "a", "b", features.vector(fn, "sa", "sb").alias("s"))


def count_windows(points: DataFrame, window: int, stride: int = 1) -> DataFrame:
    """(key, win, i, x0, ...): the points of each whole window of `window` points, the k-th starting at k * stride.
    A point goes to its windows by itself; windows past the path's end are dropped by the path's length."""
    n = points.groupBy("key").agg(F.count("*").alias("n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (window - 1)) / stride)).cast("long")
    last = F.least(F.floor(F.col("i") / stride), F.floor((F.col("n") - window) / stride)).cast("long")
    rows = points.join(n, "key").where((F.col("n") >= window) & (first <= last))
    return rows.withColumn("win", F.explode(F.sequence(first, last))).drop("n")


def window_features(points: DataFrame, window: int, stride: int, feature) -> DataFrame:
    """(key, win, s) with a feature column of a packed path, such as features.log_sig('path', 3)."""
    xs = paths.channels(points)
    w = count_windows(points, window, stride)
    packed = w.groupBy("key", "win").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.array(*xs).alias("x")))), lambda p: p["x"]).alias("path"))
    return packed.select("key", "win", feature.alias("s"))


def _stateful(stream: DataFrame, key: str, order: list[str], channels: list[str], make, take, schema: str) -> DataFrame:
    """Keyed state from `make`, fed with each micro-batch's points in order; `take(state, before)` gives the new rows."""

    def run(k, frames, st: GroupState):
        s = pickle.loads(st.get[0]) if st.exists else make()
        pdf = pd.concat(list(frames)).sort_values(order)
        rows = take(s, pdf[channels].to_numpy(dtype=float))
        st.update((pickle.dumps(s),))
        if rows:
            yield pd.DataFrame([(k[0], *r) for r in rows], columns=[c.split()[0] for c in schema.split(", ")])

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_windows(stream: DataFrame, key: str, order: list[str], channels: list[str], degree: int, window: int, stride: int = 1, kind: type = state.SigWindowStream, **how) -> DataFrame:
    """Append-mode rows (key, win, s) as windows of a key fill up; `kind` is a window class of `state`, which takes `how`. Points must reach a key in order across batches;
    within a micro-batch they are sorted. State: at most one window of points a key."""

    def make():
        s = kind(len(channels), degree, window, stride, **how)
        s.count = 0
        return s

    def take(s, x):
        s.push_batch(x)
        rows = [(s.count + k, [float(v) for v in f[0]]) for k, f in enumerate(s.found)]
        s.count += len(rows)
        s.found = []
        return rows

    return _stateful(stream, key, order, channels, make, take, "key long, win long, s array<double>")


def stream_signatures(stream: DataFrame, key: str, order: list[str], channels: list[str], degree: int, planar: bool | None = None, method: int | None = None) -> DataFrame:
    """Append-mode rows (key, n, s): the signature of all points so far, after each micro-batch; the branched one where
    `planar` is given, its logarithm where `method` is. State: one signature and the last point a key."""
    algebra = state.Algebra(len(channels), degree, planar, method)

    def make():
        return {"last": None, "s": None, "n": 0}

    def take(s, x):
        x = x[None]
        path = x if s["last"] is None else np.concatenate([s["last"], x], axis=1)
        new = algebra.of(path)
        s["s"] = new if s["s"] is None else algebra.times(s["s"], new)
        s["last"], s["n"] = x[:, -1:], s["n"] + x.shape[1]
        return [(s["n"], [float(v) for v in algebra.out(s["s"])[0]])]

    return _stateful(stream, key, order, channels, make, take, "key long, n long, s array<double>")
