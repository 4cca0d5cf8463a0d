"""Feature vectors of packed paths by Arrow batches: paths of equal length go through the algebra together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import branched, tape, tensor, trees, words


def layout(column: pa.Array):
    """Of a column of arrays, or of arrays of arrays: whether each row is sound (no null in it, rows of one length, and
    not an empty array of arrays, whose width nobody knows), each row's shape, its first value's place, and all values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, good = column.offsets.to_numpy() if len(column) else np.zeros(1, dtype=np.int64), column.is_valid().to_numpy(zero_copy_only=False)
    count, values = np.diff(ends), column.values
    shape = [count]
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        inner, known = values.offsets.to_numpy() if len(values) else np.zeros(1, dtype=np.int64), values.is_valid().to_numpy(zero_copy_only=False)
        width = np.diff(inner)
        first = np.minimum(ends[:-1], max(len(width) - 1, 0))
        odd = np.zeros(len(width) + 1, dtype=np.int64)  # how many earlier rows are null or differ in width from the one before
        odd[1:] = np.cumsum(~known)
        turns = np.zeros(len(width) + 1, dtype=np.int64)
        turns[2:] = np.cumsum(width[1:] != width[:-1])
        good &= (count > 0) & (odd[ends[1:]] == odd[ends[:-1]]) & (turns[ends[1:]] == turns[np.minimum(ends[:-1] + 1, len(width))])
        shape.append(np.where(good, width[first], 0) if len(width) else count)
        ends, values = inner[ends], values.values
    missing = np.zeros(len(values) + 1, dtype=np.int64)
    missing[1:] = np.cumsum(values.is_null().to_numpy(zero_copy_only=False))
    good &= missing[ends[1:]] == missing[ends[:-1]]
    return good, np.stack(shape, axis=1), ends[:-1], values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def stacks(columns):
    """(rows, [stack, ...]) for each combination of shapes among the rows that are sound in every column."""
    found = [layout(c) for c in columns]
    rows = np.flatnonzero(np.logical_and.reduce([f[0] for f in found]))
    if not len(rows):
        return
    shapes = np.concatenate([f[1][rows] for f in found], axis=1)
    kinds, which = np.unique(shapes, axis=0, return_inverse=True)
    for k in range(len(kinds)):
        at = rows[which.ravel() == k]
        out = []
        for _, shape, first, values in found:
            one = tuple(shape[at[0]])
            out.append(values[first[at][:, None] + np.arange(np.prod(one, dtype=np.int64))].reshape(len(at), *one))
        yield at, out


def lists(n: int, parts) -> pa.Array:
    """n lists of numbers from (rows, matrix) parts; null where no part has the row."""
    length, null = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for at, m in parts:
        length[at], null[at] = m.shape[1], False
    ends = np.concatenate([[0], np.cumsum(length)])
    values = np.empty(ends[-1])
    for at, m in parts:
        values[ends[at][:, None] + np.arange(m.shape[1])] = m
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array(null))


def vector(fn, *columns) -> Column:
    """fn: batches of arrays (one for each column) -> (batch, coordinates). An array<double> column, null where an input
    is null, empty where it should be a path, ragged, or holds a null."""

    @arrow_udf("array<double>")
    def run(*arrays: pa.Array) -> pa.Array:
        return lists(len(arrays[0]), [(at, np.asarray(fn(*x), dtype=float).reshape(len(at), -1)) for at, x in stacks(arrays)])

    return run(*columns)


#: Rows on a tape at once: it holds every step of each, a thousand cells for a pair of paths of 32 points.
TAPED = 256


def gradient(fn, cotangent: str, *columns: str) -> Column:
    """The vector-Jacobian product of fn: array<array<double>>, a flattened gradient for each input."""

    @arrow_udf("array<array<double>>")
    def run(c: pa.Array, *arrays: pa.Array) -> pa.Array:
        out = [None] * len(c)
        for rows, stack in stacks([c, *arrays]):
            for k in range(0, len(rows), TAPED):
                at, (cot, *inputs) = rows[k : k + TAPED], [x[k : k + TAPED] for x in stack]
                got = [g.reshape(len(at), -1).tolist() for g in tape.vjp(fn, inputs, cot)]
                for r, row in zip(at, zip(*got)):
                    out[r] = list(row)
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return run(cotangent, *columns)


def whole_gradient(fn, column: str) -> Column:
    """The gradient of the sum of all outputs of fn with respect to a path, flattened."""

    def grads(x):
        out = np.empty((len(x), x[0].size))
        for k in range(0, len(x), TAPED):
            few = x[k : k + TAPED]
            (g,) = tape.vjp(fn, [few], np.ones(fn(few).shape))
            out[k : k + TAPED] = g.reshape(len(few), -1)
        return out

    return vector(grads, column)


def scalar(out, scalar_term: bool):
    return np.concatenate([np.ones((len(out), 1)), out], axis=1) if scalar_term else out


def guard(d: int, degree: int, most: int = 10_000_000) -> None:
    """Raises before a vector is made that could not be held."""
    if words.sig_length(d, degree) > most:
        raise ValueError("the feature vector would be too long; ask for coefficients of words instead")


def sig(path="path", degree: int = 2, time_aug=False, lead_lag=False, end_time=1.0, scalar_term=False, correction=None) -> Column:
    """Signature column. Paths of fewer than two points give zeros (and the scalar term)."""
    if correction is not None and lead_lag:
        raise ValueError("a correction cannot be combined with lead-lag")

    def fn(x):
        x = tensor.transform_path(x, time_aug, lead_lag, end_time)
        guard(x.shape[2], degree)
        return scalar(tensor.sig(x, degree, correction), scalar_term)

    return vector(fn, path)


def log_sig(path="path", degree: int = 2, method: int = 1, time_aug=False, lead_lag=False, end_time=1.0, scalar_term=False, correction=None) -> Column:
    """Log-signature column. The scalar term of a log-signature is 0 and belongs to the expanded form (method 0)."""
    if scalar_term and method != 0:
        raise ValueError("only the expanded form has a scalar term")

    def fn(x):
        x = tensor.transform_path(x, time_aug, lead_lag, end_time)
        guard(x.shape[2], degree)
        out = tensor.log_sig(x, degree, method, correction)
        return np.concatenate([np.zeros((len(out), 1)), out], axis=1) if scalar_term else out

    return vector(fn, path)


def sig_coef(path, word_list, prefixes=False, time_aug=False, lead_lag=False, end_time=1.0) -> Column:
    return vector(lambda x: tensor.coefficients(tensor.transform_path(x, time_aug, lead_lag, end_time), word_list, prefixes), path)


def extract_sig_coef(column: str, word_list, dimension: int, scalar_term: bool = False) -> list[Column]:
    """Coordinates of a computed signature, by element_at: no Python."""
    return [F.element_at(column, words.word_to_idx(w, dimension, scalar_term=scalar_term) + 1).alias("s" + "".join(map(str, w))) if len(w) or scalar_term else F.lit(1.0).alias("s") for w in word_list]


def sig_combine(a, b, dimension, degree) -> Column:
    return vector(lambda x, y: tensor.combine(x, y, dimension, degree), a, b)


def sig_join(s, delta, dimension, degree, prepend=False) -> Column:
    return vector(lambda x, y: tensor.join(x, y, dimension, degree, prepend), s, delta)


def sig_to_log_sig(s, dimension, degree, method=1) -> Column:
    if method == 3:
        raise ValueError("method 3 starts from a path")
    return vector(lambda x: tensor.sig_to_log_sig(x, dimension, degree, method), s)


def logsig_to_sig(s, dimension, degree, method=1) -> Column:
    return vector(lambda x: tensor.log_sig_to_sig(x, dimension, degree, method), s)


def log_sig_combine(a, b, dimension, degree, method=2) -> Column:
    return vector(lambda x, y: tensor.log_combine(x, y, dimension, degree, method), a, b)


def log_sig_reduce(column, dimension, degree, method=2) -> Column:
    """The log-signature of a concatenation, from the array of its parts' log-signatures in order."""

    def fn(x):
        out = x[:, 0]
        for k in range(1, x.shape[1]):
            out = tensor.log_combine(out, x[:, k], dimension, degree, method)
        return out

    return vector(fn, column)


def log_sig_join(s, delta, dimension, degree, method=2) -> Column:
    return vector(lambda x, y: tensor.log_join(x, y, dimension, degree, method), s, delta)


def linear_sig(delta, degree) -> Column:
    return vector(lambda x: tensor.linear_sig(x, degree), delta)


def linear_log_sig(delta, degree, method=1) -> Column:
    return vector(lambda x: tensor.linear_log_sig(x, degree, method), delta)


def branched_sig(path="path", degree=2, planar=False, time_aug=False, lead_lag=False, end_time=1.0, scalar_term=False, correction=None) -> Column:
    return vector(lambda x: scalar(branched.sig(tensor.transform_path(x, time_aug, lead_lag, end_time), degree, planar, correction), scalar_term), path)


def extract_branched_sig_coef(column: str, elements, dimension: int, degree: int, planar: bool = False, scalar_term: bool = False) -> list[Column]:
    """Coordinates of a computed branched signature, named e0, e1, ...: no Python. The empty element is 1."""
    place = trees.forest_to_idx if planar else trees.tree_to_idx
    return [(F.element_at(column, place(e, dimension, degree) + 1 + scalar_term) if e else F.lit(1.0)).alias(f"e{k}") for k, e in enumerate(elements)]


def branched_sig_combine(a, b, dimension, degree, planar=False) -> Column:
    return vector(lambda x, y: branched.combine(x, y, dimension, degree, planar), a, b)


def branched_sig_join(s, delta, dimension, degree, planar=False, prepend=False) -> Column:
    return vector(lambda x, y: branched.join(x, y, dimension, degree, planar, prepend), s, delta)


def branched_sig_coef(path, elements, planar=False, time_aug=False, lead_lag=False, end_time=1.0, correction=None) -> Column:
    return vector(lambda x: branched.coefficients(tensor.transform_path(x, time_aug, lead_lag, end_time), elements, planar, correction), path)


def branched_log_sig(path="path", degree=2, planar=False, method=None, time_aug=False, lead_lag=False, end_time=1.0, correction=None) -> Column:
    return vector(lambda x: branched.log_sig(tensor.transform_path(x, time_aug, lead_lag, end_time), degree, planar, method, correction), path)


def branched_sig_to_log_sig(s, dimension, degree, planar=False, method=None) -> Column:
    return vector(lambda x: branched.to_log(x, dimension, degree, planar, method), s)


def branched_log_sig_join(s, delta, dimension, degree, method=2, prepend=False) -> Column:
    return vector(lambda x, y: branched.log_join(x, y, dimension, degree, method, prepend), s, delta)


def linear_branched_sig(delta, degree, planar=False) -> Column:
    return vector(lambda x: branched.linear(x, degree, planar), delta)


def linear_branched_log_sig(delta, degree, planar=False, method=None) -> Column:
    return vector(lambda x: branched.linear_log(x, degree, planar, method), delta)


def long_path_sig(points: DataFrame, degree: int, chunk: int = 4096, fan: int = 64) -> DataFrame:
    """(key, s) of paths that may be too long for one task, from (key, i, x0, ...).

    A path is cut into chunks of `chunk` points by i; each chunk also gets the last point of the one before (Chen's
    identity needs the segment between them), which is sent there, not looked up. Chunks' signatures are multiplied in
    order, `fan` at a time, in as many rounds as the longest path needs.
    """
    xs = [c for c in points.columns if c[:1] == "x" and c[1:].isdigit()]
    d = len(xs)
    c = F.floor(F.col("i") / chunk)
    both = F.when(F.col("i") % chunk == chunk - 1, F.array(c, c + 1)).otherwise(F.array(c))
    rows = points.select("key", F.explode(both).alias("c"), F.struct("i", F.array(*xs).alias("x")).alias("p"))
    cur = rows.groupBy("key", "c").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]).alias("path"))
    cur = cur.select("key", "c", sig("path", degree).alias("s"))
    longest = points.agg(F.max("i")).first()[0] or 0
    parts = longest // chunk + 2

    def product(x):
        out = x[:, 0]
        for k in range(1, x.shape[1]):
            out = tensor.combine(out, x[:, k], d, degree)
        return out

    while parts > 1:
        grouped = cur.groupBy("key", F.floor(F.col("c") / fan).alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "s"))), lambda p: p["s"]).alias("ss"))
        cur = grouped.select("key", "c", vector(product, "ss").alias("s"))
        parts = -(-parts // fan)
    return cur.select("key", "s")
