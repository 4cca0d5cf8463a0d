"""Kernels of pairs of paths, Gram matrices in long form, scores and discrepancies.

A matrix, and what is summed over all pairs, comes from a kernel of `functions.products` by pairs of blocks: a path is
sent once for each block of the other side, and a block pair is one matrix in numpy. A column over pa and pb works too,
pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import kernels, products, tensor
from .features import gradient, stacks

#: Cells of pairs of paths that are evaluated at once, before cells are split: 256 pairs of 32 points.
CELLS = 1 << 18


def kernel(fn, a: str = "pa", b: str = "pb") -> Column:
    """fn(x, y) on batches of pairs of equal lengths -> one value a pair. A batch of rows is cut so that the cells of its
    pairs, of which fn holds several arrays, don't depend on how many rows come at once."""

    @arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out, null = np.zeros(len(x)), np.ones(len(x), dtype=bool)
        for rows, (u, v) in stacks([x, y]):
            few = max(1, CELLS // max(1, u.shape[1] * v.shape[1]))
            for k in range(0, len(rows), few):
                at = rows[k : k + few]
                out[at], null[at] = fn(u[k : k + few], v[k : k + few]), False
        return pa.array(out, mask=null)

    return run(a, b)


def sig_kernel(a="pa", b="pb", *, time_aug=False, lead_lag=False, end_time=1.0, **how) -> Column:
    lift = lambda x: tensor.transform_path(x, time_aug, lead_lag, end_time)
    return kernel(lambda x, y: kernels.sig_kernel(lift(x), lift(y), **how), a, b)


def branched_sig_kernel(a="pa", b="pb", *, depth: int, time_aug=False, lead_lag=False, end_time=1.0, **how) -> Column:
    lift = lambda x: tensor.transform_path(x, time_aug, lead_lag, end_time)
    return kernel(lambda x, y: kernels.branched_sig_kernel(lift(x), lift(y), depth, **how), a, b)


def pairs(left: DataFrame, right: DataFrame | None = None, blocks: int = 16, by: str | None = None) -> DataFrame:
    """(i, j, pa, pb): every pair of two samples, or of one sample with i <= j; with `by`, only pairs that are equal
    there, as two nulls are.

    For kernels that are columns. A Gram matrix is a whole product by definition. Both sides are dealt to blocks and sent to the block pairs they
    belong to, so that the product is an equi-join spread over blocks * blocks keys. A kernel costs far more than a row's
    way there: one side is dealt to three tasks a core by its keys, however few files or bytes it comes from.
    """
    one = right is None
    r = left if one else right
    n = F.lit(blocks)
    same = [] if by is None else [F.struct(by).alias("same")]
    a = left.select(*same, F.col("key").alias("i"), F.col("path").alias("pa"), F.pmod(F.xxhash64("key"), n).alias("g")).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    b = r.select(*same, F.col("key").alias("j"), F.col("path").alias("pb"), F.pmod(F.xxhash64("key"), n).alias("h")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    tasks = 3 * left.sparkSession.sparkContext.defaultParallelism
    a = a.repartition(tasks, *(["same"] * bool(same)), "g", "h")
    out = a.join(b, ["same"] * bool(same) + ["g", "h"]).select("i", "j", "pa", "pb")
    return out.where("i <= j") if one else out


#: Paths of a block at most, as dealt by count: a block pair is a million pairs.
SIDE = 1024


def largest(*sides: DataFrame, by: str | None = None) -> int:
    """The rows of the largest side, or of its largest group."""
    if by is None:
        return max(s.count() for s in sides)
    return max(s.groupBy(by).count().agg(F.max("count")).first()[0] or 0 for s in sides)


def blocks_for(*sides: DataFrame, by: str | None = None) -> int:
    """The blocks of a side: at least eight, so that few rows too make a task for each core."""
    return max(8, -(-largest(*sides, by=by) // SIDE))


def packed(df: DataFrame, blocks: int, same: list) -> DataFrame:
    """(same, g, rows): a side dealt to blocks by its keys, in order of them; a path as its shape and its values, null
    where it isn't sound."""

    @arrow_udf("struct<n:int,d:int,v:binary>")
    def flat(p: pa.Array) -> pa.Array:
        shape, null = np.zeros((2, len(p)), dtype=np.int32), np.ones(len(p), dtype=bool)
        parts = list(stacks([p]))
        for at, (x,) in parts:
            shape[:, at], null[at] = np.array([x.shape[1:]]).T, False
        ends = np.concatenate([[0], np.cumsum(np.prod(shape, axis=0, dtype=np.int64))])
        values = np.empty(ends[-1])
        for at, (x,) in parts:
            values[ends[at][:, None] + np.arange(x[0].size)] = x.reshape(len(at), -1)
        v = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(p), [None, pa.py_buffer(ends * 8), pa.py_buffer(values)])
        return pa.StructArray.from_arrays([pa.array(shape[0]), pa.array(shape[1]), v.cast(pa.binary())], ["n", "d", "v"], mask=pa.array(null))

    rows = df.select(*same, F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("g"), F.struct("key", flat("path").alias("p")).alias("row"))
    return rows.groupBy(*["same"] * bool(same), "g").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def block_pairs(left: DataFrame, right: DataFrame | None, blocks: int, by: str | None) -> DataFrame:
    """(x, y, own): the rows of two blocks, for every pair of blocks; of one sample for g <= h, own where g = h. With `by`,
    blocks that are equal there, as two nulls are. A pair costs far more than its way there: they are dealt to eight tasks
    a core."""
    one = right is None
    same = [] if by is None else [F.struct(by).alias("same")]
    named = lambda df: packed(df.where("key is not null") if one else df, blocks, same)
    first, last, keys = F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"), ["same"] * bool(same) + ["g", "h"]
    x = named(left).withColumnRenamed("rows", "x").withColumn("h", F.explode(F.sequence(F.col("g") if one else first, last)))
    y = named(left if one else right).withColumnRenamed("rows", "y").withColumnRenamed("g", "h").withColumn("g", F.explode(F.sequence(first, F.col("h") if one else last)))
    tasks = 8 * left.sparkSession.sparkContext.defaultParallelism
    return x.repartition(tasks, *keys).join(y, keys).select("x", "y", (F.col("g") == F.col("h") if one else F.lit(False)).alias("own"))


def unpack(row):
    """The keys of a block, and (places, stack) for each shape among its sound paths."""
    rows = row.values
    keys, p = rows.field("key"), rows.field("p")
    good = np.flatnonzero(p.is_valid().to_numpy(zero_copy_only=False))
    if not len(good):
        return keys, []
    p = p.take(pa.array(good))
    v = p.field("v")
    wide = pa.types.is_large_binary(v.type)
    first = np.frombuffer(v.buffers()[1], np.int64 if wide else np.int32)[v.offset : v.offset + len(v)] // 8
    values = np.frombuffer(v.buffers()[2] or b"", np.uint8)
    values = values[: len(values) // 8 * 8].view(np.float64)
    shapes, which = np.unique(np.stack([p.field("n").to_numpy(), p.field("d").to_numpy()], axis=1), axis=0, return_inverse=True)
    out = []
    for k, (n, d) in enumerate(shapes):
        at = np.flatnonzero(which.ravel() == k)
        out.append((good[at], values[first[at][:, None] + np.arange(n * d)].reshape(len(at), n, d)))
    return keys, out


def block_values(k: products.Pairwise, x, y, own: bool, one: bool):
    """The keys of a block pair, its matrix, and where that is known: where both paths are sound. Of one sample, the
    kernel of the lower key with the other stands for both."""
    (kx, xs), (ky, ys) = unpack(x), unpack(y)
    out, known = np.zeros((len(kx), len(ky))), np.zeros((len(kx), len(ky)), dtype=bool)
    for a, u in xs:
        for b, v in ys:
            if own and k.symmetric and len(xs) == 1:
                got = k.product(u)
            else:
                got = k.product(u, v)
                if one and not k.symmetric:
                    least = np.less_equal.outer(*(key.take(pa.array(at)).to_numpy(zero_copy_only=False) for key, at in ((kx, a), (ky, b))))
                    got = np.where(least, got, k.product(v, u).T)
            out[np.ix_(a, b)], known[np.ix_(a, b)] = got, True
    return kx, ky, out, known


def blockwise(ab: DataFrame, schema: str, fn) -> DataFrame:
    """fn(x, y, own) -> record batches, for each pair of blocks."""

    def run(batches):
        for batch in batches:
            x, y, own = (batch.column(c) for c in ("x", "y", "own"))
            for r in range(batch.num_rows):
                yield from fn(x[r], y[r], own[r].as_py())

    return ab.mapInArrow(run, schema)


def mirror(upper: DataFrame) -> DataFrame:
    """Both halves from i <= j: a row off the diagonal becomes two, after its kernel was evaluated once."""
    one, other = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = F.when(F.col("i") == F.col("j"), F.array(one)).otherwise(F.array(one, other))
    return upper.select(F.explode(both).alias("at"), "k").select("at.i", "at.j", "k")


def key_types(left: DataFrame, right: DataFrame | None) -> list[str]:
    return [s.schema["key"].dataType.simpleString() for s in (left, left if right is None else right)]


def gram(k: products.Pairwise | Column, left: DataFrame, right: DataFrame | None = None, blocks: int | None = None, by: str | None = None, half: bool = False) -> DataFrame:
    """(i, j, k). With one sample, each kernel is evaluated once and mirrored; with `half`, only i <= j. With `by`, a
    matrix for each of its values."""
    one = right is None
    blocks = blocks or blocks_for(left, *([] if one else [right]), by=by)
    if isinstance(k, Column):
        out = pairs(left, right, max(16, blocks), by).select("i", "j", k.alias("k"))
        return mirror(out) if one and not half else out
    ti, tj = key_types(left, right)

    def rows(x, y, own):
        kx, ky, values, known = block_values(k, x, y, own, one)
        few = max(1, (1 << 16) // max(1, len(ky)))
        for r in range(0, len(kx), few):
            size = len(values[r : r + few])
            at = np.repeat(np.arange(r, r + size), len(ky)), np.tile(np.arange(len(ky)), size)
            v, null = values[r : r + few].ravel(), ~known[r : r + few].ravel()
            i, j = kx.take(pa.array(at[0])), ky.take(pa.array(at[1]))
            if own and half:
                keep = at[0] <= at[1]
                keep |= pc.equal(i, j).to_numpy(zero_copy_only=False)
                i, j, v, null = i.filter(pa.array(keep)), j.filter(pa.array(keep)), v[keep], null[keep]
            v = pa.array(v, mask=null)
            yield pa.RecordBatch.from_arrays([i, j, v], ["i", "j", "k"])
            if one and not own and not half:
                yield pa.RecordBatch.from_arrays([j, i, v], ["i", "j", "k"])

    out = blockwise(block_pairs(left, right, blocks, by), f"i {ti}, j {tj}, k double", rows)
    return out.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "k") if one and half else out


def sums(k: products.Pairwise | Column, left: DataFrame, right: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """Sums s of the kernels and their numbers n, nulls left out, without a row for each pair: (j, s, n) for each j of the
    other sample, or (s, n) of one sample's pairs i < j."""
    one = right is None
    blocks = blocks or blocks_for(left, *([] if one else [right]))
    if isinstance(k, Column):
        found = pairs(left, right, max(16, blocks)).where("i <> j" if one else "true").select("j", k.alias("k"))
        return found.groupBy(*[] if one else ["j"]).agg(F.sum("k").alias("s"), F.count("k").alias("n"))

    def parts(x, y, own):
        kx, ky, values, known = block_values(k, x, y, own, one)
        if own:
            known = np.triu(known, 1)
            last = pc.equal(ky[1:], ky[:-1]).to_numpy(zero_copy_only=False) if len(ky) > 1 else np.zeros(0, dtype=bool)
            group = np.concatenate([[0], np.cumsum(~last)])  # of equal keys
            known &= group[:, None] != group[None, :]
        s, n = np.where(known, values, 0.0), known
        if one:
            yield pa.RecordBatch.from_arrays([pa.array([float(s.sum())]), pa.array([int(n.sum())])], ["s", "n"])
        else:
            yield pa.RecordBatch.from_arrays([ky, pa.array(s.sum(axis=0)), pa.array(n.sum(axis=0))], ["j", "s", "n"])

    out = blockwise(block_pairs(left, right, blocks, None), "s double, n long" if one else f"j {key_types(left, right)[1]}, s double, n long", parts)
    return out.groupBy(*[] if one else ["j"]).agg(F.sum(F.when(F.col("n") > 0, F.col("s"))).alias("s"), F.sum("n").alias("n"))


def gradients(fn, left: DataFrame, right: DataFrame, weights: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(i, gradient): of the sum over all pairs of weight * fn(x_i, y_j) with respect to x_i, flattened.

    weights is (i, j, w), every weight 1 without it. Without weights fn may be a kernel of `functions.products`; a block
    pair gives one gradient for each i. With them, a pair's gradient is made where the pair is. Either way they are added
    up per coordinate, with partial sums before the shuffle, so no task holds a row of the matrix.
    """
    blocks = blocks or blocks_for(left, right)
    if weights is None:
        kernel = fn if isinstance(fn, products.Pairwise) else products.Pairwise(fn)

        def parts(x, y, own):
            (kx, xs), (_, ys) = unpack(x), unpack(y)
            for at, u in xs:
                if ys:
                    g = sum(kernel.gradient(u, v) for _, v in ys).reshape(len(at), -1)
                    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * g.shape[1])
                    yield pa.RecordBatch.from_arrays([kx.take(pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(g.ravel()))], ["i", "g"])

        each = blockwise(block_pairs(left, right, blocks, None), f"i {key_types(left, right)[0]}, g array<double>", parts)
    else:
        ab = pairs(left, right, max(16, blocks)).join(weights, ["i", "j"])
        pair = fn.fn if isinstance(fn, products.Pairwise) else fn
        g = gradient(lambda x, y: pair(x, y).reshape(-1, 1), "c", "pa", "pb")
        each = ab.withColumn("c", F.array("w")).select("i", F.element_at(g, 1).alias("g"))
    sums = each.select("i", F.posexplode("g").alias("pos", "v")).groupBy("i", "pos").agg(F.sum("v").alias("v"))
    return sums.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("gradient"))


def normalized(g: DataFrame) -> DataFrame:
    """k / sqrt(k_ii k_jj), NaN where that product is not positive; g is one sample's matrix, whole or half. The diagonal
    comes by windows over rows and columns, so that each kernel is evaluated once."""
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("k")))
    p = own.over(Window.partitionBy("i")) * own.over(Window.partitionBy("j"))
    return g.withColumn("p", p).select("i", "j", F.when(F.col("p") > 0, F.col("k") / F.sqrt("p")).otherwise(F.lit(float("nan"))).alias("k"))


def mean(s="s", n="n") -> Column:
    """Null where nothing was added up."""
    return F.when(F.sum(n) > 0, F.sum(s) / F.sum(n))


def score(xx: DataFrame, xy: DataFrame, lam: float = 1.0) -> DataFrame:
    """(j, score) of every y, from the sums of the sample and those of the sample with the other."""
    own = xx.agg(mean().alias("own"))
    return xy.groupBy("j").agg(mean().alias("cross")).join(own).select("j", (F.lit(lam) * F.col("own") - 2 * F.col("cross")).alias("score"))


def expected_score(xx: DataFrame, xy: DataFrame, lam: float = 1.0) -> DataFrame:
    return score(xx, xy, lam).agg(F.avg("score").alias("score"))


def mmd(xx: DataFrame, yy: DataFrame, xy: DataFrame) -> DataFrame:
    """The unbiased squared discrepancy, from sums."""
    a, b, c = xx.agg(mean().alias("a")), yy.agg(mean().alias("b")), xy.agg(mean().alias("c"))
    return a.join(b).join(c).select((F.col("a") + F.col("b") - 2 * F.col("c")).alias("mmd"))
