"""Kernels of many pairs: what is held at once, and all pairs of two samples by blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom import options, queries
from pathloom.functions import kernels, products, tape
from pathloom.operators import features, gram

POINTS = 32


def many(spark, n):
    """n paths of 32 points, in one partition, and so in Arrow batches of 10,000 rows."""
    step = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.array(F.cos(i + F.col("id")), F.sin(i * F.col("id"))))
    return spark.range(0, n, 1, 1).select(F.col("id").alias("key"), step.alias("path"))


def test_pairs_held_at_once(spark):
    def fn(x, y):
        assert x.shape[0] * x.shape[1] * y.shape[1] <= gram.CELLS
        return (x[:, 1] * y[:, 2]).sum(axis=1)

    df = many(spark, 3000).select("path", F.reverse("path").alias("back"))
    rows = df.select("path", "back", gram.kernel(fn, "path", "back").alias("k")).collect()
    assert len(rows) == 3000
    for r in rows[::500]:
        assert np.isclose(r.k, np.dot(r.path[1], r.back[2]))


def test_paths_on_a_tape_at_once(spark):
    def fn(x):
        assert x.shape[0] <= features.TAPED
        return (x * x).sum(axis=2).sum(axis=1)

    rows = queries.vjp_query(fn, source=lambda s, _: many(s, 1500))(spark, "").collect()
    paths = {r.key: np.array(r.path).ravel() for r in many(spark, 1500).collect()}
    assert len(rows) == 1500 and all(np.allclose(r.gradient, 2 * paths[r.key], atol=1e-6) for r in rows)


def sample(seed, points=6, n=9, d=2, size=0.3):
    return np.random.default_rng(seed).standard_normal((n, points, d)) * size


def pairwise(fn, x, y):
    return fn(np.repeat(x, len(y), axis=0), np.tile(y, (len(x), 1, 1))).reshape(len(x), len(y))


SIG = [(o, s) for o in (0, 1, (1, 2)) for s in (None, kernels.ScaledLinearKernel(0.7), kernels.RBFKernel(4.0), kernels.Matern32Kernel(1.5))]


@pytest.mark.parametrize("size", [0.3, 4.0])  # features stand for the RBF kernel of the smaller one alone
def test_products_equal_pairs(size):
    x, y = sample(1, 6, size=size), sample(2, 4, 7, size=size)
    for order, static in SIG:
        want = pairwise(lambda u, v: kernels.sig_kernel(u, v, order, static), x, y)  # noqa: B023
        assert np.allclose(products.SigKernel(order, static).product(x, y), want, rtol=1e-9)
        own = pairwise(lambda u, v: kernels.sig_kernel(u, v, order, static), x, x)  # noqa: B023
        assert np.allclose(products.SigKernel(order, static).product(x), np.triu(own) + np.triu(own, 1).T, rtol=1e-9)
    x, y = x * min(1, 0.3 / size), y * min(1, 0.3 / size)
    for depth, order in ((0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0)):
        want = pairwise(lambda u, v: kernels.branched_sig_kernel(u, v, depth, order), x, y)  # noqa: B023
        assert np.allclose(products.BranchedSigKernel(depth, order).product(x, y), want, rtol=1e-12)


def test_gradients_equal_the_tape():
    x, y = sample(3, 6), sample(4, 4, 7)
    for k in (products.SigKernel(0), products.SigKernel((1, 2), kernels.ScaledLinearKernel(0.7)), products.SigKernel(0, kernels.RBFKernel(3.0)), products.BranchedSigKernel(1), products.BranchedSigKernel(2)):
        (want,) = tape.vjp(lambda v: k.fn(v, np.tile(y, (len(x), 1, 1))), [np.repeat(x, len(y), axis=0)], np.ones(len(x) * len(y)))  # noqa: B023
        assert np.allclose(k.gradient(x, y), want.reshape(len(x), len(y), *x.shape[1:]).sum(axis=1), rtol=1e-9)


def test_blocks_of_odd_rows(spark):
    """Paths of several lengths, a null one, equal keys and an order of refinement that isn't symmetric, against columns."""
    r = np.random.default_rng(5)
    rows = [(k // 2 if k < 4 else k, r.standard_normal((2 + k % 3, 2)).tolist() if k != 6 else None) for k in range(12)]
    left = spark.createDataFrame(rows, "key long, path array<array<double>>")
    right = spark.createDataFrame([(f"k{k}", p) for k, p in rows], "key string, path array<array<double>>")

    def values(df):
        return sorted((i, j, k if k is None else round(k, 9)) for i, j, k in df.select("i", "j", "k").collect())

    for order in (0, (0, 1)):
        block, column = products.SigKernel(order, kernels.RBFKernel(2.0)), gram.sig_kernel(dyadic_order=order, static=kernels.RBFKernel(2.0))
        key = lambda t: (*t[:2], t[2] is None, t[2] or 0)
        for how in ({}, {"half": True}, {"right": right}):
            assert sorted(values(gram.gram(block, left, **how)), key=key) == sorted(values(gram.gram(column, left, **how)), key=key)
        for other in (None, right):
            got, want = (sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in gram.sums(k, left, other).collect()) for k in (block, column))
            assert got == want
    empty = left.where("false")
    assert gram.score(gram.sums(block, empty), gram.sums(block, empty, right)).count() == 0
    assert gram.mmd(gram.sums(block, left.limit(1)), gram.sums(block, right), gram.sums(block, left, right)).first()[0] is None


@pytest.mark.parametrize("name", ["sig_kernel_gram", "branched_sig_kernel_gram", "sig_score", "branched_sig_mmd", "sig_expected_corners", "branched_sig_gram_depth1", "sig_kernel_gram_backprop", "branched_sig_kernel_gram_backprop_all"])
def test_no_row_for_each_pair_is_shuffled(spark, name):
    """A join of block pairs: at most two hundred for 56 paths or fewer a side, where pairs would be thousands."""
    made = []
    inner = gram.block_pairs

    def counted(*args):
        made.append(inner(*args))
        return made[-1]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(gram, "block_pairs", counted)
        (queries.QUERIES | options.QUERIES)[name](spark, "/root/testdata/sf0.001").explain()
    assert made and all(df.count() <= 64 * (10 if name.endswith("_gram") else 1) for df in made)
