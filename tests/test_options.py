"""Queries of options against their SQL in DuckDB, and what SQL does not say against the algebra."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom import options, queries
from pathloom.functions import branched, kernels, tensor, trees
from pathloom.operators import features, gram

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(options.ORACLE_SQL))
def test_sql(spark, duck, name):
    df = (queries.QUERIES | options.QUERIES)[name](spark, SF)
    rel = duck.execute(options.ORACLE_SQL[name])
    at = {c[0]: k for k, c in enumerate(rel.description)}
    want = sorted(repr([r[at[c]] for c in sorted(at)]) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(at)
    assert sorted(repr([r[c] for c in sorted(at)]) for r in df.collect()) == want != []


def test_every_order_has_its_linear_signature(spark, duck):
    got = options.QUERIES["linear_sig_all"](spark, SF)
    assert got.count() == duck.execute("select count(*) from orders").fetchone()[0] > got.where("i < 3").count()


@pytest.mark.parametrize("name", [f"stream_{k}_windows" for k in ("sig", "log_sig", "branched_sig", "branched_log_sig")])
def test_streams_give_every_window(spark, name):
    got = options.QUERIES[name](spark, SF).select("key", "win").collect()
    sizes = {r.key: len(r.path) for r in queries.packed(spark, SF).collect()}
    assert sorted(map(tuple, got)) == [(k, w) for k in sorted(sizes) for w in range((sizes[k] - 16) // 8 + 1)]


def test_all_levels_are_returned(spark):
    paths = {r.key: np.array([list(p) for p in r.path])[None] for r in queries.packed(spark, SF).collect()}
    whole = options.QUERIES["sig_degree4_all"](spark, SF).collect()
    assert len(whole) == len(paths)
    for r in whole:
        assert np.allclose(r[1:], tensor.sig(paths[r.key], 4)[0], atol=1e-6) and len(r[1:]) == 30
    rows = options.QUERIES["prefix_table_degree3_all"](spark, SF).where("i in (0, 1, 17)").collect()
    assert len(rows) == 3 * len(paths)
    for r in rows:
        assert np.allclose(r[2:], tensor.sig(paths[r.key][:, : r.i + 1], 3)[0], atol=1e-8) and len(r[2:]) == 14


def test_gram_gradients(spark):
    v = options.corners(spark, SF)
    a, b = v.where("label = 0"), v.where("label = 1")
    weights = a.select(F.col("key").alias("i")).join(b.select(F.col("key").alias("j"))).withColumn("w", (F.col("i") % 3 + F.col("j") % 2).cast("double"))
    fn = lambda x, y: kernels.sig_kernel(x, y, 1, kernels.RBFKernel(3.0))
    got = {r.i: np.array(r.gradient) for r in gram.gradients(fn, a, b, weights).collect()}
    y = b.orderBy("key").collect()
    ys = np.array([[list(p) for p in r.path] for r in y])
    for r in a.limit(3).collect():
        x, w = np.array([list(p) for p in r.path]), np.array([r.key % 3 + s.key % 2 for s in y], dtype=float)
        for k in range(x.size):
            step = np.zeros(x.size)
            step[k] = 1e-5
            up, down = (w @ fn(np.repeat((x + s * step.reshape(x.shape))[None], len(y), 0), ys) for s in (1, -1))
            assert got[r.key][k] == pytest.approx((up - down) / 2e-5, abs=1e-5, rel=1e-6)


def test_kernels_of_whole_paths(spark):
    v = {r.key: (r.label, np.array(r.path)) for r in queries.vectors(spark, SF).collect()}
    x, y = (np.array([p for _, (n, p) in sorted(v.items()) if n == label]) for label in (0, 1))
    first = {label: min(k for k, (n, _) in v.items() if n == label) for label, _ in v.values()}
    rows = options.QUERIES["sig_kernel_statics"](spark, SF).where("key % 20 = 0").collect()
    for r in rows:
        label, a = v[r.key]
        b = v[first[label]][1]
        for got, static in ((r.linear, kernels.LinearKernel()), (r.matern32, kernels.Matern32Kernel(1.5)), (r.polynomial, kernels.PolynomialKernel(2, 1.0, 0.5))):
            assert got == pytest.approx(kernels.sig_kernel(a[None], b[None], 0, static)[0], abs=1e-8, rel=1e-9)
    keys = sorted(k for k, (label, _) in v.items() if label == 0)
    got = {(r.i, r.pos): r.g for r in options.QUERIES["sig_kernel_gram_backprop"](spark, SF).collect()}
    assert len(got) == len(x) * 64
    for at, pos in ((0, 0), (0, 20), (3, 35), (5, 63)):
        step = np.zeros(64)
        step[pos] = 1e-5
        up, down = (kernels.sig_kernel(np.repeat((x[at] + s * step.reshape(32, 2))[None], len(y), 0), y, 0).sum() for s in (1, -1))
        assert got[keys[at], pos] == pytest.approx((up - down) / 2e-5, abs=1e-4, rel=1e-5)


@pytest.mark.parametrize("name", ["sig_kernel_gram", "branched_sig_kernel_gram"])
def test_each_label_has_its_gram_matrix(spark, name):
    v = queries.vectors(spark, SF)
    want = {(a, b) for own in v.groupBy("label").agg(F.collect_list("key").alias("keys")).collect() for a in own["keys"] for b in own["keys"]}
    got = queries.QUERIES[name](spark, SF).collect()
    assert len(got) == len(want) and {(r.i, r.j) for r in got} == want
    values, paths = {(r.i, r.j): r.k for r in got}, {r.key: np.array([list(p) for p in r.path])[None] for r in v.collect()}
    one = (lambda x, y: kernels.sig_kernel(x, y, 0, kernels.RBFKernel(4.0))) if name == "sig_kernel_gram" else (lambda x, y: kernels.branched_sig_kernel(x, y, 2, dyadic_order=0))
    for a, b in sorted(want)[::3000]:
        assert values[a, b] == values[b, a] == pytest.approx(one(paths[a], paths[b])[0])


def test_gram_of_null_labels(spark):
    rows = [(k, label, [[0.0, 0.0], [0.1 * k, 0.2]]) for k, label in enumerate([0, 0, 1, None, None])]
    df = spark.createDataFrame(rows, "key long, label int, path array<array<double>>")
    got = {(r.i, r.j) for r in gram.gram(gram.sig_kernel(dyadic_order=0), df, by="label").collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 3), (3, 4), (4, 3), (4, 4)}


def test_flags(spark):
    x = np.random.default_rng(3).standard_normal((5, 2))
    df = spark.createDataFrame([(x.tolist(),), (None,)], "path array<array<double>>")
    s = tensor.transform_path(x[None], True, True, 2.0)
    how = dict(time_aug=True, lead_lag=True, end_time=2.0)
    cases = [
        (features.log_sig("path", 2, 0, scalar_term=True, **how), np.concatenate([[0.0], tensor.log_sig(s, 2, 0)[0]])),
        (features.sig_coef("path", [(4, 0)], **how), tensor.coefficients(s, [(4, 0)])[0]),
        (features.branched_sig("path", 2, scalar_term=True, **how), np.concatenate([[1.0], branched.sig(s, 2)[0]])),
        (features.branched_sig_coef("path", [((4,), 0)], **how), branched.coefficients(s, [((4,), 0)])[0]),
        (features.branched_log_sig("path", 2, True, **how), branched.log_sig(s, 2, True)[0]),
    ]
    for column, want in cases:
        first, null = (r[0] for r in df.select(column).collect())
        assert np.allclose(first, want) and null is None
    pair = spark.createDataFrame([(x.tolist(), x[::-1].tolist())], "pa array<array<double>>, pb array<array<double>>")
    t = tensor.transform_path(x[None, ::-1], True, True, 2.0)
    assert pair.select(gram.sig_kernel(dyadic_order=0, **how)).first()[0] == pytest.approx(kernels.sig_kernel(s, t, 0)[0])
    assert pair.select(gram.branched_sig_kernel(depth=2, **how)).first()[0] == pytest.approx(kernels.branched_sig_kernel(s, t, 2)[0])
    with pytest.raises(ValueError):
        features.log_sig("path", 2, 1, scalar_term=True)


def test_extract_forests(spark):
    x = np.random.default_rng(4).standard_normal((1, 6, 2))
    basis = trees.forests(2, 2)
    df = spark.createDataFrame([(x[0].tolist(),)], "path array<array<double>>").select(features.branched_sig("path", 2, True, scalar_term=True).alias("b"))
    got = df.select(*features.extract_branched_sig_coef("b", [basis[3], (), basis[0]], 2, 2, True, True)).first()
    want = branched.sig(x, 2, True)[0]
    assert np.allclose(list(got), [want[3], 1.0, want[0]])


def test_batches_of_odd_rows(spark):
    """Null, empty and ragged paths, nulls within, and single points, in one batch and alone."""
    rows = [([[0.0, 0.0], [1.0, 2.0], [3.0, 1.0]],), (None,), ([],), ([[0.0, None], [1.0, 2.0]],), ([[0.0, 0.0], None],), ([[0.0, 0.0], [1.0]],), ([[4.0, 5.0]],), ([[0.0], [2.0]],)]
    want = [[3.0, 1.0, 4.5, -1.0, 4.0, 0.5], None, None, None, None, None, [0.0] * 6, [2.0, 2.0]]
    schema = "k int, path array<array<double>>"
    for some in (range(len(rows)), *[[k] for k in range(len(rows))]):
        df = spark.createDataFrame([(k, *rows[k]) for k in some], schema).coalesce(1)
        got = {r.k: r.s for r in df.select("k", features.sig("path", 2).alias("s")).collect()}
        assert got == {k: want[k] for k in some}
    assert spark.createDataFrame([], schema).select(features.sig("path", 2)).count() == 0
