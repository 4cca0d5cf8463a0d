import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom import plans
from pathloom.functions import kernels, tensor
from pathloom.operators import cascade, features, gram, paths
from pathloom.streaming import frames, state

RNG = np.random.default_rng(0)
PATHS = {k: RNG.standard_normal((n, 2)).round(3) for k, n in enumerate((1, 2, 5, 40, 41))}


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(k, i, float(a), float(b)) for k, x in PATHS.items() for i, (a, b) in enumerate(x)], "key long, i long, x0 double, x1 double")


def test_plans_agree(points):
    for degree, long in ((1, False), (2, False), (3, False), (3, True)):
        got = {r.key: r.s for r in plans.signature(points, degree, long).collect()}
        for k, x in PATHS.items():
            assert np.allclose(got[k], tensor.sig(x[None], degree)[0]), (degree, long, k)
    got = {r.key: r.s for r in features.long_path_sig(points, 2, chunk=4, fan=2).collect()}
    assert all(np.allclose(got[k], tensor.sig(x[None], 2)[0]) for k, x in PATHS.items())


def test_words_intervals_windows(points):
    got = {r.key: r.s010 for r in cascade.coefficients(points, [(0, 1, 0)]).collect()}
    assert all(np.isclose(got[k], tensor.coefficients(x[None], [(0, 1, 0)])[0, 0]) for k, x in PATHS.items())
    wanted = points.where("key >= 3").select("key").distinct().select("key", F.lit(3).cast("long").alias("a"), F.lit(30).cast("long").alias("b"))
    for r in frames.intervals(frames.prefix_table(points, 3), wanted, 2, 3).collect():
        assert np.allclose(r.s, tensor.sig(PATHS[r.key][None, 3:31], 3)[0])
    for stride in (2, 7):
        rows = frames.window_features(points, 5, stride, features.sig("path", 2)).collect()
        assert sorted((r.key, r.win) for r in rows) == [(k, w) for k, x in PATHS.items() for w in range((len(x) - 5) // stride + 1) if len(x) >= 5]
        assert all(np.allclose(r.s, tensor.sig(PATHS[r.key][None, r.win * stride : r.win * stride + 5], 2)[0]) for r in rows)


def test_nulls_and_gram(spark, points):
    p = paths.pack(points.union(spark.createDataFrame([(9, 0, None, 1.0)], "key long, i long, x0 double, x1 double")))
    assert {r.key: r.s for r in p.select("key", features.sig("path", 2).alias("s")).collect()}[9] is None
    p = p.where("key in (3, 4)")
    got = {(r.i, r.j): r.k for r in gram.normalized(gram.gram(gram.sig_kernel(dyadic_order=0, static=kernels.RBFKernel(50.0)), p)).collect()}
    assert len(got) == 4 and np.isclose(got[3, 3], 1) and np.isclose(got[3, 4], got[4, 3])


def test_streams():
    x = RNG.standard_normal((30, 2))
    s = state.SigStream(2, 3)
    s.push(x[0])
    s.push(x[1])
    s.push_batch(x[2:10])
    assert len(s) == 3 and np.allclose(s.sig(1, 2), tensor.sig(x[None, 1:10], 3)[0])
    s.pop_front()
    assert np.allclose(s.sig_all()[-1], tensor.sig(x[None, :10], 3)[0])
    with pytest.raises(IndexError):
        s.sig(0, 2)
    for cls, how in ((state.LogSigStream, {}), (state.BranchedSigStream, {}), (state.BranchedLogSigStream, {"planar": True})):
        t = cls(2, 3, **how)
        t.push_batch(x[:9])
        t.push_batch(x[9:])
        one = cls(2, 3, **how)
        one.push_batch(x)
        assert len(t) == 3 and np.allclose(t.sig(0, 2), one.sig(0, 1))
    w = state.SigWindowStream(2, 2, 4, 6)
    with pytest.raises(ValueError):
        w.sig()
    for a in range(0, 30, 5):
        w.push_batch(x[a : a + 5])
    assert np.allclose(w.sig(), np.stack([tensor.sig(x[None, a : a + 4], 2)[0] for a in range(0, 27, 6)]))


def test_structured_streaming(spark, points, tmp_path):
    points.where("i < 20").coalesce(1).write.parquet(f"{tmp_path}/in")
    points.where("i >= 20").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = frames.stream_windows(stream, "key", ["i"], ["x0", "x1"], 2, 5, 3).writeStream.format("memory").queryName("wins").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, r.win): r.s for r in spark.table("wins").collect()}
    want = {(r.key, r.win): r.s for r in frames.window_features(points, 5, 3, features.sig("path", 2)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_structured_streaming_of_logs_and_trees(spark, points, tmp_path):
    few = points.where("key in (3, 4)")
    few.where("i < 20").coalesce(1).write.parquet(f"{tmp_path}/in")
    few.where("i >= 20").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    xy = ["x0", "x1"]
    found = {
        "logwins": (frames.stream_windows(stream, "key", ["i"], xy, 3, 5, 3, kind=state.LogSigWindowStream), state.LogSigWindowStream(2, 3, 5, 3)),
        "treelogs": (frames.stream_signatures(stream, "key", ["i"], xy, 2, planar=False, method=0), state.BranchedLogSigStream(2, 2, False, 0)),
    }
    rows = {k: [r.x for r in few.where(f"key = {k}").orderBy("i").selectExpr("array(x0, x1) as x").collect()] for k in (3, 4)}
    for name, (df, one) in found.items():
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        for k, x in rows.items():
            got = [r.s for r in spark.table(name).where(f"key = {k}").orderBy("win" if name == "logwins" else "n").collect()]
            s = type(one)(2, 3, 5, 3) if name == "logwins" else type(one)(2, 2, False, 0)
            s.push_batch(np.array(x))
            assert np.allclose(got, s.sig()) if name == "logwins" else np.allclose(got[-1], s.sig(0, 1))
