"""One query for each operator, over events, orders and embeddings, and the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import plans, sources
from .functions import branched, kernels, products, tensor, trees, words
from .operators import bases, cascade, features, gram, paths
from .streaming import frames

POINTS = """
p as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value / 97.0 as x0,
             (row_number() over (partition by user_id order by ts, event_id) - 1) / 100.0 as x1 from events),
d as (select *, coalesce(x0 - lag(x0) over w, 0) as d0, coalesce(x1 - lag(x1) over w, 0) as d1,
             coalesce(lag(x0) over w, x0) - first_value(x0) over w as b0, coalesce(lag(x1) over w, x1) - first_value(x1) over w as b1
      from p window w as (partition by key order by i)),
s as (select key, sum(d0) as s0, sum(d1) as s1, sum(b0 * d0 + d0 * d0 / 2) as s00, sum(b0 * d1 + d0 * d1 / 2) as s01,
             sum(b1 * d0 + d1 * d0 / 2) as s10, sum(b1 * d1 + d1 * d1 / 2) as s11 from d group by key)
"""
W2 = words.words(2, 2)
NAMES = [cascade.name(w) for w in W2]


def rounded(df, columns, keys=("key",), digits=6):
    return df.select(*keys, *[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) for c in columns])


def spread(df, column, names, keys=("key",), digits=6):
    return df.select(*keys, *[(F.round(F.element_at(column, i + 1), digits) + F.lit(0.0)).alias(n) for i, n in enumerate(names)])


def pick(expr: dict[str, str], source="s", keys="key") -> str:
    return f"with {POINTS} select {keys}, " + ", ".join(f"round({e}, 6) + 0.0 as {n}" for n, e in expr.items()) + f" from {source}"


S2 = {n: n for n in NAMES}
LOG2 = {"l0": "s0", "l1": "s1", "l01": "(s01 - s10) / 2"}
#: The planar forests of two nodes, as {name: SQL}: two roots a, b in this order are the word (a, b), as is the chain.
FOREST2 = {"f" + str(i): "s" + "".join(map(str, branched.hopf(2, 2, True).labels[i])) for i in range(10)}


def points(spark, d):
    return sources.event_points(spark, d)


def packed(spark, d):
    return paths.pack(points(spark, d))


def on_path(feature, names):
    return lambda spark, d: spread(packed(spark, d).select("key", feature.alias("s")), "s", names)


def halves(spark, d):
    """Users' paths cut in two at the middle point."""
    p = packed(spark, d)
    m = F.floor(F.size("path") / 2).cast("int")
    return p.select("key", F.slice("path", F.lit(1), m + 1).alias("a"), F.slice("path", m + 1, F.size("path")).alias("b"))


def combined(one, product, names):
    return lambda spark, d: spread(halves(spark, d).select("key", one("a").alias("a"), one("b").alias("b")).select("key", product("a", "b").alias("s")), "s", names)


def last_step(spark, d):
    p = packed(spark, d)
    end, before = F.element_at("path", -1), F.element_at("path", -2)
    return p.select("key", F.slice("path", F.lit(1), F.size("path") - 1).alias("head"), F.zip_with(end, before, lambda x, y: x - y).alias("delta"), F.element_at("path", 1).alias("first"), "path")


def joined(head, join, names):
    return lambda spark, d: spread(last_step(spark, d).select("key", head.alias("h"), "delta").select("key", join("h", "delta").alias("s")), "s", names)


def vectors(spark, d):
    return sources.vector_paths(spark, d)


def two_labels(spark, d):
    v = vectors(spark, d)
    return v.where("label = 0"), v.where("label = 1")


def small_kernel():
    return products.SigKernel(0, kernels.RBFKernel(4.0))


def branched_kernel():
    return products.BranchedSigKernel(2)


def compared(what, kernel, a, b):
    """The score of each b for the sample a, its mean, or their discrepancy."""
    blocks = gram.blocks_for(a, b)
    xx, xy = gram.sums(kernel, a, blocks=blocks), gram.sums(kernel, a, b, blocks)
    if what == "mmd":
        return gram.mmd(xx, gram.sums(kernel, b, blocks=blocks), xy)
    return {"score": gram.score, "expected": gram.expected_score}[what](xx, xy)


def metric(what, kernel):
    return lambda spark, d: compared(what, kernel(), *two_labels(spark, d))


def against_first(kernel):
    """A kernel of each vector's path with the path one label on."""

    def run(spark, d):
        v = vectors(spark, d)
        other = v.groupBy("label").agg(F.min_by("path", "key").alias("pb"))
        return v.withColumnRenamed("path", "pa").join(other, "label").select("key", F.round(kernel(), 9).alias("k"))

    return run


def vjp_query(fn, column="path", source=packed):
    """Gradient of the sum of all outputs of fn with respect to a user's path."""

    def run(spark, d):
        df = source(spark, d)
        return df.select("key", F.transform(features.whole_gradient(fn, column), lambda v: F.round(v, 6)).alias("gradient"))

    return run


def vjp_of(inputs, columns, fn, n):
    """Gradients of the sum of all n outputs of fn with respect to each of the columns that inputs makes."""

    def run(spark, d):
        ones = inputs(spark, d).withColumn("c", F.array_repeat(F.lit(1.0), n))
        grads = features.gradient(fn, "c", *columns)
        return ones.select("key", F.transform(grads, lambda g: F.transform(g, lambda v: F.round(v, 6))).alias("gradient"))

    return run


def half_features(one):
    return lambda spark, d: halves(spark, d).select("key", one("a").alias("a"), one("b").alias("b"))


def last_features(one):
    return lambda spark, d: last_step(spark, d).select("key", one("head").alias("h"), "delta")


def path_feature(one):
    return lambda spark, d: packed(spark, d).select("key", one("path").alias("g"))


def augmented(spark, d):
    return paths.time_augment(points(spark, d).select("key", "i", "x0"))


def interval_query(spark, d):
    p = points(spark, d)
    wanted = p.groupBy("key").agg(F.count("*").alias("n")).select("key", F.floor(F.col("n") / 4).alias("a"), F.floor(F.col("n") / 2).alias("b"))
    return spread(frames.intervals(frames.prefix_table(p, 2), wanted, 2, 2), "s", NAMES, ("key", "a", "b"))


def window_query(feature, names, window=16, stride=8):
    return lambda spark, d: spread(frames.window_features(points(spark, d), window, stride, feature), "s", names, ("key", "win"))


CHAIN_NAMES = ["t0", "t1", "t00", "t01", "t10", "t11"]
QUERIES = {
    "sig_words": lambda spark, d: rounded(cascade.coefficients(points(spark, d), W2, prefixes=True), NAMES),
    "sig_plan_degree1": lambda spark, d: spread(plans.signature(points(spark, d), 1), "s", ["s0", "s1"]),
    "sig_plan_degree2": lambda spark, d: spread(plans.signature(points(spark, d), 2), "s", NAMES),
    "sig_one_channel": lambda spark, d: spread(plans.signature(points(spark, d).select("key", "i", "x0"), 3), "s", ["s0", "s00", "s000"]),
    "sig": lambda spark, d: on_path(features.sig("path", 2), NAMES)(spark, d),
    "sig_degree4": lambda spark, d: spread(plans.signature(points(spark, d), 4), "s", NAMES),
    "sig_long_paths": lambda spark, d: spread(features.long_path_sig(points(spark, d), 2, chunk=16, fan=4), "s", NAMES),
    "sig_coef_010": lambda spark, d: rounded(cascade.coefficients(points(spark, d), [(0, 1, 0)]), ["s010"]),
    "sig_coef_udf": lambda spark, d: on_path(features.sig_coef("path", [(0, 1), (1, 0)]), ["s01", "s10"])(spark, d),
    "extract_sig_coef": lambda spark, d: rounded(packed(spark, d).select("key", features.sig("path", 3).alias("s")).select("key", *features.extract_sig_coef("s", [(1,), (0, 1)], 2)), ["s1", "s01"]),
    "sig_combine": lambda spark, d: combined(lambda c: features.sig(c, 2), lambda a, b: features.sig_combine(a, b, 2, 2), NAMES)(spark, d),
    "sig_join": lambda spark, d: joined(features.sig("head", 2), lambda h, x: features.sig_join(h, x, 2, 2), NAMES)(spark, d),
    "transform_time": lambda spark, d: augmented(spark, d).select("key", "i", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1")),
    "transform_lead_lag": lambda spark, d: paths.lead_lag(points(spark, d).select("key", "i", "x0")).select("key", "i", F.round("x0", 6).alias("lag"), F.round("x1", 6).alias("lead")),
    "linear_sig": lambda spark, d: sources.order_points(spark, d).where("i < 3").select("key", "i", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in paths.linear_sig([F.col("x0"), F.col("x1")], 2).items()]),
    "linear_log_sig": lambda spark, d: spread(last_step(spark, d).select("key", features.linear_log_sig("delta", 2).alias("s")), "s", ["l0", "l1", "l01"]),
    "log_sig": lambda spark, d: on_path(features.log_sig("path", 2, 1), list(LOG2))(spark, d),
    "log_sig_method2": lambda spark, d: on_path(features.log_sig("path", 2, 2), list(LOG2))(spark, d),
    "sig_to_log_sig": lambda spark, d: spread(packed(spark, d).select("key", features.sig("path", 2).alias("g")).select("key", features.sig_to_log_sig("g", 2, 2).alias("s")), "s", list(LOG2)),
    "logsig_to_sig": lambda spark, d: spread(packed(spark, d).select("key", features.log_sig("path", 2).alias("g")).select("key", features.logsig_to_sig("g", 2, 2).alias("s")), "s", NAMES),
    "log_sig_combine": lambda spark, d: combined(lambda c: features.log_sig(c, 2, 2), lambda a, b: features.log_sig_combine(a, b, 2, 2), list(LOG2))(spark, d),
    "log_sig_join": lambda spark, d: joined(features.log_sig("head", 2, 2), lambda h, x: features.log_sig_join(h, x, 2, 2), list(LOG2))(spark, d),
    "branched_sig": lambda spark, d: on_path(features.branched_sig("path", 2), CHAIN_NAMES)(spark, d),
    "branched_sig_planar": lambda spark, d: on_path(features.branched_sig("path", 2, True), list(FOREST2))(spark, d),
    "branched_sig_combine": lambda spark, d: combined(lambda c: features.branched_sig(c, 2), lambda a, b: features.branched_sig_combine(a, b, 2, 2), CHAIN_NAMES)(spark, d),
    "branched_sig_join": lambda spark, d: joined(features.branched_sig("head", 2), lambda h, x: features.branched_sig_join(h, x, 2, 2), CHAIN_NAMES)(spark, d),
    "branched_sig_coef": lambda spark, d: on_path(features.branched_sig_coef("path", [((0,), 1), (1,)]), ["t01", "t1"])(spark, d),
    "branched_log_sig": lambda spark, d: on_path(features.branched_log_sig("path", 2), CHAIN_NAMES)(spark, d),
    "branched_log_sig_planar": lambda spark, d: on_path(features.branched_log_sig("path", 3, True, 2), [f"l{i}" for i in range(trees.branched_log_sig_length(2, 3, planar=True))])(spark, d),
    "branched_sig_to_log_sig": lambda spark, d: spread(packed(spark, d).select("key", features.branched_sig("path", 2).alias("g")).select("key", features.branched_sig_to_log_sig("g", 2, 2).alias("s")), "s", CHAIN_NAMES),
    "branched_log_sig_join": lambda spark, d: joined(features.branched_log_sig("head", 2, True, 2), lambda h, x: features.branched_log_sig_join(h, x, 2, 2), [f"l{i}" for i in range(7)])(spark, d),
    "linear_branched_sig": lambda spark, d: spread(last_step(spark, d).select("key", features.linear_branched_sig("delta", 2).alias("s")), "s", CHAIN_NAMES),
    "linear_branched_log_sig": lambda spark, d: spread(last_step(spark, d).select("key", features.linear_branched_log_sig("delta", 2).alias("s")), "s", CHAIN_NAMES),
    "prefix_table": lambda spark, d: spread(frames.prefix_table(points(spark, d), 2), "s", NAMES, ("key", "i")),
    "prefix_table_degree3": lambda spark, d: spread(frames.prefix_table(points(spark, d), 3), "s", NAMES, ("key", "i")),
    "interval_sig": interval_query,
    "window_sig": lambda spark, d: window_query(features.sig("path", 2), NAMES)(spark, d),
    "window_log_sig": lambda spark, d: window_query(features.log_sig("path", 2, 2), list(LOG2))(spark, d),
    "window_branched_sig": lambda spark, d: window_query(features.branched_sig("path", 2), CHAIN_NAMES)(spark, d),
    "words_table": lambda spark, d: bases.word_table(spark, 3, 4),
    "lyndon_words_table": lambda spark, d: bases.lyndon_word_table(spark, 2, 6),
    "trees_table": lambda spark, d: bases.element_table(spark, 2, 4, "tree"),
    "forests_table": lambda spark, d: bases.element_table(spark, 2, 4, "forest"),
    "lyndon_forests_table": lambda spark, d: bases.element_table(spark, 2, 4, "lyndon"),
    "sig_kernel": against_first(lambda: gram.sig_kernel(dyadic_order=1)),
    "sig_kernel_polynomial": against_first(lambda: gram.sig_kernel(method="polynomial", order=6)),
    "sig_kernel_normalized": against_first(lambda: gram.sig_kernel(dyadic_order=0, static=kernels.RBFKernel(4.0), normalize=True)),
    "branched_sig_kernel": against_first(lambda: gram.branched_sig_kernel(depth=3, dyadic_order=0)),
    "branched_sig_kernel_polynomial": against_first(lambda: gram.branched_sig_kernel(depth=3, method="polynomial", order=2)),
    "branched_sig_kernel_depth1": against_first(lambda: gram.branched_sig_kernel(depth=1, dyadic_order=0)),
    "sig_kernel_gram": lambda spark, d: gram.gram(small_kernel(), vectors(spark, d), by="label"),
    "branched_sig_kernel_gram": lambda spark, d: gram.gram(branched_kernel(), vectors(spark, d), by="label"),
    "sig_score": metric("score", small_kernel),
    "expected_sig_score": metric("expected", small_kernel),
    "sig_mmd": metric("mmd", small_kernel),
    "branched_sig_score": metric("score", branched_kernel),
    "expected_branched_sig_score": metric("expected", branched_kernel),
    "branched_sig_mmd": metric("mmd", branched_kernel),
    "sig_backprop": vjp_query(lambda x: tensor.sig(x, 3)),
    "log_sig_backprop": vjp_query(lambda x: tensor.log_sig(x, 3, 2)),
    "branched_sig_backprop": vjp_query(lambda x: branched.sig(x, 2)),
    "branched_log_sig_backprop": vjp_query(lambda x: branched.log_sig(x, 2, True, 1)),
    "transform_path_backprop": vjp_query(lambda x: tensor.transform_path(x, True, True)),
    "sig_kernel_backprop": vjp_query(lambda x: kernels.sig_kernel(x, x[:, ::-1], 0, kernels.RBFKernel(2.0)), source=vectors),
    "branched_sig_kernel_backprop": vjp_query(lambda x: kernels.branched_sig_kernel(x, x[:, ::-1], 2), source=vectors),
    "sig_combine_backprop": vjp_of(half_features(lambda c: features.sig(c, 2)), "ab", lambda a, b: tensor.combine(a, b, 2, 2), 6),
    "sig_join_backprop": vjp_of(last_features(lambda c: features.sig(c, 2)), ("h", "delta"), lambda h, x: tensor.join(h, x, 2, 2, False), 6),
    "sig_to_log_sig_backprop": vjp_of(path_feature(lambda c: features.sig(c, 2)), "g", lambda g: tensor.sig_to_log_sig(g, 2, 2, 2), 3),
    "logsig_to_sig_backprop": vjp_of(path_feature(lambda c: features.log_sig(c, 2, 2)), "g", lambda g: tensor.log_sig_to_sig(g, 2, 2, 2), 6),
    "log_sig_combine_backprop": vjp_of(half_features(lambda c: features.log_sig(c, 2, 2)), "ab", lambda a, b: tensor.log_combine(a, b, 2, 2, 2), 3),
    "log_sig_join_backprop": vjp_of(last_features(lambda c: features.log_sig(c, 2, 2)), ("h", "delta"), lambda h, x: tensor.log_join(h, x, 2, 2, 2), 3),
    "branched_sig_combine_backprop": vjp_of(half_features(lambda c: features.branched_sig(c, 2)), "ab", lambda a, b: branched.combine(a, b, 2, 2), 6),
    "branched_sig_to_log_sig_backprop": vjp_of(path_feature(lambda c: features.branched_sig(c, 2)), "g", lambda g: branched.to_log(g, 2, 2, False, None), 6),
}

_PRE = f"""with {POINTS}, r as (select key, i, sum(d0) over w as s0, sum(d1) over w as s1, sum(b0 * d0 + d0 * d0 / 2) over w as s00,
  sum(b0 * d1 + d0 * d1 / 2) over w as s01, sum(b1 * d0 + d1 * d0 / 2) over w as s10, sum(b1 * d1 + d1 * d1 / 2) over w as s11
  from d window w as (partition by key order by i))"""
_ROUND = ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in NAMES)
_WIN = """with q as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) - 1 as j, value / 97.0 as x0,
   (row_number() over (partition by user_id order by ts, event_id) - 1) / 100.0 as x1, count(*) over (partition by user_id) as n from events),
p as (select key, win, j as i, x0, x1 from (select *, unnest(range(greatest(0, ceil((j - 15) / 8.0))::bigint, least(j // 8, (n - 16) // 8)::bigint + 1)) as win from q where n >= 16)),
d as (select *, coalesce(x0 - lag(x0) over w, 0) as d0, coalesce(x1 - lag(x1) over w, 0) as d1,
             coalesce(lag(x0) over w, x0) - first_value(x0) over w as b0, coalesce(lag(x1) over w, x1) - first_value(x1) over w as b1
      from p window w as (partition by key, win order by i)),
s as (select key, win, sum(d0) as s0, sum(d1) as s1, sum(b0 * d0 + d0 * d0 / 2) as s00, sum(b0 * d1 + d0 * d1 / 2) as s01,
             sum(b1 * d0 + d1 * d0 / 2) as s10, sum(b1 * d1 + d1 * d1 / 2) as s11 from d group by key, win)
"""
_TREE = {"t" + n[1:]: n for n in NAMES}
_TLOG = {"t0": "s0", "t1": "s1", **{f"t{a}{b}": f"s{a}{b} - s{a} * s{b} / 2" for a in "01" for b in "01"}}
_STEP = f"with {POINTS}, e as (select key, d0 as s0, d1 as s1 from (select *, row_number() over (partition by key order by i desc) as back from d) where back = 1)"
_LINEAR = {"0": "s0", "1": "s1", "00": "s0 * s0 / 2", "01": "s0 * s1 / 2", "10": "s1 * s0 / 2", "11": "s1 * s1 / 2"}

ORACLE_SQL = {
    **{n: pick(S2) for n in ("sig_words", "sig_plan_degree2", "sig", "sig_degree4", "sig_long_paths", "sig_combine", "sig_join", "logsig_to_sig")},
    "sig_plan_degree1": pick({"s0": "s0", "s1": "s1"}),
    "sig_one_channel": pick({"s0": "s0", "s00": "s0 * s0 / 2", "s000": "s0 * s0 * s0 / 6"}),
    "sig_coef_udf": pick({"s01": "s01", "s10": "s10"}),
    "extract_sig_coef": pick({"s1": "s1", "s01": "s01"}),
    "sig_coef_010": f"""with {POINTS}, a as (select *, sum(b0 * d1 + d0 * d1 / 2) over (partition by key order by i) as c01 from d),
      b as (select *, coalesce(lag(c01) over (partition by key order by i), 0) as p01 from a)
      select key, round(sum(p01 * d0 + b0 * d1 * d0 / 2 + d0 * d1 * d0 / 6), 6) as s010 from b group by key""",
    "transform_time": f"with {POINTS} select key, i, round(x0, 6) as x0, round(i * 1.0 / (count(*) over (partition by key) - 1), 6) as x1 from p",
    "transform_lead_lag": f"with {POINTS}, n as (select *, lead(x0) over (partition by key order by i) as nx from p) select key, 2 * i as i, round(x0, 6) as lag, round(x0, 6) as lead from n union all select key, 2 * i + 1, round(x0, 6), round(nx, 6) from n where nx is not null",
    "linear_sig": "with q as (select o_custkey as key, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as i, o_totalprice / 97000.0 as s0 from orders), r as (select *, i / 100.0 as s1 from q where i < 3) select key, i, "
    + ", ".join(f"round({e}, 6) + 0.0 as s{n}" for n, e in _LINEAR.items())
    + " from r",
    "linear_log_sig": _STEP + " select key, round(s0, 6) as l0, round(s1, 6) as l1, 0.0::double as l01 from e",
    **{n: pick(LOG2) for n in ("log_sig", "log_sig_method2", "sig_to_log_sig", "log_sig_combine", "log_sig_join")},
    **{n: pick(_TREE) for n in ("branched_sig", "branched_sig_combine", "branched_sig_join")},
    "branched_sig_planar": pick(FOREST2),
    "branched_sig_coef": pick({"t01": "s01", "t1": "s1"}),
    **{n: pick(_TLOG) for n in ("branched_log_sig", "branched_sig_to_log_sig")},
    "linear_branched_sig": _STEP + " select key, " + ", ".join(f"round({e}, 6) + 0.0 as t{n}" for n, e in _LINEAR.items()) + " from e",
    **{n: f"{_PRE} select key, i, {_ROUND} from r" for n in ("prefix_table", "prefix_table_degree3")},
    "window_sig": _WIN + f"select key, win, {_ROUND} from s",
    "window_log_sig": _WIN + "select key, win, " + ", ".join(f"round({e}, 6) + 0.0 as {n}" for n, e in LOG2.items()) + " from s",
    "window_branched_sig": _WIN + "select key, win, " + ", ".join(f"round({e}, 6) + 0.0 as {n}" for n, e in _TREE.items()) + " from s",
    "words_table": "with recursive w(idx, level, word) as (select 0::bigint, 0, '' union all select idx * 3 + x + 1, level + 1, case when level = 0 then x::varchar else word || ',' || x end from w, (select unnest(range(3)) as x) where level < 4) select idx - 1 as idx, level, word from w where level > 0",
    "branched_sig_kernel_depth1": """with q as (select vec_id as key, label, embedding[1]::double as a0, embedding[2]::double as a1, embedding[63]::double as z0, embedding[64]::double as z1 from embeddings),
      f as (select label, min_by(z0 - a0, key) as e0, min_by(z1 - a1, key) as e1 from q group by label)
      select key, round(exp((z0 - a0) * e0 + (z1 - a1) * e1), 9) as k from q join f using (label)""",
}
