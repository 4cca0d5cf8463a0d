"""Queries of the operators' options, of degree 3, of streams, of small kernels and of further gradients, with SQL made
from the definitions of iterated integrals."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from . import plans, queries as core
from .functions import branched, kernels, products, tensor, trees, words
from .operators import cascade, features, gram
from .streaming import frames, state

#: Values are multiples of 1 / (12 * 97 ** k * 10 ** 6): none ends on half a unit of this place.
DIGITS = 8
NAMES3 = [cascade.name(w) for w in words.words(2, 3)]
NAMES4 = [cascade.name(w) for w in words.words(2, 4)]
EVENTS = """select user_id as key, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value / 97.0 as x0,
 (row_number() over (partition by user_id order by ts, event_id) - 1) / 100.0 as x1, count(*) over (partition by user_id) as n from events"""
TIMED = f"select key, i, x0, i * 1.0 / (n - 1) as x1 from ({EVENTS})"
LEAD_LAG = f"""select key, 2 * i as i, x0, x0 as x1 from ({EVENTS}) union all
 select key, 2 * i + 1, x0, nx as x1 from (select *, lead(x0) over (partition by key order by i) as nx from ({EVENTS})) where nx is not null"""
_QUARTER = f"select key, i, x0, x1 from ({EVENTS}) where i >= n // 4 and i <= n // 2"
LAST_WINDOW = f"select key, i, x0, x1 from ({EVENTS}) where n >= 16 and i >= (n - 16) // 8 * 8 and i < (n - 16) // 8 * 8 + 16"


#: Every window as a path of its own, with {k: user, w: window} as its key.
WINDOWS = f"""select {{'k': key, 'w': win}} as key, i, x0, x1
 from (select *, unnest(range(greatest(0, ceil((i - 15) / 8.0))::bigint, least(i // 8, (n - 16) // 8)::bigint + 1)) as win from ({EVENTS}) where n >= 16)"""


def integrals(points: str) -> str:
    """CTEs up to s: the iterated integrals s0 ... s111 of each key's piecewise linear path (key, i, x0, x1)."""
    two = [(a, b) for a in "01" for b in "01"]
    step2 = {a + b: f"b{a} * d{b} + d{a} * d{b} / 2" for a, b in two}
    before = ", ".join(f"coalesce(sum({e}) over (partition by key order by i rows between unbounded preceding and 1 preceding), 0) as p{n}" for n, e in step2.items())
    sums = [f"sum(d{a}) as s{a}" for a in "01"] + [f"sum({e}) as s{n}" for n, e in step2.items()]
    sums += [f"sum(p{a}{b} * d{c} + b{a} * d{b} * d{c} / 2 + d{a} * d{b} * d{c} / 6) as s{a}{b}{c}" for a, b in two for c in "01"]
    moves = ", ".join(f"coalesce(x{a} - lag(x{a}) over w, 0) as d{a}, coalesce(lag(x{a}) over w, x{a}) - first_value(x{a}) over w as b{a}" for a in "01")
    return f"""with p as ({points}), d as (select *, {moves} from p window w as (partition by key order by i)),
 a as (select *, {before} from d), s as (select key, count(*) as n, {", ".join(sums)} from a group by key)"""


def places(name: str) -> int:
    """Values of four letters are multiples of 1 / (24 * 97 ** k * 10 ** 8), some of which end on half a unit of the eighth
    place, and a hundredth as many on half a unit of the sixth."""
    return 6 if len(name) == 5 else DIGITS


def whole_degree4(spark, d):
    s = plans.signature(core.points(spark, d), 4)
    return s.select("key", *[(F.round(F.element_at("s", k + 1), places(n)) + F.lit(0.0)).alias(n) for k, n in enumerate(NAMES4)])


def _step3(w: str) -> str:
    a, b, c = w
    return f"p{a}{b} * d{c} + b{a} * d{b} * d{c} / 2 + d{a} * d{b} * d{c} / 6"


def degree4() -> str:
    """The integrals of all words of up to four letters: what a segment adds, by the products of what is before it with
    the segment's own powers."""
    three, four = ["".join(map(str, w)) for w in words.words_of_length(2, 3)], ["".join(map(str, w)) for w in words.words_of_length(2, 4)]
    before = ", ".join(f"coalesce(sum({_step3(w)}) over (partition by key order by i rows between unbounded preceding and 1 preceding), 0) as p{w}" for w in three)
    steps = ", ".join(f"sum(p{a}{b}{c} * d{d} + p{a}{b} * d{c} * d{d} / 2 + b{a} * d{b} * d{c} * d{d} / 6 + d{a} * d{b} * d{c} * d{d} / 24) as s{a}{b}{c}{d}" for a, b, c, d in four)
    return f"""{integrals(EVENTS)}, a4 as (select *, {before} from a), t as (select key, {steps} from a4 group by key)
 select key, {", ".join(f"round({n}, {places(n)}) + 0.0 as {n}" for n in NAMES4)} from s join t using (key)"""


def prefixes3() -> str:
    """The integrals of all words of up to three letters, up to each point."""
    steps = {"s" + a: "d" + a for a in "01"} | {f"s{a}{b}": f"b{a} * d{b} + d{a} * d{b} / 2" for a in "01" for b in "01"} | {n: _step3(n[1:]) for n in NAMES3[6:]}
    return f"""{integrals(EVENTS)}, r as (select key, i, {", ".join(f"sum({steps[n]}) over (partition by key order by i) as {n}" for n in NAMES3)} from a)
 select key, i, {", ".join(f"round({n}, {DIGITS}) + 0.0 as {n}" for n in NAMES3)} from r"""


def pick(columns: dict[str, str], points: str = EVENTS) -> str:
    return f"{integrals(points)} select key, " + ", ".join(f"round({e}, {DIGITS}) + 0.0 as {n}" for n, e in columns.items()) + " from s"


def pick_windows(columns: dict[str, str]) -> str:
    return f"{integrals(WINDOWS)} select key['k'] as key, key['w'] as win, " + ", ".join(f"round({e}, {DIGITS}) + 0.0 as {n}" for n, e in columns.items()) + " from s"


def shuffle(a: Counter, b: Counter) -> Counter:
    """The shuffle product of sums of words."""

    def two(u: str, v: str) -> Counter:
        if not u or not v:
            return Counter({u + v: 1})
        out = Counter()
        for first, rest in ((u[0], two(u[1:], v)), (v[0], two(u, v[1:]))):
            for w, n in rest.items():
                out[first + w] += n
        return out

    out: Counter = Counter()
    for u, n in a.items():
        for v, m in b.items():
            for w, k in two(u, v).items():
                out[w] += n * m * k
    return out


def tree_words(tree) -> Counter:
    """A tree's integral as a sum of words: the shuffle of its branches, then the root."""
    branches = reduce(shuffle, map(tree_words, tree[:-1]), Counter({"": 1}))
    return Counter({w + str(tree[-1]): n for w, n in branches.items()})


TREES3 = {f"t{i}": " + ".join(f"{n} * s{w}" for w, n in sorted(tree_words(t).items())) for i, t in enumerate(trees.trees(2, 3))}
EXPANDED = {"l0": "s0", "l1": "s1", **{f"l{a}{b}": f"s{a}{b} - s{a} * s{b} / 2" for a in "01" for b in "01"}}
LOG3 = {**core.LOG2, **{"l" + w: f"s{w} - (s{w[0]} * s{w[1:]} + s{w[:2]} * s{w[2]}) / 2 + s{w[0]} * s{w[1]} * s{w[2]} / 3" for w in ("001", "011")}}
S2, S3 = {n: n for n in core.NAMES}, {n: n for n in NAMES3}
CORRECTION = [0.5, 0.25, 0.0, -1.0]


def first_channel(spark, d):
    return core.packed(spark, d).withColumn("path", F.transform("path", lambda p: F.slice(p, 1, 1)))


def first_step(spark, d):
    p = core.packed(spark, d)
    return p.select("key", F.slice("path", F.lit(2), F.size("path") - 1).alias("tail"), F.zip_with(F.element_at("path", 2), F.element_at("path", 1), lambda x, y: x - y).alias("delta"))


def of_paths(feature, names, source=core.packed):
    return lambda spark, d: core.spread(source(spark, d).select("key", feature().alias("s")), "s", names, digits=DIGITS)


def prepended(tail, join, names):
    return lambda spark, d: core.spread(first_step(spark, d).select("key", tail().alias("h"), "delta").select("key", join("h", "delta").alias("s")), "s", names, digits=DIGITS)


def parts(spark, d):
    """Users' paths cut into pieces of up to 16 segments that share their end points."""
    p = core.packed(spark, d)
    starts = F.sequence(F.lit(1), F.size("path") - 1, F.lit(16))
    pieces = p.select("key", F.posexplode(F.transform(starts, lambda a: F.slice("path", a, F.lit(17)))).alias("c", "piece"))
    logs = pieces.select("key", "c", features.log_sig("piece", 3, 2).alias("l"))
    return logs.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "l"))), lambda x: x["l"]).alias("logs"))


def streamed(make, names, window=False):
    """What a stream class says of each user's path, pushed in two batches; with windows, of the last window."""

    def run(spark, d):
        def fn(x):
            s = make()
            s.push_batch(x[:, :1])
            s.push_batch(x[:, 1:])
            return (s.sig()[-1] if window else s.sig(0, len(s) - 1)).reshape(len(x), -1)

        long = core.packed(spark, d).where("size(path) >= 16") if window else core.packed(spark, d)
        return core.spread(long.select("key", features.vector(fn, "path").alias("s")), "s", names, digits=DIGITS)

    return run


def streamed_windows(make, names):
    """(key, win, ...): what a window stream says of every window of each user's path, pushed in two batches."""

    def run(spark, d):
        def fn(x):
            s = make()
            s.push_batch(x[:, :1])
            s.push_batch(x[:, 1:])
            return np.moveaxis(s.sig(), 0, 1).reshape(len(x), -1)

        found = core.packed(spark, d).where("size(path) >= 16").select("key", features.vector(fn, "path").alias("s"))
        starts = F.sequence(F.lit(1), F.size("s"), F.lit(len(names)))
        rows = found.select("key", F.posexplode(F.transform(starts, lambda a: F.slice("s", a, len(names)))).alias("win", "s"))
        return core.spread(rows.withColumn("win", F.col("win").cast("long")), "s", names, ("key", "win"), digits=DIGITS)

    return run


def gradient_rows(fn):
    """(key, i, g0, g1): the gradient of fn at each point of a user's path."""

    def run(spark, d):
        g = core.packed(spark, d).select("key", features.whole_gradient(fn, "path").alias("g"))
        rows = g.select("key", "g", F.explode(F.sequence(F.lit(0), (F.size("g") / 2).cast("int") - 1)).alias("i"))
        return rows.select("key", F.col("i").cast("long").alias("i"), *[(F.round(F.element_at("g", F.col("i") * 2 + k + 1), 6) + F.lit(0.0)).alias(f"g{k}") for k in (0, 1)])

    return run


def corners(spark, d):
    """Embeddings as paths of their first, middle and last pair of values."""
    v = core.vectors(spark, d)
    return v.withColumn("path", F.array(F.element_at("path", 1), F.element_at("path", 16), F.element_at("path", 32)))


def corner_metric(what, kernel):
    def run(spark, d):
        v = corners(spark, d)
        a, b = v.where("label = 0"), v.where("label = 1")
        if what == "gram":
            return gram.gram(kernel(), a).select("i", "j", F.round("k", 9).alias("k"))
        out = core.compared(what, kernel(), a, b)
        return out.select(*[F.round(c, 9).alias(c) if c != "j" else F.col(c) for c in out.columns])

    return run


_EMBEDDED = "select vec_id as key, label, " + ", ".join(f"embedding[{b}]::double - embedding[{a}]::double as {n}" for n, a, b in (("u0", 1, 31), ("u1", 2, 32), ("v0", 31, 63), ("v1", 32, 64))) + " from embeddings"
_CELL = "({e} + {n}) * (1 + {d} / 2 + {d} * {d} / 12) - {c} * (1 - {d} * {d} / 12)"
_PDE = f"""with e as ({_EMBEDDED}),
 m as (select x.key as i, y.key as j, x.label as lx, y.label as ly, x.u0 * y.u0 + x.u1 * y.u1 as uu, x.u0 * y.v0 + x.u1 * y.v1 as uv,
   x.v0 * y.u0 + x.v1 * y.u1 as vu, x.v0 * y.v0 + x.v1 * y.v1 as vv from e x, e y where x.label in (0, 1) and y.label in (0, 1)),
 k1 as (select *, {_CELL.format(e="1", n="1", c="1", d="uu")} as a from m),
 k2 as (select *, {_CELL.format(e="a", n="1", c="1", d="uv")} as b, {_CELL.format(e="1", n="a", c="1", d="vu")} as c from k1),
 g as (select i, j, lx, ly, {_CELL.format(e="b", n="c", c="a", d="vv")} as k from k2)"""
_DEPTH1 = f"""with e as ({_EMBEDDED}), g as (select x.key as i, y.key as j, x.label as lx, y.label as ly,
   exp((x.u0 + x.v0) * (y.u0 + y.v0) + (x.u1 + x.v1) * (y.u1 + y.v1)) as k from e x, e y where x.label in (0, 1) and y.label in (0, 1))"""
_OWN = "(select avg(k) from g where lx = {0} and ly = {0} and i <> j)"


def metric_sql(pre: str) -> dict[str, str]:
    score = f"{pre} select j, round({_OWN.format(0)} - 2 * avg(k), 9) as score from g where lx = 0 and ly = 1 group by j"
    return {
        "gram": f"{pre} select i, j, round(k, 9) as k from g where lx = 0 and ly = 0",
        "score": score,
        "expected": f"{pre} select round({_OWN.format(0)} - 2 * avg(k), 9) as score from g where lx = 0 and ly = 1",
        "mmd": f"{pre} select round({_OWN.format(0)} + {_OWN.format(1)} - 2 * (select avg(k) from g where lx = 0 and ly = 1), 9) as mmd",
    }


def static_kernels(spark, d):
    """One signature kernel for each static kernel, of each vector's path with the smallest key's path of its label."""
    v = core.vectors(spark, d)
    other = v.groupBy("label").agg(F.min_by("path", "key").alias("pb"))
    each = {
        "linear": kernels.LinearKernel(), "scaled": kernels.ScaledLinearKernel(0.5), "rbf": kernels.RBFKernel(2.0), "polynomial": kernels.PolynomialKernel(2, 1.0, 0.5),
        "matern12": kernels.Matern12Kernel(1.5), "matern32": kernels.Matern32Kernel(1.5), "matern52": kernels.Matern52Kernel(1.5), "rational": kernels.RationalQuadraticKernel(1.0, 1.5),
    }
    pairs = v.withColumnRenamed("path", "pa").join(other, "label")
    return pairs.select("key", *[F.round(gram.sig_kernel(dyadic_order=0, static=k), 9).alias(n) for n, k in each.items()])


def matrix_gradient(fn, source=core.vectors):
    def run(spark, d):
        v = source(spark, d)
        g = gram.gradients(fn, v.where("label = 0"), v.where("label = 1"))
        return g.select("i", F.posexplode("gradient").alias("pos", "g")).select("i", "pos", (F.round("g", 6) + F.lit(0.0)).alias("g"))

    return run


_DEPTH1_GRADIENT = f"""{_DEPTH1}, s as (select g.i, sum(k * (y.u0 + y.v0)) as a, sum(k * (y.u1 + y.v1)) as b from g join e y on y.key = g.j where lx = 0 and ly = 1 group by g.i)
 select i, unnest(range(6))::int as pos, unnest([round(-a, 6) + 0.0, round(-b, 6) + 0.0, 0.0, 0.0, round(a, 6) + 0.0, round(b, 6) + 0.0]) as g from s"""


#: At depth 1 a kernel depends on the end points alone, so the points between have no gradient.
_DEPTH1_GRADIENT_ALL = f"""{_DEPTH1}, s as (select g.i, sum(k * (y.u0 + y.v0)) as a, sum(k * (y.u1 + y.v1)) as b from g join e y on y.key = g.j where lx = 0 and ly = 1 group by g.i)
 select i, unnest(range(64))::int as pos, unnest([round(-a, 6) + 0.0, round(-b, 6) + 0.0, {", ".join(["0.0"] * 60)}, round(a, 6) + 0.0, round(b, 6) + 0.0]) as g from s"""


def lengths(spark, d):
    """The number of words and of Lyndon words up to a degree."""
    rows = [(m, n, words.sig_length(m, n), words.log_sig_length(m, n)) for m in (1, 2, 3, 5) for n in range(1, 7)]
    return spark.createDataFrame(rows, "dimension int, degree int, sig_length long, log_sig_length long")


def linear_orders(spark, d):
    """linear_sig of every order of every customer. Values are multiples of 1 / (2 * 97 ** 2 * 10 ** 10): none ends on
    half a unit of the ninth place."""
    p = core.sources.order_points(spark, d)
    return core.rounded(p.select("key", "i", *[c.alias(n) for n, c in core.paths.linear_sig([F.col("x0"), F.col("x1")], 2).items()]), core.NAMES, ("key", "i"), 9)


_TAIL_LAST = f"with p as ({EVENTS}), w as (select key, i, n, x0, x1, lag(x0) over v as l0, lag(x1) over v as l1, lead(x0) over v as r0, lead(x1) over v as r1, first_value(x0) over v as f0, last_value(x1) over (v rows between unbounded preceding and unbounded following) as e1, first_value(x1) over v as f1 from p window v as (partition by key order by i))"

QUERIES = {
    "linear_sig_all": linear_orders,
    "sig_degree3": lambda spark, d: core.spread(plans.signature(core.points(spark, d), 3), "s", NAMES3, digits=DIGITS),
    "sig_degree4_all": whole_degree4,
    "prefix_table_degree3_all": lambda spark, d: core.spread(frames.prefix_table(core.points(spark, d), 3).withColumn("i", F.col("i").cast("long")), "s", NAMES3, ("key", "i"), digits=DIGITS),
    "sig_coef_degree3": lambda spark, d: core.rounded(cascade.coefficients(core.points(spark, d), words.words_of_length(2, 3)), NAMES3[6:], digits=DIGITS),
    "sig_time_aug": of_paths(lambda: features.sig("path", 3, time_aug=True), NAMES3, first_channel),
    "sig_lead_lag": of_paths(lambda: features.sig("path", 3, lead_lag=True), NAMES3, first_channel),
    "sig_scalar_term": of_paths(lambda: features.sig("path", 2, scalar_term=True), ["one", *core.NAMES]),
    "sig_correction": of_paths(lambda: features.sig("path", 2, correction=CORRECTION), core.NAMES),
    "sig_coef_time_aug": of_paths(lambda: features.sig_coef("path", [(0, 1), (1, 0, 0)], time_aug=True), ["s01", "s100"], first_channel),
    "sig_join_prepend": prepended(lambda: features.sig("tail", 3), lambda h, x: features.sig_join(h, x, 2, 3, True), NAMES3),
    "log_sig_expanded": of_paths(lambda: features.log_sig("path", 2, 0), list(EXPANDED)),
    "log_sig_degree3": of_paths(lambda: features.log_sig("path", 3, 1), list(LOG3)),
    "log_sig_degree3_brackets": of_paths(lambda: features.log_sig("path", 3, 2), list(LOG3)),
    "log_sig_method3": of_paths(lambda: features.log_sig("path", 3, 3), list(LOG3)),
    "log_sig_lead_lag": of_paths(lambda: features.log_sig("path", 3, 2, lead_lag=True), list(LOG3), first_channel),
    "log_sig_reduce": lambda spark, d: core.spread(parts(spark, d).select("key", features.log_sig_reduce("logs", 2, 3).alias("s")), "s", list(LOG3), digits=DIGITS),
    "branched_sig_degree3": of_paths(lambda: features.branched_sig("path", 3), list(TREES3)),
    "branched_sig_lead_lag": of_paths(lambda: features.branched_sig("path", 3, lead_lag=True), list(TREES3), first_channel),
    "branched_sig_join_prepend": prepended(lambda: features.branched_sig("tail", 3), lambda h, x: features.branched_sig_join(h, x, 2, 3, prepend=True), list(TREES3)),
    "branched_sig_correction": of_paths(lambda: features.branched_sig("path", 2, correction=CORRECTION), core.CHAIN_NAMES),
    "extract_branched_sig_coef": lambda spark, d: core.rounded(core.packed(spark, d).select("key", features.branched_sig("path", 3).alias("b")).select("key", *features.extract_branched_sig_coef("b", [((0,), (1,), 0), (1,)], 2, 3)), ["e0", "e1"], digits=DIGITS),
    "stream_sig": streamed(lambda: state.SigStream(2, 3), NAMES3),
    "stream_log_sig": streamed(lambda: state.LogSigStream(2, 3), list(LOG3)),
    "stream_branched_sig": streamed(lambda: state.BranchedSigStream(2, 3), list(TREES3)),
    "stream_branched_log_sig": streamed(lambda: state.BranchedLogSigStream(2, 2), core.CHAIN_NAMES),
    "stream_sig_window": streamed(lambda: state.SigWindowStream(2, 3, 16, 8), NAMES3, True),
    "stream_log_sig_window": streamed(lambda: state.LogSigWindowStream(2, 3, 16, 8), list(LOG3), True),
    "stream_branched_sig_window": streamed(lambda: state.BranchedSigWindowStream(2, 3, 16, 8), list(TREES3), True),
    "stream_branched_log_sig_window": streamed(lambda: state.BranchedLogSigWindowStream(2, 2, 16, 8), core.CHAIN_NAMES, True),
    "stream_sig_windows": streamed_windows(lambda: state.SigWindowStream(2, 3, 16, 8), NAMES3),
    "stream_log_sig_windows": streamed_windows(lambda: state.LogSigWindowStream(2, 3, 16, 8), list(LOG3)),
    "stream_branched_sig_windows": streamed_windows(lambda: state.BranchedSigWindowStream(2, 3, 16, 8), list(TREES3)),
    "stream_branched_log_sig_windows": streamed_windows(lambda: state.BranchedLogSigWindowStream(2, 2, 16, 8), core.CHAIN_NAMES),
    "lengths_table": lengths,
    "sig_kernel_statics": static_kernels,
    **{f"sig_{w}_corners": corner_metric(w, lambda: products.SigKernel(0)) for w in ("gram", "score", "expected", "mmd")},
    **{f"branched_sig_{w}_depth1": corner_metric(w, lambda: products.BranchedSigKernel(1)) for w in ("gram", "score", "expected", "mmd")},
    "sig_backprop_degree1": gradient_rows(lambda x: tensor.sig(x, 1)),
    "sig_coef_backprop": gradient_rows(lambda x: tensor.coefficients(x, [(0, 1)])),
    "branched_sig_coef_backprop": gradient_rows(lambda x: branched.coefficients(x, [((0,), 1)])),
    "sig_kernel_gram_backprop": matrix_gradient(products.SigKernel(0)),
    "branched_sig_kernel_gram_backprop": matrix_gradient(products.BranchedSigKernel(1), corners),
    "branched_sig_kernel_gram_backprop_all": matrix_gradient(products.BranchedSigKernel(1)),
    "sig_join_prepend_backprop": core.vjp_of(core.last_features(lambda c: features.sig(c, 2)), ("h", "delta"), lambda h, x: tensor.join(h, x, 2, 2, True), 6),
    "branched_sig_join_backprop": core.vjp_of(core.last_features(lambda c: features.branched_sig(c, 2)), ("h", "delta"), lambda h, x: branched.join(h, x, 2, 2), 6),
    "branched_log_sig_join_backprop": core.vjp_of(core.last_features(lambda c: features.branched_log_sig(c, 2, True, 2)), ("h", "delta"), lambda h, x: branched.log_join(h, x, 2, 2), 7),
    "linear_log_sig_backprop": core.vjp_of(core.last_step, ("delta",), lambda x: tensor.linear_log_sig(x, 2), 3),
    "linear_branched_sig_backprop": core.vjp_of(core.last_step, ("delta",), lambda x: branched.linear(x, 2), 6),
    "linear_branched_log_sig_backprop": core.vjp_of(core.last_step, ("delta",), lambda x: branched.linear_log(x, 2), 6),
}

_COEF_GRADIENT = f"""{_TAIL_LAST} select key, i,
 round(case when i = 0 then (r1 - x1) / 2 - (e1 - f1) when i = n - 1 then (x1 - l1) / 2 else (r1 - l1) / 2 end, 6) + 0.0 as g0,
 round(case when i = 0 then (x0 - r0) / 2 when i = n - 1 then (x0 + l0) / 2 - f0 else (l0 - r0) / 2 end, 6) + 0.0 as g1 from w"""
_BENT = {n: f"{n} + (n - 1) * ({c})" for n, c in zip(core.NAMES[2:], CORRECTION)}
ORACLE_SQL = {
    "linear_sig_all": "with q as (select o_custkey as key, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as i, o_totalprice / 97000.0 as s0 from orders), r as (select *, i / 100.0 as s1 from q) select key, i, "
    + ", ".join(f"round({e}, 9) + 0.0 as s{n}" for n, e in core._LINEAR.items())
    + " from r",
    **{n: pick(S3) for n in ("sig_degree3", "sig_join_prepend", "stream_sig")},
    "sig_degree4_all": degree4(),
    "prefix_table_degree3_all": prefixes3(),
    "sig_coef_degree3": pick({n: n for n in NAMES3[6:]}),
    "sig_time_aug": pick(S3, TIMED),
    "sig_lead_lag": pick(S3, LEAD_LAG),
    "sig_scalar_term": pick({"one": "1::double", **S2}),
    "sig_correction": pick({**S2, **_BENT}),
    "sig_coef_time_aug": pick({"s01": "s01", "s100": "s100"}, TIMED),
    "log_sig_expanded": pick(EXPANDED),
    **{n: pick(LOG3) for n in ("log_sig_degree3", "log_sig_degree3_brackets", "log_sig_method3", "log_sig_reduce", "stream_log_sig")},
    "log_sig_lead_lag": pick(LOG3, LEAD_LAG),
    **{n: pick(TREES3) for n in ("branched_sig_degree3", "branched_sig_join_prepend", "stream_branched_sig")},
    "branched_sig_lead_lag": pick(TREES3, LEAD_LAG),
    "branched_sig_correction": pick({"t" + n[1:]: e for n, e in {**S2, **_BENT}.items()}),
    "extract_branched_sig_coef": pick({"e0": "s010 + s100", "e1": "s1"}),
    "stream_branched_log_sig": pick({"t" + n[1:]: e for n, e in EXPANDED.items()}),
    "stream_sig_window": pick(S3, LAST_WINDOW),
    "stream_log_sig_window": pick(LOG3, LAST_WINDOW),
    "stream_branched_sig_window": pick(TREES3, LAST_WINDOW),
    "stream_branched_log_sig_window": pick({"t" + n[1:]: e for n, e in EXPANDED.items()}, LAST_WINDOW),
    "stream_sig_windows": pick_windows(S3),
    "stream_log_sig_windows": pick_windows(LOG3),
    "stream_branched_sig_windows": pick_windows(TREES3),
    "stream_branched_log_sig_windows": pick_windows({"t" + n[1:]: e for n, e in EXPANDED.items()}),
    "lengths_table": """with m as (select unnest([1, 2, 3, 5]) as dimension), n as (select unnest(range(1, 7)) as degree),
 mu as (select unnest([1, 2, 3, 5, 6]) as r, unnest([1, -1, -1, -1, 1]) as v),
 lyndon as (select dimension, degree, sum(v * pow(dimension, degree // r))::bigint // degree as c from m, n, mu where degree % r = 0 group by dimension, degree)
 select dimension::int as dimension, n.degree::int as degree, sum(pow(dimension, l.degree))::bigint as sig_length, sum(c)::bigint as log_sig_length
 from n join lyndon l on l.degree <= n.degree group by dimension, n.degree""",
    **{f"sig_{w}_corners": q for w, q in metric_sql(_PDE).items()},
    **{f"branched_sig_{w}_depth1": q for w, q in metric_sql(_DEPTH1).items()},
    "sig_backprop_degree1": f"with p as ({EVENTS}) select key, i, case when i = 0 then -1.0 when i = n - 1 then 1.0 else 0.0 end::double as g0, case when i = 0 then -1.0 when i = n - 1 then 1.0 else 0.0 end::double as g1 from p",
    **{n: _COEF_GRADIENT for n in ("sig_coef_backprop", "branched_sig_coef_backprop")},
    "branched_sig_kernel_gram_backprop": _DEPTH1_GRADIENT,
    "branched_sig_kernel_gram_backprop_all": _DEPTH1_GRADIENT_ALL,
    "interval_sig": f"""{integrals(_QUARTER)} select key, a, b, {", ".join(f"round({n}, 6) + 0.0 as {n}" for n in core.NAMES)} from s
 join (select user_id as key, count(*) // 4 as a, count(*) // 2 as b from events group by user_id) using (key)""",
    "linear_branched_log_sig": core._STEP + " select key, round(s0, 6) + 0.0 as t0, round(s1, 6) + 0.0 as t1, 0.0::double as t00, 0.0::double as t01, 0.0::double as t10, 0.0::double as t11 from e",
    "lyndon_words_table": """with recursive w(level, word) as (select 0, '' union all select level + 1, word || x from w, (select unnest(['0', '1']) as x) where level < 6),
 l as (select level, word from w where level > 0 and not exists (select 1 from unnest(range(1, level)) as t(k) where word[t.k + 1 :] <= word))
 select row_number() over (order by level, word) - 1 as idx, level, array_to_string(string_split(word, ''), ',') as word from l""",
}
