"""Near-duplicate documents: Order MinHash candidates, verified by a banded alignment."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, WordHashes, components, documents, lean, mix, run_hash, texts_of

#: What is compared at once: so many documents, of so many shingles together, or one document that has more.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000


def labelled(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer's hash mixed with the number of its occurrences before it: unique within a document."""
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    at = np.arange(len(s))
    nth = np.empty(len(s), dtype=U64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(U64)
    with np.errstate(over="ignore"):
        return mix(kmers + nth * U64(0xD1B54A32D192ED03))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; of all words, where there are fewer."""
    return run_hash(words, min(k, len(words)))


def order_minhash(kmers: np.ndarray, marks: np.ndarray, tables: int, minima: int) -> np.ndarray:
    """Order MinHash (Marçais et al. 2019): for each table, the k-mers of the `minima` smallest labelled hashes, in the
    order in which they stand in the text, as one 64-bit value."""
    seeds = mix(np.arange(1, tables + 1, dtype=U64) * U64(0xA0761D6478BD642F))[:, None]
    h = mix(marks[None, :] ^ seeds)
    if len(marks) > minima:
        at = np.sort(np.argpartition(h, minima - 1, axis=1)[:, :minima], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(marks)), (tables, len(marks)))
    with np.errstate(over="ignore"):
        out = seeds[:, 0]
        for j in range(at.shape[1]):
            out = mix(out * U64(0x9E3779B97F4A7C15) + kmers[at[:, j]])
    return out


def least_common(n: int, m: int, t: float) -> float:
    return t * (n + m) / (1 + t) - 1e-9


def aligned(a: np.ndarray, b: np.ndarray, t: float) -> tuple[bool, float]:
    """(linked, Jaccard distance) of two documents' labelled shingles in text order.

    The similarity is that of the best alignment: c / (n + m - c), where c is the most shingles that can be matched in
    order. At similarity t it leaves at most (n + m)(1 - t) / (1 + t) shingles unmatched, so it stays within a diagonal
    band of that width: matches outside it are left out, and the longest increasing chain of the others is c.
    """
    n, m = len(a), len(b)
    order = np.argsort(b)
    at = np.searchsorted(b[order], a)
    at[at == m] = 0
    j = order[at]
    i = np.flatnonzero(b[j] == a)
    j = j[i]
    distance = 1 - len(i) / (n + m - len(i))
    need = least_common(n, m, t)
    if len(i) < need:
        return False, distance
    near = np.abs(i - j) <= (n + m) * (1 - t) / (1 + t) + 1e-9
    j = j[near]
    if len(j) < need:
        return False, distance
    if (np.diff(j) > 0).all():
        return True, distance
    tails: list[int] = []
    for x in j.tolist():
        p = bisect_left(tails, x)
        tails[p : p + 1] = [x]
    return len(tails) >= need, distance


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each of `a` shares with each of `b`; no array has a value twice."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    values, inverse = np.unique(np.concatenate(a + b), return_inverse=True)
    who, cut = np.concatenate([np.repeat(np.arange(len(a)), n), np.repeat(np.arange(len(b)), m)]), int(n.sum())
    # only values of both sides count: those that one document alone has are most of them
    left, right = (np.bincount(x, minlength=len(values)) > 0 for x in (inverse[:cut], inverse[cut:]))
    shared = left & right
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    who, column, first = who[keep], column[inverse][keep], np.arange(len(inverse))[keep] < cut
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    total = int(shared.sum())
    wide = min(total, max(256, 8_000_000 // (len(a) + len(b))))  # no wider than what there is: most blocks are small
    for at in range(0, total, wide or 1):
        inside = (column >= at) & (column < at + wide)
        x, y = np.zeros((len(a), wide), dtype=np.float32), np.zeros((len(b), wide), dtype=np.float32)
        x[who[inside & first], column[inside & first] - at] = 1
        y[who[inside & ~first], column[inside & ~first] - at] = 1
        out += x @ y.T
    return out


def joining_links(rep: list[int], comp: list[int], arrays: list[np.ndarray], side: list[int], t: float) -> list[tuple[int, int]]:
    """Of all linked pairs of different components, and of different sides where there are two: those that join
    components. A link between two that earlier links already join says nothing new, so n documents give n - 1 at most."""
    sides = sorted(set(side))
    rows, cols = ([i for i, s in enumerate(side) if s == x] for x in (sides[0], sides[-1]))
    common, n, c = common_counts([arrays[i] for i in rows], [arrays[i] for i in cols]), np.array([len(x) for x in arrays]), np.array(comp)
    may = (common >= t * (n[rows][:, None] + n[cols][None, :]) / (1 + t) - 1e-3) & (c[rows][:, None] != c[cols][None, :])
    if len(sides) == 1:
        may = np.triu(may, 1)
    root = {x: x for x in comp}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(*(v.tolist() for v in np.nonzero(may))):
        x, y = rows[x], cols[y]
        one, two = find(comp[x]), find(comp[y])
        if one != two and aligned(arrays[x], arrays[y], t)[0]:
            root[max(one, two)] = min(one, two)
            out.append((max(rep[x], rep[y]), min(rep[x], rep[y])))
    return out


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, tables: int = 12, minima: int = 3, small: int = 500_000, turns: int = 12) -> DataFrame:
    """One row (doc_id, class_id, kept) for each row of `docs`; class_id is the smallest doc_id of its class.

    A document is its words (letters and digits, lower case) in runs of five, each labelled with its occurrence. Two
    documents are linked if their aligned similarity (see `aligned`) is 0.8 or more; classes are the components of the
    links found, and documents of equal words are one class. Candidates share one of 12 Order MinHash tables of 3
    minima; a pair of similarity 0.8 is missed with a chance of about 2 in 10,000, and no candidate is left out.

    Texts without a word (null, empty) are classes of their own. Rows of null doc_id get a null class and are kept.
    Rows of equal doc_id count as one document. Other columns are ignored. An empty table gives no rows.

    Copies are folded first, by a partial minimum. In a bucket, every document is aligned with the bucket's smallest
    one only (a star, not all pairs). Jaccard distance is a metric: one that is further than 2 (1 - t) from it cannot be
    linked to any that is linked to it, so only the others, and those of another component, meet again. A bucket that
    fits one block meets there. Larger ones take more turns of stars, by the smallest of those left, while their blocks
    would cost more than eight times their rows; then their documents are dealt to blocks, and those of the bucket's
    largest component meet the others only, never each other.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    t = similarity
    d = documents(docs)

    @lean
    def sign(batches):
        hashes = WordHashes()
        for b in batches:
            at, content, sigs = [], [], []
            for i, text in enumerate(texts_of(b)):
                w = hashes.words(text)
                if len(w):
                    k = shingles(w, words)
                    c = xxhash.xxh3_128_intdigest(w.tobytes())
                    at.append(i)
                    content.append((c >> 64, c & (1 << 64) - 1))
                    sigs.append(order_minhash(k, labelled(k), tables, minima).astype(np.int64))
            if at:
                c1, c2 = np.array(content, dtype=U64).astype(np.int64).T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tables * len(at) + 1, tables), pa.int32()), pa.array(np.concatenate(sigs)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(c1), pa.array(c2), lists], ["doc_id", "c1", "c2", "sigs"])

    signed = scratch.table(d.where("doc_id is not null and text is not null").mapInArrow(sign, "doc_id long, c1 long, c2 long, sigs array<long>"))
    first = signed.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"))
    member = scratch.table(signed.join(first, ["c1", "c2"]).select("doc_id", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sigs")).alias("sigs")))
    scratch.drop(signed)
    slots = member.where("sigs is not null").select("rep", F.explode("sigs").alias("h"))
    # what is found by bucket is written: Spark then knows its size, and can split a hot bucket in the join with it
    pivots = scratch.table(slots.groupBy("h").agg(F.min("rep").alias("pivot"), F.max("rep").alias("most")).where("pivot < most").select("h", "pivot"))
    buckets = scratch.table(slots.join(pivots, "h").select("h", "rep", "pivot"))
    ids = buckets.select(F.col("rep").alias("doc_id")).distinct()
    few = ids.limit(small + 1).count() <= small

    @lean
    def features(batches):
        hashes = WordHashes()
        for b in batches:
            marks = [labelled(shingles(hashes.words(x), words)) for x in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in marks], pa.binary()), pa.array([len(x) for x in marks], pa.int64())], ["doc_id", "marks", "size"])

    marks = scratch.table(d.where("text is not null").join(F.broadcast(ids) if few else ids, "doc_id").mapInArrow(features, "doc_id long, marks binary, size long"))
    marks_a, marks_b = (marks.select(F.col("doc_id").alias(x), F.col("marks").alias(f"m{x}")) for x in "ab")
    ma = lambda x: np.frombuffer(x, dtype=U64)

    @lean
    def verify(batches):
        for b in batches:
            out = [aligned(ma(x), ma(y), t) for x, y in zip(b.column("ma").to_pylist(), b.column("mb").to_pylist())]
            if out:
                linked, far = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(map(bool, linked), pa.bool_()), pa.array(far, pa.float64())], ["a", "b", "linked", "far"])

    def star(rows: DataFrame) -> DataFrame:
        """rows (h, rep, pivot) -> (a, b, linked, far) of each different pair of rep and pivot."""
        pairs = rows.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
        return scratch.table(pairs.join(marks_a, "a").join(marks_b, "b").select("a", "b", "ma", "mb").mapInArrow(verify, "a long, b long, linked boolean, far double"))

    def compare(block: pa.Table) -> pa.Table:
        rows = dict(zip(block["rep"].to_pylist(), zip(*(block[c].to_pylist() for c in ("comp", "blk", "marks")))))
        rep = sorted(rows)
        found = joining_links(rep, [rows[r][0] for r in rep], [ma(rows[r][2]) for r in rep], [rows[r][1] for r in rep], t)
        return pa.table({k: pa.array([f[i] for f in found], pa.int64()) for i, k in enumerate("ab")})

    links = None
    for turn in range(turns):
        seen = star(buckets)
        new = seen.where("linked").select("a", "b")
        links = new if links is None else links.union(new)
        comps = components(links, scratch)
        state = scratch.table(
            buckets.where("rep <> pivot")
            .join(seen.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "linked", "far"), ["rep", "pivot"])
            .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
            .select("h", "rep", "linked", "far", F.coalesce("component", "rep").alias("comp"))
        )
        open_ = state.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.when(~F.col("linked"), F.col("far"))).alias("nearest")).where("c0 < c1")
        rest = state.join(scratch.table(open_), "h").where(~F.col("linked") | (F.col("far") + (1 - t) + 1e-9 >= F.col("nearest"))).select("h", "rep", "comp")
        rest = scratch.table(rest.join(marks.select(F.col("doc_id").alias("rep"), "size"), "rep"))
        scratch.drop(state)
        # by bucket: the largest component and the others, the blocks of both, and the pivot of a next turn
        parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
        by_comp = rest.groupBy("h", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("rep").alias("next"))
        by_bucket = by_comp.groupBy("h").agg(F.max(F.struct("n", (-F.col("comp")).alias("c"), "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("next").alias("next"), F.count("*").alias("k")).where("k > 1")
        one = parts(F.col("n"), F.col("size")) <= 1
        plan = scratch.table(
            by_bucket.select(
                "h", "n", F.col("next").alias("pivot"), (-F.col("top.c")).alias("top"), F.col("top.n").alias("m"),
                F.when(one, 0).otherwise(parts(F.col("top.n"), F.col("top.size"))).alias("k0"),
                F.when(one, 1).otherwise(parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"))).alias("k1"),
            )
        )
        rows, work = plan.agg(F.sum("n"), F.sum(F.col("m") * F.col("k1") + (F.col("n") - F.col("m")) * (F.col("k0") + F.col("k1")))).first()
        if not rows:
            break
        left = rest.join(plan, "h")
        if work <= 8 * rows or turn == turns - 1:
            mine = (F.col("comp") == F.col("top")) & (F.col("k0") > 0)
            place = F.pmod(F.xxhash64("rep"), F.when(mine, F.col("k0")).otherwise(F.col("k1"))).cast("int")
            blk = F.when(mine, place).otherwise(F.col("k0") + place)
            others = F.sequence(F.when(mine, F.col("k0")).otherwise(F.lit(0)), F.col("k0") + F.col("k1") - 1)
            dealt = left.select("h", "rep", "comp", blk.alias("blk"), F.explode(others).alias("x")).select("h", "rep", "comp", "blk", F.least("blk", "x").alias("i"), F.greatest("blk", "x").alias("j"))
            more = scratch.table(dealt.join(marks.select(F.col("doc_id").alias("rep"), "marks"), "rep").groupBy("h", "i", "j").applyInArrow(compare, "a long, b long"))
            if not more.isEmpty():
                comps = components(links.union(more), scratch)
            break
        buckets = scratch.table(left.select("h", "rep", "pivot"))
    klass = member.select("doc_id", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    bare = d.where("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"))
    wordless = d.where("doc_id is not null and text is not null").select("doc_id").join(klass.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"))
    return klass.union(bare).union(wordless).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))
