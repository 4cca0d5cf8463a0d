"""Near-duplicate vectors: spherical-cap filters from random product codes."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Scratch, components

BLOCK = 1024


class ProductCode:
    """Filter directions c = (c_1, ..., c_m) / sqrt(m), each c_b one of `words` random unit vectors of a block of the
    dimensions. A vector is in the filters whose direction it exceeds `threshold` with; they are list-decoded block by
    block, dropping a prefix as soon as the best rest cannot lift it over the threshold (Becker et al. 2016)."""

    def __init__(self, dim: int, blocks: int, words: int, expected: float, seed: int = 7):
        blocks = min(blocks, dim)
        rng = np.random.default_rng([seed, dim, blocks, words])
        self.cuts = [dim * i // blocks for i in range(blocks + 1)]
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = rng.standard_normal((words, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(blocks))
        share = min(0.5, expected / words**blocks)
        # the spread of a random unit vector's product with a direction is 1 / sqrt(dim)
        self.threshold = NormalDist().inv_cdf(1 - share) / np.sqrt(dim)

    def decode(self, x: np.ndarray, least: int) -> list[np.ndarray]:
        """The filters of each row; a row with fewer than `least` takes those of a lower threshold."""
        scores = [x[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes)]
        rest = np.zeros((len(scores) + 1, len(x)))
        for b in range(len(scores) - 1, -1, -1):
            rest[b] = rest[b + 1] + scores[b].max(axis=1)
        limit = np.full(len(x), self.threshold)
        out: list = [None] * len(x)
        todo = np.arange(len(x))
        while len(todo):
            row, code, part = todo, np.zeros(len(todo), dtype=np.int64), np.zeros(len(todo))
            for b, s in enumerate(scores):
                total = part[:, None] + s[row]
                at, word = np.nonzero(total + rest[b + 1][row][:, None] >= limit[row][:, None])
                row, code, part = row[at], code[at] * s.shape[1] + word, total[at, word]
            counts = np.bincount(row, minlength=len(x))
            ends = np.cumsum(counts)
            for r in todo:
                if counts[r] >= least or limit[r] < -1:
                    out[r] = code[ends[r] - counts[r] : ends[r]]
            todo = todo[(counts[todo] < least) & (limit[todo] >= -1)]
            limit[todo] -= 0.03
        return out


def starts_of(t: pa.Table, keys: list[str]) -> list[int]:
    """Where the groups of equal keys of a sorted table start."""
    new = np.zeros(len(t), dtype=bool)
    new[:1] = True
    for k in keys:
        v = t[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new).tolist()


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups from batches sorted by keys; the last group of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        if rest is not None:
            t = pa.concat_tables([rest, t])
        cut = starts_of(t, keys)[-1]
        if cut:
            yield fresh(t.slice(0, cut))
        rest = fresh(t.slice(cut))
    if rest is not None:
        yield rest


def fresh(t: pa.Table) -> pa.Table:
    """The rows of a slice in buffers of their own, one chunk a column."""
    return t.take(pa.array(np.arange(len(t)))).combine_chunks()


def link_vectors(vectors: DataFrame, cosine: float = 0.98, expected: float = 12, least: int = 8, blocks: int | None = None, words: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vec_id, and for each row without one.

    Vectors are linked if their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least `cosine`. Null vectors, and such as are empty, zero or hold null or non-finite values, link
    with nothing; a null vec_id neither (its component is null, and it is kept). Rows of equal vec_id are one vector,
    the smallest of them by (label, embedding). Other columns are ignored; an empty table gives no rows.

    Vectors equal in label and in every component (by two independent 64-bit hashes) form a class, which stands in the
    search as its smallest vec_id with its size as weight: n copies cost one row there, whatever n is.
    Vectors are joined on label and filter. The number of directions follows the rows, so that a filter holds a few
    dozen vectors of a label. A filter with more is dealt to pairs of blocks of at most about BLOCK, and all its
    cosines are one matrix product there. A pair is counted in the smallest filter that both are in; what leaves a
    block is a count and one edge for each vector, never pairs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    first = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.*")
    one = scratch.table(first.select("*", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")))
    if blocks is None or words is None:
        n = rows.count()
        blocks = 2 if n < 2_000_000 else 3
        words = max(16, round((n * expected / 100) ** (1 / blocks)))

    code_type = "int" if words**blocks < 2**31 else "long"
    stored = np.float32 if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else np.float64

    def filters(frames):
        codes: dict[int, ProductCode] = {}
        for f in frames:
            kept: dict[int, list] = {}
            for at, e in enumerate(f["embedding"]):
                x = np.asarray(e, dtype=np.float64)
                norm = np.sqrt(x @ x) if len(x) else 0.0
                if np.isfinite(norm) and norm > 0:
                    kept.setdefault(len(x), []).append((at, x / norm, x.astype(stored).tobytes()))
            for dim, got in kept.items():
                if dim not in codes:
                    codes[dim] = ProductCode(dim, blocks, words, expected)
                for a in range(0, len(got), 2000):
                    part = got[a : a + 2000]
                    named = f[["vec_id", "w", "label", "h1", "h2"]].iloc[[at for at, _, _ in part]]
                    yield named.assign(dim=dim, x=[raw for _, _, raw in part], filters=codes[dim].decode(np.stack([v for _, v, _ in part]), least))

    sound = one.withColumn("embedding", F.col("embedding").cast("array<double>")).where("label is not null and embedding is not null and not exists(embedding, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    classes = sound.groupBy("label", "h1", "h2").agg(F.min(F.struct("vec_id", "embedding")).alias("r"), F.count("*").alias("w"))
    held = scratch.table(classes.select("r.vec_id", "w", "label", "h1", "h2", "r.embedding").mapInPandas(filters, f"vec_id long, w long, label long, h1 long, h2 long, dim int, x binary, filters array<{code_type}>"))
    slots = held.select("label", "dim", F.explode("filters").alias("f"), "vec_id", "w", "x", "filters")
    sizes = held.select("label", "dim", F.explode("filters").alias("f")).groupBy("label", "dim", "f").agg(F.count("*").alias("n"))
    large = scratch.table(sizes.where(F.col("n") > BLOCK))  # a written table, so that Spark knows its size and broadcasts it only if small
    parts = F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1))
    dealt = (
        slots.join(large, ["label", "dim", "f"], "left")
        .withColumn("blk", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
        .withColumn("y", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("label", "dim", "f", F.least("blk", "y").alias("i"), F.greatest("blk", "y").alias("j"), "blk", "vec_id", "w", "x", "filters")
    )

    keys = ["label", "dim", "f", "i", "j"]

    def links(batches):
        for t in whole_groups(batches, keys):
            dim, f, i, j = (t[k].to_numpy() for k in keys[1:])
            ids, blk, weight = (t[k].to_numpy() for k in ("vec_id", "blk", "w"))
            ends = starts_of(t, keys) + [len(t)]
            lists = t["filters"].combine_chunks()
            x, flat, at = t["x"].combine_chunks().cast(pa.binary()), lists.values.to_numpy(), lists.offsets.to_numpy()
            data, first = np.frombuffer(x.buffers()[2], dtype=stored), np.frombuffer(x.buffers()[1], dtype=np.int32)[x.offset :]
            out = []
            for a, b in zip(ends, ends[1:]):
                if b - a < 2:
                    continue
                block = data[first[a] // data.itemsize : first[b] // data.itemsize].reshape(b - a, dim[a]).astype(np.float64)
                block /= np.sqrt(np.einsum("ij,ij->i", block, block))[:, None]
                found = block_links(ids[a:b], block, blk[a:b] if i[a] != j[a] else None, weight[a:b], f[a], flat, at[a : b + 1])
                if found is not None:
                    out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in zip(*out)], ["vec_id", "n", "root"])

    def block_links(ids, x, blk, weight, f, flat, at):
        """Of the rows with links in a block: ids, weighted counts of the pairs counted here, smallest ids reached."""
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if blk is not None:
            near &= blk[:, None] != blk[None, :]
        touched = np.flatnonzero(near.any(axis=1))
        if not len(touched):
            return None
        near, ids, weight = near[np.ix_(touched, touched)], ids[touched], weight[touched]
        lists = [flat[at[r] : at[r + 1]] for r in touched]
        who = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
        codes = np.concatenate(lists)
        smaller = codes < f
        counted = near
        if smaller.any():
            values, column = np.unique(codes[smaller], return_inverse=True)
            inside = np.zeros((len(ids), len(values)), dtype=np.float32)
            inside[who[smaller], column] = 1
            counted = near & ~(inside @ inside.T > 0)
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root, np.where(near, root[None, :], len(ids)).min(axis=1))
            if (low == root).all():
                break
            root = low
        return ids, counted @ weight, ids[root]

    grouped = dealt.repartition(*keys).sortWithinPartitions(*keys, "vec_id")
    found = scratch.table(grouped.mapInArrow(links, "vec_id long, n long, root long"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    comps = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), scratch)
    found_by_class = (
        held.select("vec_id", "label", "h1", "h2", "w")
        .join(counts, "vec_id", "left")
        .join(comps.select(F.col("node").alias("vec_id"), F.col("component").alias("component_id")), "vec_id", "left")
        .select("label", "h1", "h2", (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    )
    out = (
        one.select("vec_id", "label", "h1", "h2")
        .join(found_by_class, ["label", "h1", "h2"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(nameless)
