"""Shared helpers: scratch tables in the cluster's checkpoint folder, word hashing, graph components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local one is made for a local
    master (tests); on a cluster that would be another folder on each machine, so it is an error there."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written below the shared folder, so that a lost executor costs no recomputation of what came before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pathloom/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that later steps no longer read."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def lean(fn):
    """For functions of mapInArrow and applyInArrow: what a task held goes back to the system when it ends, so that a
    worker that waits for its next task keeps only what its module keeps on purpose."""

    @functools.wraps(fn)
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def small_batches(spark: SparkSession, most: int = 8_000_000) -> None:
    """Arrow batches of texts end at `most` bytes, so that neither side of a worker holds more than a few of them. A
    session that sets the bytes itself keeps its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864"):
        spark.conf.set(key, str(most))


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text, for functions of mapInArrow."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text")


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The texts of a batch, null ones as empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


class WordHashes(dict):
    """Raw whitespace-delimited token -> 64-bit hash of its letters and digits in lower case; 0 for tokens with none.

    The first `most` tokens, the commonest among them, are kept and later ones are hashed again each time, so a worker's
    memory does not follow the input.
    """

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        word = "".join(c for c in token.lower() if c.isalnum())
        out = (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1) if word else 0
        if len(self) < self.most:
            self[token] = out
        return out

    def words(self, text: str) -> np.ndarray:
        tokens = text.split()
        out = np.fromiter(map(self.__getitem__, tokens), dtype=U64, count=len(tokens))
        return out[out != 0]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, on arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def run_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - k + 1, dtype=U64)
        for i in range(k):
            out = out * U64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i]
        return mix(out + U64(k))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the component being the smallest node in it.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edge set is stable. Every step is a
    partial minimum and an equi-join, so a hub with very many links is combined map-side and its join is split.
    """
    cur = scratch.table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        nxt = scratch.table(small)
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        scratch.drop(cur)
        cur = nxt
        if now == before:
            break
        before = now
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
