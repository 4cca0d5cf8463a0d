"""A corpus from raw documents: toxicity, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontam, lines, minhash, packing, toxicity
from pathloom.llm.common import Scratch, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7."""
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated line windows; those of which nothing is left go, and n_chars,
    where there is one, follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = lines.dedup_lines(docs, keep=tuple(rest)).where("n_removed = 0 or text rlike '\\\\S'")
    own = {c: F.col("kept").getField(c) for c in rest} | {c: F.col(c) for c in ("doc_id", "text")}
    if "n_chars" in rest:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.col("n_removed") == 0, own["n_chars"]).otherwise(F.length("text").cast(kind))
    return out.select(*[own[c].alias(c) for c in docs.columns])


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str, small: int = 500_000) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id. Rows of null doc_id stay.

    Where a doc_id has several rows, each row is a document of its own: it gets a number in the order of (doc_id, digest
    of the text) for this stage, so that a row goes only if its own text is a copy.
    """
    scratch, columns = Scratch(spark, "gone"), docs.columns
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    key = "doc_id"
    if not repeated.isEmpty():
        key = next(f"row{i}" for i in range(len(columns) + 1) if f"row{i}" not in columns)
        ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
        number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
        docs = scratch.table(ordered.withColumn(key, number))
    near = minhash.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"))
    gone = scratch.table(near.where("not kept").select(F.col("doc_id").alias(key)).distinct())
    return docs.join(F.broadcast(gone) if gone.limit(small + 1).count() <= small else gone, key, "left_anti").select(columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, even with a fifth of its words edited."""
    return decontam.reject_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 2048 ids; with less held by a worker, which has run other stages before."""
    return packing.pack_documents(docs, cache=200_000, chars=2_000_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

ORACLE_SQL = None  # subword tokenizers and edit distances over whole texts are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what a stage returns is written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
