"""Line dedup: repeated windows of three consecutive lines, found over all documents by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

def dedup_lines(docs: DataFrame, window: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Removes the later occurrences of repeated line windows.

    Each run of `window` consecutive non-blank lines (outer spaces trimmed) is hashed to 128 bits. Of a hash that
    occurs more than once, the occurrence with the smallest (doc_id, text hash, line) stays; the others mark their
    lines, marks of overlapping windows merge, and marked lines go. Blank lines stay.

    Returns doc_id, text, n_lines, n_removed, one row for each row of `docs`. A null text gives null, 0, 0; an empty
    text, or one of fewer than `window` non-blank lines, stays as it is. A null doc_id counts as the smallest. Rows
    that repeat both doc_id and text are one document given twice: they get the same result. The columns named in `keep`
    come along within one struct column `kept`, so that no name of theirs can clash; others are ignored.

    The hash of a hot window meets in a partial minimum first. Repeated hashes and marks are written. Both joins are
    merge joins at every size, as marks grow with the documents, and a hot hash can be split in them.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    d = docs.select("doc_id", "text", *kept).withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(7), "doc_id")})
    lines = F.split("text", "\n", -1)
    filled = F.filter(F.transform(lines, lambda l, i: F.struct(F.trim(l).alias("l"), i.alias("i"))), lambda x: x["l"] != "")

    def windows(nb):
        def one(w):
            at = [F.get(nb, w + F.lit(j)) for j in range(window)]
            return F.struct(
                F.xxhash64(*[x["l"] for x in at]).alias("h1"),
                F.xxhash64(F.lit(11), *[x["l"] for x in at[::-1]]).alias("h2"),
                w.alias("w"),
                F.array(*[x["i"] for x in at]).alias("at"),
            )

        return F.when(F.size(nb) >= window, F.transform(F.sequence(F.lit(0), F.size(nb) - window), one))

    # transform(array(x), f) evaluates x once, however often f uses it
    spans = d.select("doc_id", "k1", "k2", F.explode(F.flatten(F.transform(F.array(filled), windows))).alias("s")).select("doc_id", "k1", "k2", "s.*")
    first = spans.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "k1", "w")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = scratch.table(first)
    later = spans.join(first.hint("merge"), ["h1", "h2"]).where(~F.struct("doc_id", "k1", "w").eqNullSafe(F.col("first")))
    marked = scratch.table(later.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone")))

    def rest(ls):
        stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n")

    return d.join(marked.hint("merge"), ["k1", "k2"], "left").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(F.array(lines), rest)[0]).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        *(["kept"] if keep else []),
    )


ORACLE = """
with l as (
  select doc_id, unnest(range(len(ls))) as i, unnest(ls) as line
  from (select doc_id, string_split(text, chr(10)) as ls from documents)),
f as (select doc_id, i, trim(line) as t, row_number() over (partition by doc_id order by i) as w from l where trim(line) <> ''),
s as (
  select doc_id, w, i as i0, t as t0, lead(i, 1) over o as i1, lead(t, 1) over o as t1, lead(i, 2) over o as i2, lead(t, 2) over o as t2
  from f window o as (partition by doc_id order by w)),
r as (
  select doc_id, i0, i1, i2, row_number() over (partition by t0, t1, t2 order by doc_id, w) as nth from s where t2 is not null),
g as (
  select doc_id, i0 as i from r where nth > 1 union select doc_id, i1 from r where nth > 1 union select doc_id, i2 from r where nth > 1)
select l.doc_id,
       coalesce(string_agg(l.line, chr(10) order by l.i) filter (where g.i is null), '') as text,
       count(*) as n_lines,
       count(g.i) as n_removed
from l left join g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id
"""
