"""Sharding: jump consistent hashing of stable keys, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a key among `shards`, by jump consistent hashing (Lamping and Veach 2014).

    From shard b the key jumps to floor((b + 1) / r), r uniform in (0, 1], until the jump passes the last shard. The
    i-th r comes from md5(key : i), so a key and a shard count decide the shard, no table is kept, and a key's walk for
    n + 1 shards is its walk for n with at most one more jump, onto the new shard. A null key hashes as 'null'.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def step(state, i):
        r = (F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967296.0)
        to = F.floor((state["at"] + 1) / r)
        go = state["open"] & (to < shards)
        return F.struct(F.when(go, to).otherwise(state["at"]).alias("at"), go.alias("open"))

    # the first jump is always to shard 0, as r <= 1 takes -1 to 0
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, lanes: int = 1024) -> DataFrame:
    """Deals rows to shards by doc_id and numbers the rows of a shard without gaps.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32 (of the UTF-8 bytes; of no bytes
    for null), law 'key', shard, slot, grown_shard (with one shard more). Rows of equal doc_id share a shard; a null
    doc_id is a key like any other. Repeated rows each get a slot. Other columns are ignored.

    Slots: rows equal in doc_id, size and digest are counted first (a partial sum), however many they are. These classes
    are split into `lanes` lanes a shard by a digest of all three, so that rows of one doc_id spread as well. Running
    totals of the lanes' counts (shards x lanes rows) are the lanes' first slots, running totals within a lane the
    classes', and a class's rows follow one another: no task holds a shard, and no number depends on the table's size.
    """
    empty = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(empty) + F.lit(8)).cast("long").alias("size"), F.crc32(empty.cast("binary")).alias("text_crc32"))
    classes = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    digest = F.md5(F.concat_ws(":", F.lit("lane"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"), F.col("text_crc32").cast("string")))
    lane = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % lanes).cast("int")
    rows = classes.withColumns({"shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1), "lane": lane})
    counts = classes.select(jump_shard(F.col("doc_id"), shards).alias("shard"), lane.alias("lane"), "n").groupBy("shard", "lane").agg(F.sum("n").alias("n"))
    bases = counts.select("shard", "lane", (F.sum("n").over(_over("shard", "lane")) - F.col("n")).alias("base"))
    before = F.sum("n").over(_over(["shard", "lane"], ["doc_id", "size", "text_crc32"])) - F.col("n")
    each = rows.withColumn("before", before).join(bases, ["shard", "lane"]).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("before") + F.col("nth")).cast("long").alias("slot"), "grown_shard")


def _over(by, order):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order)


def _walk(n: int) -> str:
    """SQL for jump_shard: the chain of jumps folded over draws 1 to n."""
    r = "((('0x' || substr(md5(k || ':' || i), 1, 8))::bigint + 1) / 4294967296.0)"
    return f"""
  select k, max(b) as s from (
    select k, b from (
      with recursive j(k, b, i) as (
        select k, 0::bigint, 1 from keys
        union all
        select k, floor((b + 1) / {r})::bigint, i + 1 from j where floor((b + 1) / {r}) < {n})
      select k, b from j)) group by k"""


ORACLE = f"""
with recursive keys as (select doc_id::varchar as k from documents),
a as ({_walk(24)}), g as ({_walk(25)}),
tab as (select list(c order by n) as t from (
  select n, list_reduce(list_prepend(n, range(8)), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as c
  from (select unnest(range(256)) as n))),
d as (
  select doc_id, octet_length(encode(text)) + 8 as size, hex(encode(text)) as h, doc_id::varchar as k from documents),
c1 as (
  select doc_id, size, k,
    xor(4294967295::bigint, list_reduce(
      list_prepend(4294967295::bigint, list_transform(range((len(h) // 2)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
      lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) as crc
  from d, tab),
c as (select *, ('0x' || substr(md5('lane:' || k || ':' || size || ':' || crc), 1, 8))::bigint % 1024 as lane from c1)
select c.doc_id, c.size, c.crc as text_crc32, 'key' as law, a.s::int as shard,
       row_number() over (partition by a.s order by c.lane, c.doc_id, c.size, c.crc) - 1 as slot, g.s::int as grown_shard
from c join a using (k) join g using (k)
"""
