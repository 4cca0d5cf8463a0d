"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens
from .common import documents, lean, texts_of

MAGIC = b"PLEF0001"
EVERY = 64  # a select sample for each so many values


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(universe / n) bits each.

    Low bits are packed, high bits are a unary bit vector; for every EVERY-th value the position of its bit is kept,
    so get(i) reads a few bytes from that position on.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        low_bits = max(0, int(v[-1] // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (v >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[at.astype(np.int64)] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), at[::EVERY].astype("<u4" if not n or at[-1] < 1 << 32 else "<u8"))

    def tobytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return struct.pack("<QBBQQQ", self.n, self.low_bits, self.samples.itemsize, *map(len, parts)) + b"".join(parts)

    @classmethod
    def frombytes(cls, data: bytes) -> tuple[EliasFano, int]:
        n, low_bits, width, *sizes = struct.unpack_from("<QBBQQQ", data)
        at, parts = struct.calcsize("<QBBQQQ"), []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        low, high = (np.frombuffer(p, dtype=np.uint8) for p in parts[:2])
        return cls(n, low_bits, low, high, np.frombuffer(parts[2], dtype=f"<u{width}")), at

    def select(self, i: int) -> int:
        """The position of the i-th set bit of the high part."""
        at = int(self.samples[i // EVERY])
        left, byte = i % EVERY, at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def get(self, i: int) -> int:
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> (first % 8) & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits).astype(np.uint64)
        low = (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if self.low_bits else np.uint64(0)
        return (at - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits) | low


def filesystem(uri: str):
    """The file system and path of a folder that all executors share. A bare path is a mounted one."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class ShardWriter:
    """A file: magic; ids; the boundaries' and doc_ids' Elias-Fano parts; a footer with the sizes. The ids stream to
    disk. The file gets its name when it is whole, so that a lost or repeated task leaves no half file."""

    def __init__(self, folder: str, shard: int, width: int):
        self.fs, root = filesystem(folder)
        self.path, self.tmp = f"{root}/shard-{shard:08d}.plef", f"{root}/.{shard:08d}-{uuid.uuid4().hex}"
        self.fs.create_dir(root, recursive=True)
        self.out, self.width, self.ends, self.keys, self.nulls, self.n = self.fs.open_output_stream(self.tmp), width, [], [], 0, 0
        self.out.write(MAGIC)

    def add(self, key, data: bytes) -> None:
        self.out.write(data)
        self.n += len(data) // self.width
        self.ends.append(self.n)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def close(self) -> tuple[int, int]:
        least = self.keys[0] if self.keys else 0
        ends = EliasFano.of(np.array(self.ends, dtype=np.uint64)).tobytes()
        keys = EliasFano.of(np.array(self.keys, dtype=np.int64).view(np.uint64) - np.array(least, dtype=np.int64).view(np.uint64)).tobytes()
        self.out.write(ends + keys + struct.pack("<QQQQqB", self.n, len(ends), len(keys), self.nulls, least, self.width))
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return len(self.ends), self.n


class ShardReader:
    """Random and whole access to a file of ShardWriter."""

    def __init__(self, folder: str, shard: int):
        fs, root = filesystem(folder)
        self.file = fs.open_input_file(f"{root}/shard-{shard:08d}.plef")
        foot = struct.calcsize("<QQQQqB")
        size = self.file.size()
        assert self.file.read_at(8, 0) == MAGIC, "not an id file"
        self.n, ends, keys, self.nulls, least, self.width = struct.unpack("<QQQQqB", self.file.read_at(foot, size - foot))
        index = self.file.read_at(ends + keys, size - foot - ends - keys)
        self.ends, at = EliasFano.frombytes(index)
        ef, _ = EliasFano.frombytes(index[at:])
        self.doc_ids = [None] * self.nulls + (ef.all() + np.array(least, dtype=np.int64).view(np.uint64)).view(np.int64).tolist()

    def span(self, i: int) -> tuple[int, int]:
        return self.ends.get(i - 1) if i else 0, self.ends.get(i)

    def ids(self, start: int, end: int) -> np.ndarray:
        data = self.file.read_at((end - start) * self.width, 8 + start * self.width)
        return np.frombuffer(data, dtype=f"<u{self.width}")


LEAST = -(1 << 63)


class Shards:
    """Which shard a doc_id belongs to, from sorted quantiles of doc_id (null is the least).

    A doc_id that several quantiles fall on has too many rows for one shard: it gets a shard for each of them, and its
    rows are dealt to these in turn.
    """

    def __init__(self, cuts):
        self.cuts = np.array(cuts, dtype=np.int64)

    def of(self, keys: np.ndarray, turn: np.ndarray) -> np.ndarray:
        first, past = (np.searchsorted(self.cuts, keys, side=s) for s in ("left", "right"))
        return first + turn % np.maximum(1, past - first)


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, rows_per_shard: int = 4096, most_shards: int = 50_000) -> list[dict]:
    """Encodes whole texts (null: empty), appends `end_id` to each, and writes shards in ascending doc_id order.

    Shard k has the doc_ids between two quantiles of doc_id; null doc_ids come first. Rows of equal doc_id are ordered
    by their ids within a shard, and lie in consecutive shards if they are too many for one. Only ids are shuffled, in 2
    bytes each where the vocabulary allows, and shards are dealt to tasks in turn. Returns shard, n_docs, n_ids in order:
    at most `most_shards` rows, the one thing the driver gets; a table of more than rows_per_shard * most_shards rows
    gets larger shards, not fewer rows.
    """
    path = tokenizer or tokens.public_tokenizer("byte_bpe_50k.json")
    width = 2 if max(tokens.encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    d = documents(docs)
    rows = d.count()
    shards = max(1, min(most_shards, -(-rows // rows_per_shard)))
    key = F.coalesce("doc_id", F.lit(LEAST))
    cuts = d.agg(F.percentile_approx(key, [i / shards for i in range(1, shards)], 20 * shards).alias("q")).first()["q"] if shards > 1 else []
    where = Shards(cuts or [])
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    @lean
    def encode(batches):
        enc, turn = tokens.encoder(path, tokens.BatchEncoder), 0
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id")
            keys = ids.fill_null(LEAST).to_numpy(zero_copy_only=False)
            for a, b in tokens.slices(texts, 8_000_000):
                out = [tokens.ids(x).astype(f"<u{width}").tobytes() + end for x in enc.encode(texts[a:b])]
                shard = where.of(keys[a:b], np.arange(turn, turn + b - a))
                turn += b - a
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), ids.slice(a, b - a), pa.array(out, pa.binary())], ["shard", "doc_id", "data"])

    @lean
    def write(batches):
        done, at, writer = [], None, None
        for batch in batches:
            for shard, key, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "data"))):
                if shard != at:
                    if writer:
                        done.append((at, *writer.close()))
                    at, writer = shard, ShardWriter(folder, shard, width)
                writer.add(key, data)
        if writer:
            done.append((at, *writer.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*done)], ["shard", "n_docs", "n_ids"])

    ids = d.mapInArrow(encode, "shard long, doc_id long, data binary")
    spread = ids.repartitionById(min(shards, 20_000), F.pmod(F.col("shard"), F.lit(min(shards, 20_000))).cast("int"))
    spread = spread.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "data")
    return sorted((r.asDict() for r in spread.mapInArrow(write, "shard long, n_docs long, n_ids long").collect()), key=lambda r: r["shard"])


def read_ids(spark, folder: str, shards: list[dict]) -> DataFrame:
    """Reads all files of write_ids: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    base, rows = 0, []
    for s in shards:
        rows.append((s["shard"], base))
        base += s["n_ids"]

    @lean
    def run(batches):
        for batch in batches:
            for shard, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "base"))):
                r = ShardReader(folder, shard)
                ends = r.ends.all().astype(np.int64)
                starts = np.concatenate([np.zeros(1, np.int64), ends])[:-1]
                for a in range(0, len(ends), 1000):
                    b = min(a + 1000, len(ends))
                    ids = r.ids(int(starts[a]), int(ends[b - 1])).astype("<u4")
                    crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts[a:b] - starts[a], ends[a:b] - starts[a])]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (r.doc_ids[a:b], starts[a:b] + base, ends[a:b] - starts[a:b], crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], out)
    return spark.createDataFrame(rows, "shard long, base long").repartition(max(1, min(len(rows), 1000))).mapInArrow(run, out)


def token_files(docs: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """write_ids into a new folder of the cluster's shared one (or `folder`), then read_ids from it."""
    spark = docs.sparkSession
    folder = folder or f"{common.shared_dir(spark)}/pathloom/ids-{uuid.uuid4().hex}"
    return read_ids(spark, folder, write_ids(docs, folder, **how))
