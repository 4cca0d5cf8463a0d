"""Sum-of-squares packing of tokenised documents into windows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import documents, lean, texts_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long"


class SumOfSquares:
    """Online packing of sizes below `size`: each goes to the fill level that minimises the sum of squared counts of
    partially filled windows (Csirik et al. 2006). `counts[h]` is the number of open windows filled up to h, `open[h]`
    has these windows. Of equal choices the fullest window wins. Memory: the open windows only.
    """

    def __init__(self, size: int):
        self.size, self.counts, self.open = size, np.zeros(size + 1, dtype=np.int64), {}

    def place(self, length: int, piece) -> list | None:
        """Puts the piece into a window; returns the window's pieces if that fills it."""
        size, n = self.size, self.counts
        # the change of the sum, halved: taking a window from level h, and adding one at h + length (a full one is gone)
        change = 0.5 - n[: size - length + 1]
        change[0] = 0.0
        change[:-1] += n[length:size] + 0.5
        change[1:][n[1 : size - length + 1] == 0] = np.inf
        h = size - length - int(np.argmin(change[::-1]))
        window = self.open[h].pop() if h else []
        if h:
            n[h] -= 1
        window.append(piece)
        if h + length == size:
            return window
        n[h + length] += 1
        self.open.setdefault(h + length, []).append(window)
        return None

    def rest(self) -> list[list]:
        """The open windows, the fullest first."""
        return [w for h in sorted(self.open, reverse=True) for w in self.open[h]]


def pack_stream(docs, size: int = 2048, least: int = 256):
    """(key, ids as uint32 bytes) -> (window length, [(key, document's ids, start, ids of the piece)]).

    A document gives its full windows straight away, and what is left of it goes to SumOfSquares. At the end the open
    windows are closed by cutting: the emptiest are taken apart to fill the fullest. What is left then is less than
    one window; it is cut into windows of powers of two down to `least`, and the last is padded.
    """
    sos = SumOfSquares(size)
    for key, data in docs:
        n = len(data) // 4
        full = n - n % size
        for at in range(0, full, size):
            yield size, [(key, n, at, data[4 * at : 4 * (at + size)])]
        if n > full:
            window = sos.place(n - full, (key, n, full, data[4 * full :]))
            if window:
                yield size, window
    rest = sos.rest()
    spare: list = []  # pieces of windows taken apart
    at, last = 0, len(rest)

    def take(room: int) -> list:
        nonlocal last
        got = []
        while room and (spare or at < last):
            if not spare:
                last -= 1
                spare.extend(rest[last])
                continue
            key, n, start, data = spare.pop()
            if len(data) // 4 > room:
                spare.append((key, n, start + room, data[4 * room :]))
                data = data[: 4 * room]
            got.append((key, n, start, data))
            room -= len(data) // 4
        return got

    while at < last:
        window = rest[at]
        at += 1
        window += take(size - sum(len(p[3]) // 4 for p in window))
        if sum(len(p[3]) // 4 for p in window) == size:
            yield size, window
        else:
            spare.extend(window)
    left = sum(len(p[3]) // 4 for p in spare)
    while left:
        part = size
        while part > left and part > least:
            part //= 2
        if part > left:
            part = left
        window = take(part)
        left -= part
        yield (part if part & (part - 1) == 0 else size), window


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 1, with_ids: bool = False, cache: int = 600_000, chars: int = 8_000_000) -> DataFrame:
    """Packs documents into windows of at most `size` ids; a row is a piece of a document.

    A document's ids are the tokenizer's for its whole text, then `end_id`; a null or empty text has that id alone.
    Rows: doc_id, start (its ids before the piece), length, ids_crc32, doc_tokens, sequence_id, offset (in the window,
    without gaps), window (padded length), and with `with_ids` ids (unsigned 32-bit bytes). Repeated rows and null
    doc_ids are packed like any others; other columns are ignored; an empty table gives no rows.

    Every input partition is packed by itself as it streams past, with no shuffle: a task holds its open windows
    only, and pads less than one window. sequence_id is the partition's number and a number within it, so a task that
    runs again yields the same windows. A worker keeps the ids of `cache` chunks of text, and encodes texts of about `chars`
    characters at once: more of either save time, not work, and take memory.
    """
    path = tokenizer or tokens.public_tokenizer("word_bpe_49k.json")
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches):
        enc = tokens.encoder(path, tokens.BatchEncoder, cache)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for a, b in tokens.slices(texts, chars):
                for key, data in zip(keys[a:b], enc.encode(texts[a:b])):
                    yield key, data + end

    @lean
    def run(batches):
        base, rows = TaskContext.get().partitionId() << 32, []
        for nth, (length, window) in enumerate(pack_stream(encode(batches), size)):
            offset = 0
            for key, n, start, data in window:
                row = (key, start, len(data) // 4, zlib.crc32(data), n, base + nth, offset, length)
                rows.append(row + (data,) if with_ids else row)
                offset += len(data) // 4
            if len(rows) >= (2_000 if with_ids else 50_000):
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    columns = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

    def table(rows):
        kinds = [pa.int64()] * (len(columns) - with_ids) + [pa.binary()] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], columns)

    return documents(docs).mapInArrow(run, PIECES + ", ids binary" * with_ids)
