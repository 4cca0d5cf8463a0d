"""Benchmark decontamination: pigeonhole pieces, exact hits, and Myers bit-parallel distance."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, WordHashes, documents, lean, run_hash, small_batches, texts_of
from .idfiles import filesystem
from .tokens import slices


def myers(pattern, text) -> list[int]:
    """For each end in `text`, the least edit distance of `pattern` to a part of the text that ends there.

    Myers' bit-parallel column (1999) on Python's long integers, so a pattern may have any length.
    """
    m = len(pattern)
    masks: dict = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        out.append(score)
    return out


def budget(n: int, similarity: float = 0.8) -> int:
    """The edits that an item of n words may differ by."""
    return int(n * (1 - similarity) + 1e-9)


class Items:
    """A block of benchmark items, with an index of their pieces: `budget + 1` pieces an item, one of which an edited
    copy within the budget must hold unchanged (pigeonhole)."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8):
        hashes = WordHashes()
        self.words, self.pieces = {}, {}
        for key, text in items:
            w = hashes.words(text or "")
            if not len(w):
                continue
            self.words[key] = w.tolist()
            parts = budget(len(w), similarity) + 1
            cuts = [len(w) * i // parts for i in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                self.pieces.setdefault(b - a, {}).setdefault(int(run_hash(w[a:b], b - a)[0]), []).append((key, a))
        self.similarity = similarity
        self.sorted = {k: np.array(sorted(v), dtype=U64) for k, v in self.pieces.items()}
        self.vocabulary = np.unique(np.array([x for w in self.words.values() for x in w], dtype=U64))

    def hits(self, words: np.ndarray) -> dict[int, list[int]]:
        """item -> the places in `words` where the item would start, by its pieces' exact hits."""
        found: dict[int, list[int]] = {}
        for k, keys in self.sorted.items():
            if len(words) < k:
                continue
            h = run_hash(words, k)
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            for p in np.flatnonzero(keys[at] == h).tolist():
                for item, offset in self.pieces[k][int(h[p])]:
                    found.setdefault(item, []).append(p - offset)
        return found

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, distance, first word, end word) of the best match of each item within its budget."""
        out = []
        for item, starts in self.hits(words).items():
            pattern = self.words[item]
            n, k = len(pattern), budget(len(pattern), self.similarity)
            best, seen = None, -1
            for s in sorted(set(starts)):
                a, b = max(0, s - k), min(len(words), s + n + k)
                if b <= seen:
                    continue
                scores = myers(pattern, words[a:b].tolist())
                d = min(scores)
                if d <= k and (best is None or d < best[0]):
                    end = a + scores.index(d) + 1
                    back = myers(pattern[::-1], words[max(0, end - n - k) : end].tolist()[::-1])
                    best = d, end - (back.index(min(back)) + 1), end
                seen = b
            if best:
                out.append((item, *best))
        return out


TOKEN = re.compile(r"\S+")


def blocks_of(items: DataFrame, block_bytes: int) -> list[str]:
    """Folders, shared by all executors, that the items were written to in blocks of about `block_bytes` by a hash. The
    driver learns their names only. Parts of an item's row that no text is in are left out."""
    b = items.select(F.col("item_id").cast("long"), "text").where("text is not null")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, scratch = int(total // block_bytes) + 1, Scratch(items.sparkSession, "items")
    return [scratch.table(b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n) if blocks > 1 else b).scratch_path for n in range(blocks)]


def block_rows(folder: str) -> list[tuple[int | None, str]]:
    """The items of one block, in the order of item_id and text."""
    from pyarrow import dataset

    fs, path = filesystem(folder)
    t = dataset.dataset(path, filesystem=fs, format="parquet", schema=pa.schema([("item_id", pa.int64()), ("text", pa.string())])).to_table()
    return sorted(zip(t["item_id"].to_pylist(), t["text"].to_pylist()), key=lambda r: (r[0] is not None, r))


FOUND = ["doc_id", "item_id", "distance", "start", "end"]


def find_benchmark(docs: DataFrame, items: DataFrame, similarity: float = 0.8, block_bytes: int = 8_000_000) -> DataFrame:
    """Documents that hold a benchmark item with at most (1 - similarity) of its words edited.

    Words are letters and digits in lower case. Rows (doc_id, item_id, distance, start, end): for each document and
    item the best match within the item's budget of edits, start and end in code points of the text. Documents without
    a match give no row. Null and empty texts, and items without a word, match nothing; null ids are kept; repeated
    rows give repeated rows; other columns are ignored.

    The items are a stated query set: they are written in blocks of about `block_bytes` by a hash of item_id and text.
    Each block is one pass over all documents without a shuffle, in which a task reads the block for itself, so neither
    side has to fit on the driver or in one task.
    """
    d = documents(docs).where("text is not null")

    def over(folder):
        @lean
        def run(batches):
            scan = Scanner(block_rows(folder), similarity)
            for b in batches:
                found = list(scan.matches(texts_of(b)))
                if found:
                    at, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(v, pa.int64()) for v in rest)], FOUND)

        return run

    out = None
    for folder in blocks_of(items, block_bytes):
        found = d.mapInArrow(over(folder), ", ".join(f"{c} long" for c in FOUND))
        out = found if out is None else out.union(found)
    return out


def reject_contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, block_bytes: int = 8_000_000) -> DataFrame:
    """The rows of `docs`, all columns, that `find_benchmark` finds nothing in."""

    def over(folder):
        @lean
        def run(batches):
            scan = Scanner(block_rows(folder), similarity)
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[m[0] for m in scan.matches(texts_of(b))]] = False
                yield b.filter(pa.array(keep))

        return run

    small_batches(docs.sparkSession)
    for folder in blocks_of(items, block_bytes):
        docs = docs.mapInArrow(over(folder), docs.schema)
    return docs


class Scanner:
    """One block of items, held against texts."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        # null and repeated item_ids are told apart by place
        self.names, self.hashes = [k for k, _ in rows], WordHashes()
        self.index = Items([(i, t) for i, (_, t) in enumerate(rows)], similarity)

    def matches(self, texts: list[str]):
        """(text's place, item_id, distance, start, end)"""
        for a, b in slices(texts):
            w = [self.hashes.words(t) for t in texts[a:b]]
            # one pass over the run of texts; a zero between them keeps pieces from crossing
            flat = np.concatenate([x for y in w for x in (y, np.zeros(1, dtype=U64))])
            ends = np.cumsum([len(x) + 1 for x in w])
            hot = set()
            for k, keys in self.index.sorted.items():
                if len(flat) >= k:
                    h = run_hash(flat, k)
                    at = np.searchsorted(keys, h)
                    at[at == len(keys)] = 0
                    hot.update(np.searchsorted(ends, np.flatnonzero(keys[at] == h), side="right").tolist())
            for i in sorted(hot):
                for item, distance, start, end in self.index.matches(w[i]):
                    yield (a + i, self.names[item], distance, *place(texts[a + i], self.hashes, start, end))


def place(text: str, hashes: WordHashes, first: int, end: int) -> tuple[int, int]:
    """Code points of words first to end - 1."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    spans = [s for s, t in zip(spans, text.split()) if hashes[t]]
    return spans[first][0], spans[max(first, end - 1)][1]
