"""Exact, cached use of public subword tokenizers inside Python workers."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The normalizer and the pre-tokenizer of a lower-case word tokenizer, under which WORD_END and capitals don't matter.
WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: A Latin letter (not U+0130, whose small form ends in a mark) and an ASCII sign (not the apostrophe): no word goes on
#: from one to the other, nor do they compose.
WORD_END = r"([a-zA-Z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}])([!-&(-/:-@\[-`{-~])"
#: A capital before what may be a combining mark, with which its small letter may compose where it doesn't.
MARKED_CAPITAL = r"[A-Z][^\x00-\x{2ff}\x{2000}-\x{206f}]"


class ChunkEncoder:
    """Texts -> ids of the tokenizers library, as little-endian unsigned 32-bit bytes.

    The tokenizer sees each distinct space-delimited chunk once. That gives the ids of the whole text, because its
    pre-tokenizer never joins a non-space character and the space after it: a text may be cut in front of each space
    that follows a non-space character, and a chunk's pieces depend on the chunk alone. Where the pre-tokenizer drops
    white space, any cut in front of a space will do; otherwise a text in which white space stands before a space is
    encoded whole. The first `most` chunks, the commonest among them, are kept from one batch to the next and later ones
    for their batch only, so memory does not follow the input. Special tokens in a text are
    ordinary text.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        config = json.loads(self.tokenizer.to_str())
        pre = config["pre_tokenizer"]
        steps = pre.get("pretokenizers", [pre])
        self.drops_space = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in steps)
        self.words = (config["normalizer"], pre) == WORDS and all(t["special"] for t in config["added_tokens"])
        self.most, self.cache = most, {}

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cache, split, new = self.cache, [t.split(" ") for t in texts], set()
        ends = []
        for pieces in split:
            # the first and the last chunk have other neighbours than the rest: they are encoded by themselves
            ends += [pieces[0], " " + pieces[-1] if len(pieces) > 1 else ""]
            new.update(pieces[1:-1])
        new = [p for p in new if p not in cache]
        good = [p for p in new if self.drops_space or p and not p[-1].isspace()]
        found = dict.fromkeys(new) | dict(zip(good, self.encode_whole([" " + p for p in good])))
        cache.update(found)
        ends = self.encode_whole(ends)
        out, odd = [], []
        for i, pieces in enumerate(split):
            if not self.drops_space and len(pieces) > 1 and pieces[0][-1:].isspace():
                odd.append(i)
                out.append(b"")
                continue
            try:
                out.append(ends[2 * i] + b"".join(map(cache.__getitem__, pieces[1:-1])) + ends[2 * i + 1])
            except TypeError:  # a chunk that must not be cut off
                odd.append(i)
                out.append(b"")
        for i, ids in zip(odd, self.encode_whole([texts[i] for i in odd])):
            out[i] = ids
        if len(cache) > self.most:
            for p in found:
                del cache[p]
        return out


class BatchEncoder(ChunkEncoder):
    """The same ids by way of Arrow: cheaper for batches of some million characters, for some more memory. For tokenizers
    of WORDS a text is also cut at line ends and behind words, and put in lower case, so that a word in other company is
    not another chunk."""

    def encode(self, texts: list[str]) -> list[bytes]:
        # the first and the last chunk have other neighbours than the rest: they are encoded by themselves
        firsts, lasts, middles = [], [], []
        for t in texts:
            i, j = t.find(" "), t.rfind(" ")
            firsts.append(t if i < 0 else t[:i])
            lasts.append("" if i < 0 else t[j:])
            middles.append(t[i + 1 : j] if i < j else None)
        # Arrow splits the rest, numbers its distinct chunks, and joins their ids: Python handles distinct chunks only
        split = pc.split_pattern(self.plain(pa.array(middles, "large_string")), " ")
        chunks = split.flatten().dictionary_encode()
        found = self.lookup(chunks.dictionary.to_pylist())
        parts = pa.ListArray.from_arrays(split.offsets, pa.array(found, "large_binary").take(chunks.indices))
        ends, joined = self.encode_whole(firsts + lasts), pc.binary_join(parts, pa.scalar(b"", "large_binary")).to_pylist()
        out = [a + (b or b"") + c for a, b, c in zip(ends, joined, ends[len(texts) :])]
        if not self.drops_space:
            # chunks that must not be cut off make a joined value null, as one of its parts is
            odd = [i for i, b in enumerate(joined) if b is None or len(lasts[i]) and firsts[i][-1:].isspace()]
            for i, data in zip(odd, self.encode_whole([texts[i] for i in odd])):
                out[i] = data
        return out

    def plain(self, texts: pa.Array) -> pa.Array:
        """Texts with the same ids and fewer distinct chunks."""
        if not self.words:
            return texts
        small = pc.if_else(pc.match_substring_regex(texts, MARKED_CAPITAL), texts, pc.ascii_lower(texts))
        return pc.replace_substring(pc.replace_substring_regex(small, WORD_END, r"\1 \2"), "\n", " ")

    def lookup(self, chunks: list[str]) -> list[bytes | None]:
        """The ids of each distinct chunk with a space before it; None where it must not be cut off."""
        cache = self.cache
        out = list(map(cache.get, chunks))
        new = [i for i, (p, v) in enumerate(zip(chunks, out)) if v is None and (self.drops_space or p and not p[-1].isspace())]
        room = len(cache) < self.most
        for i, data in zip(new, self.encode_whole([" " + chunks[i] for i in new])):
            out[i] = data
            if room:
                cache[chunks[i]] = data
        return out


def slices(texts: list[str], chars: int = 2_000_000):
    """Runs (from, to) of texts with about `chars` characters each."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, kind: type[ChunkEncoder] = ChunkEncoder, most: int = 600_000) -> ChunkEncoder:
    """One encoder a worker: the one that it last asked for."""
    if (path, kind, most) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, kind, most] = kind(path, most)
    return _ENCODERS[path, kind, most]


def ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4")
