"""Personal data: base patterns, and spans of a character-level bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, texts_of

BASE = ("email", "ip", "card", "phone")
MODEL = ("lstm_email", "lstm_ip", "lstm_card", "lstm_phone", "lstm_id")
# Possessive, and tried once a run of their first characters: what fails at a run's start fails further on in it too.
EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL_HERE.pattern)
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping addresses. A match may end within a run of characters that the next one can begin with."""
    at = 0
    while m := EMAIL_HERE.match(text, at) or EMAIL.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches a kind; failing ones go without another try. Linear in the text's length."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# ---- labelled spans ----------------------------------------------------------------------------------------------

SYLLABLES = "the an re or ti es en on ed is in at he a ou th er ing de la le un qui et des les que con der die und ein ich zu ge ver para los ción ado mente é è ö ü ñ".split()


def invented(rng: random.Random) -> tuple[str, int | None]:
    """Something with digits or signs, and its kind; None where it is not personal data."""
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    pick = rng.random()
    if pick < 0.13:
        return rng.choice([f"{name()}.{num(2)}@mail{num(1)}.example.com", f"{name()}@{name()}.{rng.choice(['org', 'net', 'de', 'co.uk'])}", f"{name()}_{name()}@{name()}.com"]), 0
    if pick < 0.21:
        return rng.choice([f"{name()} @ {name()}.com", f"{name()}(at){name()}.org", f"{name()}[at]{name()}[dot]com"]), 0
    if pick < 0.31:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4)), 1
    if pick < 0.40:
        n = rng.choice(["4", "5"]) + num(14)
        n += next(c for c in "0123456789" if luhn(n + c))
        return rng.choice(["", " ", "-", "."]).join(n[i : i + 4] for i in range(0, 16, 4)), 2
    if pick < 0.50:
        return rng.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"+{rng.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"+{num(11)}"]), 3
    if pick < 0.62:
        return rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{rng.randint(10, 99)} {num(3)} {num(7)}"]), 3
    if pick < 0.70:
        return rng.choice([f"{num(3)}-{num(2)}-{num(4)}", f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}"]), 4
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40)))
    return (
        rng.choice(
            [num(rng.randint(1, 5)), f"{rng.randint(1900, 2030)}", f"{num(2)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(1)},{num(3)}.{num(2)}", f"${num(3)}.{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"#{num(6)}", f"{num(1)}/{num(2)}", f"password={hexes}", f'token = "{hexes}"', f"AKIA{num(4)}{word().upper()}", hexes, f"@{word()}", f"x{num(7)}", f"{num(1)}-{num(1)}", num(rng.randint(6, 9)), f"{word()}{num(2)}", f"{word()} at {word()} dot"]
        ),
        None,
    )


def prose(rng: random.Random) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 24))]
    return "".join((w.capitalize() if rng.random() < 0.1 else w) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for w in words)


def example(rng: random.Random, texts: list[str] = ()) -> tuple[str, list[tuple[int, int, int]]]:
    """A piece of one of `texts`, or invented prose, with invented data put between its words: (text, spans of (kind,
    start, end)). What the base patterns find in the piece itself is labelled as well."""
    piece = prose(rng)
    if texts and rng.random() < 0.7:
        whole = rng.choice(texts)
        at = rng.randrange(max(1, len(whole) - 100))
        piece = whole[at : at + rng.randint(60, 240)]
    spans = [(BASE.index(k), a, b) for k, a, b in base_spans(piece)]
    gaps = [m.end() for m in re.finditer(r"\s", piece) if not any(a < m.end() < b for _, a, b in spans)]
    for at in sorted(rng.sample(gaps, min(len(gaps), rng.randint(0, 3))), reverse=True):
        data, kind = invented(rng)
        data += rng.choice([" ", " ", ", ", ". ", "\n"])
        spans = [(k, a + len(data) * (a >= at), b + len(data) * (a >= at)) for k, a, b in spans]
        if kind is not None:
            spans.append((kind, at, at + len(data.rstrip(" ,.\n"))))
        piece = piece[:at] + data + piece[at:]
    return piece, sorted(spans, key=lambda x: x[1])


# ---- the model ---------------------------------------------------------------------------------------------------

CHARS = "abcdefghijklmnopqrstuvwxyz0123456789 .,@+-()[]:;/#$%_='\"\n&*!?|"
CODES = {c: i + 2 for i, c in enumerate(CHARS)}
UPPER, OTHER = 0, 1
TAGS = 1 + 2 * len(MODEL)  # O, then begin and inside for each kind
_CODES = np.array([CODES.get(chr(i), UPPER if chr(i).isupper() else OTHER) for i in range(1 << 16)], dtype=np.uint8)


def codes(text: str) -> np.ndarray:
    return _CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), (1 << 16) - 1)]


def tags(spans, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    return out


class Tagger:
    """Embedding, an LSTM in either direction, a linear layer to tag scores, and CRF transitions; all in numpy.

    Gates are hard sigmoids, clip(x / 4 + 1 / 2, 0, 1), and states hard hyperbolic tangents, clip(x, -1, 1): every
    character of a corpus goes through them. A span begins after a character of none.
    """

    def __init__(self, embed: int = 8, hidden: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
        self.h = hidden
        self.p = {"E": rng.standard_normal((len(CHARS) + 2, embed)) * 0.3, "O": g(2 * hidden, TAGS), "o": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        for d in "fb":
            b = np.zeros(4 * hidden)
            b[hidden : 2 * hidden] = 1.0  # forget gates start open
            self.p |= {f"W{d}": g(embed, 4 * hidden), f"U{d}": g(hidden, 4 * hidden), f"b{d}": b}
        self.allowed = np.array([[b == 0 or (a == 0 if b % 2 else a in (b, b - 1)) for b in range(TAGS)] for a in range(TAGS)])

    def lstm(self, x: np.ndarray, d: str):
        """x: (time, batch, embed), already reversed for 'b'. Hidden states, and what the way back needs."""
        h, p = self.h, self.p
        z = x @ p[f"W{d}"] + p[f"b{d}"]
        hs, cs = np.zeros((len(x) + 1, x.shape[1], h)), np.zeros((len(x) + 1, x.shape[1], h))
        gates = np.empty((len(x), x.shape[1], 4 * h))
        for t in range(len(x)):
            a = z[t] + hs[t] @ p[f"U{d}"]
            a[:, : 3 * h] = np.clip(a[:, : 3 * h] / 4 + 0.5, 0, 1)
            a[:, 3 * h :] = np.clip(a[:, 3 * h :], -1, 1)
            gates[t] = a
            cs[t + 1] = a[:, h : 2 * h] * cs[t] + a[:, :h] * a[:, 3 * h :]
            hs[t + 1] = a[:, 2 * h : 3 * h] * np.clip(cs[t + 1], -1, 1)
        return hs, cs, gates

    def scores(self, c: np.ndarray) -> np.ndarray:
        """Tag scores (tags, time, batch) of codes (batch, time), in single precision. Arrays lie with the batch last,
        and a character's part of all gates is one column of a table."""
        h, (batch, length), out = self.h, c.shape, np.empty((TAGS, c.shape[1], c.shape[0]), np.float32)
        scale = np.concatenate([np.full(3 * h, 0.25), np.ones(h)])
        out[:] = self.p["o"].astype(np.float32)[:, None, None]
        c = np.ascontiguousarray(c.T)
        g, own, tops = np.empty((4 * h, batch), np.float32), np.empty((4 * h, batch), np.float32), np.empty((h, length, batch), np.float32)
        for d in "fb":
            table = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]
            table[:, : 3 * h] += 2  # a quarter of it is the half of the hard sigmoid
            table = np.ascontiguousarray((table * scale).T.astype(np.float32))
            u = np.ascontiguousarray((self.p[f"U{d}"] * scale).T.astype(np.float32))
            o = np.ascontiguousarray((self.p["O"][:h] if d == "f" else self.p["O"][h:]).T.astype(np.float32))
            state, cell, one = np.zeros((h, batch), np.float32), np.zeros((h, batch), np.float32), np.empty((h, batch), np.float32)
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                np.matmul(u, state, out=g)
                np.take(table, c[t], axis=1, out=own, mode="clip")
                g += own
                np.clip(g[: 3 * h], 0, 1, out=g[: 3 * h])
                np.clip(g[3 * h :], -1, 1, out=g[3 * h :])
                cell *= g[h : 2 * h]
                np.multiply(g[:h], g[3 * h :], out=one)
                cell += one
                np.clip(cell, -1, 1, out=state)
                state *= g[2 * h : 3 * h]
                tops[:, t] = state
            out += (o @ tops.reshape(h, -1)).reshape(out.shape)
        return out

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.p["T"], -1e4)

    def loss(self, c: np.ndarray, y: np.ndarray):
        """Mean negative log likelihood of the CRF, and its gradients."""
        p, h = self.p, self.h
        x = p["E"][c.T]
        runs = {"f": self.lstm(x, "f"), "b": self.lstm(x[::-1], "b")}
        top = np.concatenate([runs["f"][0][1:], runs["b"][0][1:][::-1]], axis=2)
        s = top @ p["O"] + p["o"]
        tr, (n, batch, k), y = self.transitions(), s.shape, y.T
        low = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = s[0]
        for t in range(1, n):
            alpha[t] = s[t] + low(alpha[t - 1][:, :, None] + tr[None], 1)
        for t in range(n - 2, -1, -1):
            beta[t] = low(tr[None] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        z = low(alpha[-1], 1)
        rows = np.arange(batch)
        gold = sum(s[t, rows, y[t]] for t in range(n)) + sum(tr[y[t - 1], y[t]] for t in range(1, n))
        ds = np.exp(alpha + beta - z[None, :, None])
        dt = np.zeros((k, k))
        for t in range(1, n):
            dt += np.exp(alpha[t - 1][:, :, None] + tr[None] + (s[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.subtract.at(dt, (y[t - 1], y[t]), 1)
        for t in range(n):
            ds[t, rows, y[t]] -= 1
        ds /= batch
        g = {"T": np.where(self.allowed, dt / batch, 0), "O": np.einsum("tbi,tbj->ij", top, ds), "o": ds.sum(axis=(0, 1))}
        dtop = ds @ p["O"].T
        dx = np.zeros_like(x)
        for d, part in (("f", dtop[:, :, :h]), ("b", dtop[::-1, :, h:])):
            hs, cs, gates = runs[d]
            inp = x if d == "f" else x[::-1]
            da = np.empty_like(gates)
            dh, dc = np.zeros((batch, h)), np.zeros((batch, h))
            for t in range(n - 1, -1, -1):
                i, f, o, u = (gates[t][:, j * h : (j + 1) * h] for j in range(4))
                dh = dh + part[t]
                tc = np.clip(cs[t + 1], -1, 1)
                dc = dc + dh * o * (np.abs(tc) < 1)
                free = lambda g: 0.25 * ((g > 0) & (g < 1))
                da[t] = np.concatenate([dc * u * free(i), dc * cs[t] * free(f), dh * tc * free(o), dc * i * (np.abs(u) < 1)], axis=1)
                dh, dc = da[t] @ p[f"U{d}"].T, dc * f
            g |= {f"W{d}": np.einsum("tbi,tbj->ij", inp, da), f"U{d}": np.einsum("tbi,tbj->ij", hs[:-1], da), f"b{d}": da.sum(axis=(0, 1))}
            dinp = da @ p[f"W{d}"].T
            dx += dinp if d == "f" else dinp[::-1]
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], c.T, dx)
        return float((z - gold).mean()), g

    def fit(self, rows, epochs: int = 8, batch: int = 32, rate: float = 0.03, length: int = 96, seed: int = 5) -> list[float]:
        """Adam on windows of `length` characters of (text, spans)."""
        rng = np.random.default_rng(seed)
        c, y = [], []
        for text, spans in rows:
            a, b = codes(text), tags(spans, len(text))
            for at in range(0, max(1, len(a) - length // 2), length):
                c.append(np.pad(a[at : at + length], (0, max(0, length - len(a[at : at + length]))), constant_values=CODES[" "]))
                y.append(np.pad(b[at : at + length], (0, max(0, length - len(b[at : at + length])))))
        c, y = np.stack(c).astype(np.int64), np.stack(y)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, said = 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(c)), 0.0
            for at in range(0, len(c), batch):
                part = order[at : at + batch]
                loss, g = self.loss(c[part], y[part])
                total += loss * len(part)
                scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum((v * v).sum() for v in g.values()))))
                step += 1
                lr = rate * (1 - epoch / epochs) + 0.001
                for k, v in g.items():
                    a, b = m[k]
                    a *= 0.9
                    a += 0.1 * scale * v
                    b *= 0.99
                    b += 0.01 * (scale * v) ** 2
                    self.p[k] -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            said.append(total / len(c))
        return said

    def viterbi(self, s: np.ndarray) -> np.ndarray:
        """The best tag sequence (batch, time) of each of some stretches' scores (batch, time, tags), no span being
        before or after a stretch."""
        tr, (batch, n, _) = self.transitions(), s.shape
        best, back = tr[0] + s[:, 0], np.empty((n, batch, TAGS), dtype=np.int8)
        for t in range(1, n):
            v = best[:, :, None] + tr
            back[t] = v.argmax(axis=1)
            best = v.max(axis=1) + s[:, t]
        path, rows = np.empty((batch, n), dtype=np.int64), np.arange(batch)
        path[:, -1] = (best + tr[:, 0]).argmax(axis=1)
        for t in range(n - 1, 0, -1):
            path[:, t - 1] = back[t][rows, path[:, t]]
        return path

    def decode(self, s: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """(kind, start, end) of the spans within stretches of scores (tags, time); stretches of like length together."""
        order, to = np.argsort(end - begin, kind="stable"), len(begin)
        while to:
            # the longest ones that are left, at most as many as have eight thousand characters together
            n = int((end - begin)[order[to - 1]])
            part = order[max(0, to - max(1, 8000 // n)) : to]
            to -= len(part)
            place = begin[part][:, None] + np.arange(n)
            x = s[:, np.minimum(place, s.shape[1] - 1)].transpose(1, 2, 0).astype(np.float64)
            x[place >= end[part][:, None]] = [0.0] + [-1e6] * (TAGS - 1)
            path = self.viterbi(x)
            for r in np.flatnonzero(path.any(axis=1)).tolist():
                tags, at = path[r].tolist(), 0
                while at < n:
                    past = at + 1
                    if tags[at]:
                        while past < n and tags[past] == tags[at] + 1:
                            past += 1
                        yield (tags[at] - 1) // 2, int(begin[part[r]]) + at, int(begin[part[r]]) + past
                    at = past

    def open_stretches(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of where the best tag sequence of scores (tags, time) may have spans; elsewhere it is O for
        certain. All kinds are bounded together first, then each by itself in what is left."""
        begin, end = runs(self.bound(s, range(1, TAGS, 2)))
        if not len(begin):
            return begin, end
        # the stretches side by side, with a character of none between them
        size = end - begin + 1
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(begin - first, size)
        x = s[:, np.minimum(place, s.shape[1] - 1)]
        x[1:, first + size - 1] = -1e6
        may = np.zeros(len(place), dtype=bool)
        for b in range(1, TAGS, 2):
            may |= self.bound(x, [b])
        a, z = runs(may)
        return place[a], place[z - 1] + 1

    def bound(self, s: np.ndarray, begins) -> np.ndarray:
        """Whether the best tag sequence may have a span of the kinds with these B tags at a character.

        A span adds at most c + the sum of g over its characters to the score of the sequence with O in its place: g is
        what a character gains at most over O, with a transition within a span, and c what the two transitions at the
        ends gain beyond that. A character that no run with c + sum g >= 0 goes through is in no span of the best
        sequence.
        """
        tr = self.transitions()
        within = max(max(tr[b, b + 1], tr[b + 1, b + 1]) for b in begins) - tr[0, 0]
        # n characters have n + 1 transitions: two at the ends and n - 1 within, of which the sum of g counts n
        c = max(tr[0, b] + max(tr[b, 0], tr[b + 1, 0]) for b in begins) - 2 * tr[0, 0] - within
        top = s[1:] if len(begins) > 1 else s[begins[0] : begins[0] + 2]
        total = np.zeros(s.shape[1] + 1)
        np.cumsum(np.maximum.reduce(top, axis=0) - s[0] + np.float32(within), dtype=np.float64, out=total[1:])
        low, high = np.minimum.accumulate(total)[:-1], np.maximum.accumulate(total[::-1])[::-1][1:]
        return high - low + c + 1e-3 >= 0


def runs(may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], may, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


_TRAINED: dict = {}


def trained(texts: tuple[str, ...] = (), examples: int = 600, epochs: int = 8) -> Tagger:
    """The tagger, trained on `examples` labelled pieces of `texts` (see `example`); the same one for the same texts."""
    key = (texts, examples, epochs)
    if key not in _TRAINED:
        rng, model = random.Random(3), Tagger()
        model.fit([example(rng, texts) for _ in range(examples)], epochs)
        _TRAINED.clear()
        _TRAINED[key] = model
    return _TRAINED[key]


def sample(docs: DataFrame, most: int = 200, most_bytes: int = 4000) -> tuple[str, ...]:
    """At most `most` texts of at most `most_bytes` bytes each, those with the smallest hashes: what a model is trained on."""
    # digests first, so that the driver gets no text but those that are taken
    short = docs.select("text", F.xxhash64("text").alias("h")).where(F.octet_length("text").between(1, most_bytes))
    taken = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(most).collect()]
    rows = short.where(F.col("h").isin(taken)).groupBy("h").agg(F.min("text").alias("text")).collect()
    return tuple(r["text"] for r in sorted(rows, key=lambda r: r["h"]))


def plausible(kind: int, text: str) -> bool:
    """A check of the model's own output: does a span hold what its kind consists of?"""
    d = len(digits_of(text))
    if kind == 0:
        return bool(re.search(r"@|[(\[]at[)\]]", text)) and bool(re.search(r"\.|\[dot\]", text))
    if kind == 1:
        p = text.split(".")
        return len(p) == 4 and all(x.isascii() and x.isdigit() and len(x) < 9 and int(x) <= 255 for x in p)
    if kind == 2:
        return 13 <= d <= 19 and luhn(digits_of(text))
    return 8 <= d <= (15 if kind == 3 else 24)


MIDDLE, MARGIN = 192, 16


def model_spans(texts: list[str], model: Tagger, taken: list[list], batch: int = 1024, chars: int = 1_000_000) -> list[list[tuple[str, int, int]]]:
    """The model's spans for each text that touch none of `taken`.

    Every text is covered by windows of MIDDLE characters and a MARGIN on both sides, and all of them are run. Of two
    windows that overlap, a character takes the scores of the one that it lies deeper in; then each text is decoded as
    one, so that a span across a window's edge comes out whole and once. Texts go through by about `chars` characters.
    """
    out: list = [[] for _ in texts]
    first, n = 0, 0
    for i, text in enumerate(texts):
        n += len(text)
        if n >= chars or i == len(texts) - 1:
            for k, kind, a, b in tagged(texts[first : i + 1], model, batch):
                t = texts[first + k]
                whole = (b == len(t) or not t[b].isalnum()) and (a == 0 or not t[a - 1].isalnum())
                if whole and plausible(kind, t[a:b]) and not any(a < e and x < b for _, x, e in taken[first + k]):
                    out[first + k].append((MODEL[kind], a, b))
            first, n = i + 1, 0
    return [sorted(x, key=lambda y: y[1]) for x in out]


def tagged(texts: list[str], model: Tagger, batch: int):
    """(text's place, kind, start, end) of all spans that the model sees."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    windows = -(-length // MIDDLE)
    places, first = np.cumsum(windows * MIDDLE + 2 * MARGIN), np.concatenate([[0], np.cumsum(windows)])
    flat = np.full(int(places[-1]), CODES[" "], dtype=np.uint8)
    begin = places - windows * MIDDLE - MARGIN
    for at, t in zip(begin.tolist(), texts):
        flat[at : at + len(t)] = codes(t)
    start = np.repeat(begin - MARGIN, windows) + MIDDLE * (np.arange(first[-1]) - np.repeat(first[:-1], windows))
    # the windows' middles side by side: text i from place MIDDLE * first[i] on
    s = np.empty((TAGS, int(first[-1]) * MIDDLE), dtype=np.float32)
    for at in range(0, len(start), batch):
        part = start[at : at + batch]
        got = model.scores(flat[part[:, None] + np.arange(MIDDLE + 2 * MARGIN)])
        s[:, at * MIDDLE : (at + len(part)) * MIDDLE] = got[:, MARGIN:-MARGIN].transpose(0, 2, 1).reshape(TAGS, -1)
    for i in range(len(texts)):  # no span lies behind a text's end, or goes on from one text to the next
        a, b = int(first[i]) * MIDDLE, int(first[i + 1]) * MIDDLE
        s[1:, a + int(length[i]) : b] = -1e6
    at = MIDDLE * first[:-1]
    begin, end = model.open_stretches(s)
    for kind, a, b in model.decode(s, *cut(begin, end, at)):
        i = int(np.searchsorted(at, a, side="right")) - 1
        yield i, kind, a - int(at[i]), b - int(at[i])


def cut(begin: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches cut at places."""
    at = np.unique(at)
    over = np.searchsorted(begin, at, side="left") - 1
    inside = at[(over >= 0) & (at < end[np.maximum(over, 0)])] if len(begin) else at[:0]
    return np.sort(np.concatenate([begin, inside])), np.sort(np.concatenate([end, inside]))


def joined(spans) -> str:
    rank = {k: i for i, k in enumerate(BASE + MODEL)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (rank[s[0]], s[1], s[2])))


def find_pii(docs: DataFrame, examples: int = 600, epochs: int = 8, train_texts: int = 200, train_bytes: int = 4000) -> DataFrame:
    """Scans every whole text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_model, n_spans.

    Spans are kind:start:end in code points, the end exclusive; the model's kinds begin with lstm_ and never touch a
    base span. A null text counts as empty and gives no spans. Repeated rows give equal rows; null doc_ids are kept;
    other columns are ignored. No shuffle; the model (some ten thousand weights) goes along with the tasks.

    The model is trained on the driver, on `examples` pieces of at most `train_texts` texts of at most `train_bytes`
    bytes each (those with the smallest hashes), with invented data of all kinds put between their words.
    """
    model = trained(sample(docs, train_texts, train_bytes), examples, epochs)

    @lean
    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            base = [base_spans(t) for t in texts]
            rows = []
            for b, more in zip(base, model_spans(texts, model, base)):
                n = [sum(s[0] == k for s in b) for k in BASE]
                rows.append((*n, hashlib.sha256(joined(b).encode()).hexdigest(), joined(b + more), len(more), len(b) + len(more)))
            if rows:
                kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.int64(),) * 2
                columns = [pa.array(v, k) for v, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_model", "n_spans"])

    return documents(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long, n_spans long")
