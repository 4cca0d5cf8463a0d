"""Toxicity: a lexicon learned from labels, matched with Levenshtein automata run along its trie, scored in context."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, lean, small_batches, texts_of

#: No word holds an underscore, so a raw token whose EDGES are stripped down to letters and digits is the word TOKEN finds in it.
TOKEN = re.compile(r"[^\W_]+(?:[*@$!'’][^\W_]+)*")
MARKS = re.compile(r"[\"“”«»„\n]")
CLOSES = {'"': '"', "“": "”", "«": "»", "„": "“”"}
#: Words that announce a quotation or a mention, in the corpus' languages.
CUES = frozenset("said says wrote quoted called word term disait écrit mot terme sagte schrieb wort begriff dijo escribió palabra término".split())
WINDOW = 24
HEAD = 5
EDGES = ".,;:!?()[]{}|\"“”«»„'’*#%&$-_/\\<>"


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks of a kind on one line, however long, from left to right."""
    out, start = [], -1
    for m in MARKS.finditer(text):
        c, at = m[0], m.start()
        if c == "\n":
            start = -1
        elif start >= 0 and c in CLOSES[text[start]]:
            out.append((start, at + 1))
            start = -1
        elif start < 0 and c in CLOSES:
            start = at
    return out


class LexiconAutomaton:
    """Words within an edit distance of a lexicon's terms.

    A state is a set of (trie node, edits left): the Levenshtein automata of all terms, walked along the trie that the
    terms share. States are made when a text first needs them and are kept with their transitions, so a word costs one
    lookup a character and most words end after three or four. A term of at least 5 letters may differ by one edit,
    one of at least 9 by two. A stem (a term that ends in *) also takes any ending.
    """

    def __init__(self, terms: list[str], most_states: int = 50_000):
        self.terms, self.most = terms, most_states
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, term in enumerate(terms):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append([])
                node = self.kids[node][c]
            self.ends[node].append(i)
        self.may = [0 if len(t.rstrip("*")) < 5 else 1 if len(t.rstrip("*")) < 9 else 2 for t in terms]
        # the most edits that any term below a node allows
        self.below = [0] * len(self.kids)
        for node in range(len(self.kids) - 1, -1, -1):
            self.below[node] = max([self.may[i] for i in self.ends[node]] + [self.below[k] for k in self.kids[node].values()], default=0)
        self.reset()

    def reset(self) -> None:
        self.moves: list[dict[str, int]] = []
        self.hits: list[dict[int, int]] = []  # term -> edits, if the word ends here
        self.stems: list[dict[int, int]] = []  # stem -> edits, met here whatever follows
        self.known: dict[frozenset, int] = {}
        self.parts: list[frozenset] = []
        self.start = self.intern({0: 0})

    def intern(self, edits: dict[int, int]) -> int:
        """The state of node -> fewest edits, closed over letters of terms that the word leaves out."""
        todo = list(edits)
        while todo:
            node = todo.pop()
            for k in self.kids[node].values():
                e = edits[node] + 1
                if e <= self.below[k] and e < edits.get(k, 99):
                    edits[k] = e
                    todo.append(k)
        key = frozenset(edits.items())
        if key not in self.known:
            self.known[key] = len(self.parts)
            self.parts.append(key)
            self.moves.append({})
            met = {i: e for n, e in key for i in self.ends[n] if e <= self.may[i]}
            self.hits.append({i: min(e for n, e in key if i in self.ends[n]) for i in met})
            self.stems.append({i: e for i, e in self.hits[-1].items() if self.terms[i].endswith("*")})
        return self.known[key]

    def step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def put(node, e):
            if e <= self.below[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self.parts[state]:
            put(node, e + 1)
            for letter, k in self.kids[node].items():
                put(k, e + (letter != c))
        to = self.intern(out) if out else -1
        self.moves[state][c] = to
        return to

    def ends_within(self, head: str) -> bool:
        """Is there nothing near the lexicon that starts like this?"""
        state = self.start
        for c in head:
            to = self.moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                return True
            if self.stems[state]:
                return False
        return False

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, the first of equals; None if none is near."""
        if len(self.parts) > self.most:
            self.reset()
        state, found = self.start, {}
        for c in word:
            to = self.moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                break
            for i, e in self.stems[state].items():
                found[i] = min(e, found.get(i, 99))
        if state >= 0:
            for i, e in self.hits[state].items():
                found[i] = min(e, found.get(i, 99))
        return min(found.items(), key=lambda x: x[::-1]) if found else None


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)  # (term, edits) -> log odds
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def scorer(self):
        return Scorer(self)


class Scorer:
    """Scores texts. A raw token (between white space) that holds no near word is remembered, so that a text whose
    tokens are all known costs a set difference; a worker remembers at most `most` tokens."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.automaton, self.clean, self.most = model, LexiconAutomaton(model.terms), set(), most
        self.dead: set[str] = set()  # first HEAD letters after which no term is near

    def near(self, raw: set[str]) -> dict[str, tuple[int, int]]:
        """word -> (term, edits), for the words of these raw tokens that are near the lexicon."""
        out = {}
        match, dead, clean = self.automaton.match, self.dead, self.clean
        room = self.most - len(clean)  # the tokens met first are the commonest: a full memory is kept
        for token in raw - clean:
            word = token.strip(EDGES)
            if word.isalnum():
                head = word[:HEAD]
                if head not in dead:
                    if hit := match(word):
                        out[word] = hit
                        continue
                    if len(dead) < self.most and self.automaton.ends_within(head):
                        dead.add(head)
            elif found := {w: h for w in TOKEN.findall(token) if (h := match(w))}:
                out.update(found)
                continue
            if room > 0:
                clean.add(token)
                room -= 1
        return out

    def features(self, text: str) -> np.ndarray | None:
        """None if no word is near the lexicon; else total weight, best window, hits a hundred words, quoted share, 1.

        A hit within quotation marks, or within three words after a word that announces a quotation, counts a quarter
        in the window scores. A window is WINDOW words from a hit on.
        """
        low = text.lower()
        near = self.near(set(low.split()))
        if not near:
            return None
        quoted = quotations(low)
        hits, q, cue, i = [], 0, -9, 0
        for i, m in enumerate(TOKEN.finditer(low)):
            w = m[0]
            if w in CUES:
                cue = i
            if w in near:
                while q < len(quoted) and quoted[q][1] <= m.start():
                    q += 1
                mention = i - cue <= 3 or q < len(quoted) and quoted[q][0] <= m.start()
                weight = self.model.weights.get(near[w], 0.0)
                hits.append((i, weight * (0.25 if mention else 1.0), mention))
        if not hits:
            return None
        best, total, first = 0.0, 0.0, 0
        run = 0.0
        for at, w, _ in hits:
            run += w
            total += w
            while hits[first][0] < at - WINDOW:
                run -= hits[first][1]
                first += 1
            best = max(best, run)
        return np.array([math.log1p(max(total, 0.0)), min(best, 12.0) / 4, min(100 * len(hits) / (i + 1), 10.0) / 5, sum(h[2] for h in hits) / len(hits), 1.0])

    def score(self, text: str) -> float:
        x = self.features(text)
        z = self.model.coefficients[-1] if x is None else float(x @ self.model.coefficients)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn_lexicon(texts: list[str], labels: list[int], evidence: float = 14.0, most: int = 400, stem: int = 13) -> list[str]:
    """Words, and stems of 4 to `stem` letters (written with *), that tell rows of label 1 from rows of label 0: at most
    `most` terms, those of the greatest evidence.

    A term's support is the smaller of its rows and its distinct left neighbours, so that the words of one much copied
    text count once. Its evidence is the log likelihood ratio of its rows being of label 1 rather than at the overall
    rate. Terms are taken by evidence, the longest of equals first; one whose rows its relatives (stems of it, words
    from it) already have is left out.
    """
    n, n1 = len(texts), sum(labels)
    if not n1 or n1 == n:
        return []
    rate = n1 / n
    rows: dict[str, set[int]] = {}
    left: dict[str, set[str]] = {}
    other: Counter = Counter()
    for r, (text, label) in enumerate(zip(texts, labels)):
        words = TOKEN.findall(text.lower())
        if not label:
            other.update(set(words))
            continue
        for before, w in zip(["", *words], words):
            if len(w) >= 3:
                rows.setdefault(w, set()).add(r)
                left.setdefault(w, set()).add(before)
    for w in list(rows):
        for k in range(4, min(len(w), stem + 1)):
            rows.setdefault(w[:k] + "*", set()).update(rows[w])
            left.setdefault(w[:k] + "*", set()).update(left[w])
    support = {t: min(len(x), len(left[t])) for t, x in rows.items()}
    support = {t: x for t, x in support.items() if -x * math.log(rate) >= evidence}
    negative: Counter = Counter()
    for w, k in other.items():
        for t in (w, *(w[:j] + "*" for j in range(4, min(len(w), stem + 1)))):
            if t in support:
                negative[t] += k

    def ratio(t):
        p, q = support[t], negative[t]
        share = p / (p + q)
        return p * math.log(share / rate) + (q * math.log((1 - share) / (1 - rate)) if q else 0.0) if share > 0.5 else 0.0

    told = {t: g for t in support if (g := ratio(t)) >= evidence}
    chosen: list[str] = []
    for t in sorted(told, key=lambda t: (-told[t], -len(t.rstrip("*")), t.endswith("*"), t)):
        core = t.rstrip("*")
        kin = [c for c in chosen if c.endswith("*") and core.startswith(c[:-1]) or t.endswith("*") and c.startswith(core) or c == core]
        more = rows[t] - set().union(*(rows[c] for c in kin)) if kin else rows[t]
        if len(more) >= max(3, len(rows[t]) / 10):
            chosen.append(t)
            if len(chosen) == most:
                break
    return chosen


def fit(texts: list[str], labels: list[int]) -> Model:
    """Lexicon, log odds for each term and edit count, and a logistic regression on the context features."""
    labels = [int(x) for x in labels]
    model = Model(terms=learn_lexicon(texts, labels))
    n1, n0 = sum(labels), len(labels) - sum(labels)
    scorer = model.scorer()
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for t, y in zip(texts, labels):
        seen[y].update(set(scorer.near(set(t.lower().split())).values()))
    for i in range(len(model.terms)):
        for e in range(scorer.automaton.may[i] + 1):
            prior = 1.0 if e == 0 else 0.5  # an unseen misspelling tells less than its term
            odds = math.log((seen[1][i, e] + 0.5 * prior) / (n1 + 1)) - math.log((seen[0][i, e] + 0.5) / (n0 + 1))
            model.weights[i, e] = max(0.0, min(6.0, odds))
    x = np.array([f if (f := scorer.features(t)) is not None else [0, 0, 0, 0, 1.0] for t in texts]).reshape(-1, 5)
    y = np.array(labels, dtype=float)
    c = np.zeros(5)
    ridge = np.diag([1, 1, 1, 1, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ c)
        c = c + step
        if np.abs(step).max() < 1e-8:
            break
    model.coefficients = c
    return model


def train_rows(docs: DataFrame, labels: DataFrame, most: int = 4000, most_bytes: int = 64_000_000) -> list[tuple[str, int]]:
    """At most `most` labelled texts outside the held-out third and `most_bytes` of them, those with the smallest hashes
    of doc_id; a doc_id of several rows counts once, by the text of the smallest hash."""
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(remainder() != 1)
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    # sizes first, so that the texts that go to the driver are known to fit before one of them does
    sized = rows.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("m"))
    taken = [(r["doc_id"], r["h"]) for r in sized.select("doc_id", "m.h", F.sum("m.n").over(order).alias("sum")).where(F.col("sum") <= most_bytes).collect()]
    if not taken:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, h long"))
    chosen = rows.withColumn("h", F.xxhash64("text")).join(wanted, ["doc_id", "h"]).select("doc_id", "text", "toxic").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return [(r["text"], r["toxic"]) for r in sorted(chosen.collect(), key=lambda r: r["doc_id"])]


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_most: int = 4000, train_bytes: int = 64_000_000) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below `threshold` (see `score_toxicity`)."""
    small_batches(docs.sparkSession)
    rows = train_rows(docs, labels, train_most, train_bytes)
    model = fit([t for t, _ in rows], [y for _, y in rows])

    @lean
    def run(batches):
        scorer = model.scorer()
        for b in batches:
            yield b.filter(pa.array([scorer.score(t) < threshold for t in texts_of(b)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_most: int = 4000, train_bytes: int = 64_000_000) -> DataFrame:
    """doc_id, held_out, score in [0, 1], predicted (score >= threshold), one row for each row of `docs`.

    The lexicon and the weights come from at most `train_most` labelled rows, of `train_bytes` of text together, whose
    crc32(doc_id) mod 3 is not 1; the lexicon has at most 400 terms and no stem of over 13 letters. The score uses the
    text alone, all of it. Null texts count as empty; empty texts get the score of a text without hits. A null doc_id is
    not held out. Rows whose label is null are not learned from; a doc_id labelled both ways counts as toxic. With no
    labels of both kinds every score is 0.5 or the prior's. Repeated rows get equal scores; other columns are ignored.
    """
    rows = train_rows(docs, labels, train_most, train_bytes)
    model = fit([t for t, _ in rows], [y for _, y in rows])

    @lean
    def run(batches):
        scorer = model.scorer()
        for b in batches:
            s = np.array([scorer.score(t) for t in texts_of(b)], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = documents(docs)
    return d.withColumn("held_out", F.coalesce(remainder() == 1, F.lit(False))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
