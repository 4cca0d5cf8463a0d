"""Tree-indexed signatures: Connes-Kreimer trees, or planar (Munthe-Kaas-Wright) forests, on batches.

A functional is an array (batch, elements) without its value at the empty element. The two algebras differ in their
coproduct only; `Hopf` holds it as index tables. Trees without planar order stand for all commutative forests: a
character is multiplicative, an infinitesimal one is 0 on products.
"""

from __future__ import annotations

from functools import lru_cache
from math import factorial

import numpy as np

from . import tape, trees
from .words import is_lyndon


class Hopf:
    def __init__(self, d: int, degree: int, planar: bool):
        self.d, self.degree, self.planar = d, degree, planar
        self.basis = trees.forests(d, degree) if planar else trees.trees(d, degree)
        self.all = list(self.basis) if planar else list(trees.commutative_forests(d, degree))
        place = {f: i + 1 for i, f in enumerate(self.all)}
        place[()] = 0
        self.place = place
        rows = []
        for f in self.all:
            for a, b, k in trees.planar_coproduct(f) if planar else trees.forest_coproduct(f):
                if a and b:
                    rows.append((place[f] - 1, place[a] - 1, place[b] - 1, k))
        self.out, self.left, self.right, times = np.array(rows, dtype=np.int64).reshape(-1, 4).T
        self.times = times.astype(float)
        self.sums = np.zeros((len(rows), len(self.all)))
        self.sums[np.arange(len(rows)), self.out] = self.times
        tree_at = {t: i for i, t in enumerate(self.basis)}
        self.own = np.arange(len(self.all)) if planar else np.array([place[(t,)] - 1 for t in self.basis])
        self.factors = None if planar else [[tree_at[t] for t in f] for f in self.all]
        weight = lambda f: sum(map(trees.nodes, f))
        self.order = np.array([weight(f) for f in self.all])
        self.labels = [self._labels(f) for f in self.all]
        ones = self.exp(self.spread(np.where([w == 1 for w in self.own_order()], 1.0, 0.0)[None], False))
        self.coefficient = ones[0][self.own] if planar else ones[0][self.own]

    def own_order(self):
        return self.order[self.own] if not self.planar else self.order

    def _labels(self, f):
        return [x for t in f for x in (*self._labels(t[:-1]), t[-1])]

    def spread(self, x, character: bool):
        """Values on all forests from those on the basis."""
        if self.planar:
            return x
        cols = []
        for f in self.factors:
            if len(f) == 1:
                cols.append(x[:, f[0]].reshape(x.shape[0], 1))
            elif character:
                v = x[:, f[0]]
                for i in f[1:]:
                    v = v * x[:, i]
                cols.append(v.reshape(x.shape[0], 1))
            else:
                cols.append(np.zeros((x.shape[0], 1)))
        return tape.concat(cols)

    def convolve(self, a, b, scalar_a: float = 1.0, scalar_b: float = 1.0):
        """The product on all forests; `a` takes what is cut off."""
        out = a * scalar_b + b * scalar_a
        return out + (a[:, self.left] * b[:, self.right]) @ self.sums if len(self.left) else out

    def exp(self, x):
        out, term = x, x
        for k in range(2, self.degree + 1):
            term = self.convolve(term, x, 0.0, 0.0) / k
            out = out + term
        return out

    def log(self, x):
        out, term = x, x
        for k in range(2, self.degree + 1):
            term = self.convolve(term, x, 0.0, 0.0)
            out = out + term * ((-1.0) ** (k + 1) / k)
        return out


@lru_cache(maxsize=32)
def hopf(d: int, degree: int, planar: bool) -> Hopf:
    return Hopf(d, degree, planar)


def combine(x, y, d: int, degree: int, planar: bool = False):
    h = hopf(d, degree, planar)
    return h.convolve(h.spread(x, True), h.spread(y, True))[:, h.own]


def linear(delta, degree: int, planar: bool = False):
    """Of a straight segment: the product of the labels' increments over the (ordered) factorial."""
    h = hopf(delta.shape[1], degree, planar)
    cols = []
    for i, c in zip(h.own, h.coefficient):
        v = delta[:, h.labels[i][0]] * c
        for label in h.labels[i][1:]:
            v = v * delta[:, label]
        cols.append(v.reshape(delta.shape[0], 1))
    return tape.concat(cols)


def chain(word) -> tuple:
    """The tree of an iterated integral: the first letter at the leaf, the last at the root."""
    t = (word[0],)
    for letter in word[1:]:
        t = (t, letter)
    return t


def sig(x, degree: int, planar: bool = False, correction=None):
    n, length, d = x.shape
    h = hopf(d, degree, planar)
    if length < 2 or degree == 0:
        return np.zeros((n, len(h.basis)))
    delta = x[:, 1:] - x[:, :-1]
    extra = None
    if correction is not None:
        from .words import words

        c = np.asarray(correction, dtype=float)
        c = np.broadcast_to(c if c.ndim == 3 else c.reshape(1, -1, c.shape[-1]) if c.ndim == 2 else c.reshape(1, 1, -1), (n, length - 1, c.shape[-1]))
        names = [w for w in words(d, degree) if len(w) > 1]
        at = {e: i for i, e in enumerate(h.basis)}
        extra = np.zeros((n, length - 1, len(h.basis)))
        for k, w in enumerate(names[: c.shape[2]]):
            extra[:, :, at[(chain(w),)] if planar else at[chain(w)]] += c[:, :, k]
    out = None
    for i in range(length - 1):
        if extra is None:
            seg = linear(delta[:, i], degree, planar)
        else:
            first = tape.concat([delta[:, i], np.zeros((n, len(h.basis) - d))])
            seg = h.exp(h.spread(first + extra[:, i], False))[:, h.own]
        out = seg if out is None else combine(out, seg, d, degree, planar)
    return out


def join(s, delta, d: int, degree: int, planar: bool = False, prepend: bool = False):
    seg = linear(delta, degree, planar)
    return combine(seg, s, d, degree, planar) if prepend else combine(s, seg, d, degree, planar)


@lru_cache(maxsize=16)
def lyndon_tables(d: int, degree: int):
    """Planar forests as words in planar trees: places of the Lyndon ones, and their brackets as in the tensor case."""
    h = hopf(d, degree, True)
    letters = {t: i for i, t in enumerate(trees._trees(d, degree, True))}
    found = trees.lyndon_forests(d, degree)
    at = {f: i for i, f in enumerate(h.basis)}
    rows: dict = {}
    code = lambda f: tuple(letters[t] for t in f)

    def bracket(f):
        if f not in rows:
            if len(f) == 1:
                rows[f] = {f: 1.0}
            else:
                cut = next(i for i in range(1, len(f)) if is_lyndon(code(f[i:])))
                out: dict = {}
                for a, x in bracket(f[:cut]).items():
                    for b, y in bracket(f[cut:]).items():
                        out[a + b] = out.get(a + b, 0.0) + x * y
                        out[b + a] = out.get(b + a, 0.0) - x * y
                rows[f] = out
        return rows[f]

    spread = np.zeros((len(found), len(h.basis)))
    for i, f in enumerate(found):
        for g, x in bracket(f).items():
            spread[i, at[g]] += x
    place = np.array([at[f] for f in found], dtype=np.int64)
    return place, spread[:, place], spread


def default_method(planar: bool, method: int | None) -> int:
    method = (1 if planar else 0) if method is None else method
    if method and not planar:
        raise ValueError("methods 1 to 3 need planar forests")
    return method


def to_log(s, d: int, degree: int, planar: bool = False, method: int | None = None):
    method, h = default_method(planar, method), hopf(d, degree, planar)
    log = h.log(h.spread(s, True))[:, h.own]
    if method == 0:
        return log
    place, square, _ = lyndon_tables(d, degree)
    return log[:, place] if method == 1 else log[:, place] @ np.linalg.inv(square)


def from_log(log, d: int, degree: int, planar: bool = False, method: int | None = None):
    method, h = default_method(planar, method), hopf(d, degree, planar)
    if method:
        _, square, spread = lyndon_tables(d, degree)
        log = (log @ np.linalg.inv(square) if method == 1 else log) @ spread
    return h.exp(h.spread(log, False))[:, h.own]


def log_sig(x, degree: int, planar: bool = False, method: int | None = None, correction=None):
    return to_log(sig(x, degree, planar, correction), x.shape[2], degree, planar, method)


def linear_log(delta, degree: int, planar: bool = False, method: int | None = None):
    return to_log(linear(delta, degree, planar), delta.shape[1], degree, planar, method)


def log_join(log, delta, d: int, degree: int, method: int = 2, prepend: bool = False):
    """Planar only: log(exp(log) exp(delta))."""
    return to_log(join(from_log(log, d, degree, True, method), delta, d, degree, True, prepend), d, degree, True, method)


def inverse(s, d: int, degree: int, planar: bool = False):
    return from_log(-to_log(s, d, degree, planar, 0), d, degree, planar, 0)


def coefficients(x, elements, planar: bool = False, correction=None):
    """Only these trees or forests; the basis is enumerated up to the largest of them."""
    if not len(elements):
        raise ValueError("no elements were given")
    size = lambda e: sum(map(trees.nodes, e)) if planar else trees.nodes(e)
    elements = [trees.as_forest(e) if planar else e for e in elements]
    degree = max([size(e) if e else 0 for e in elements] + [1])
    h = hopf(x.shape[2], degree, planar)
    s = sig(x, degree, planar, correction)
    at = {e: i for i, e in enumerate(h.basis)}
    one = np.ones((x.shape[0], 1))
    return tape.concat([one if not e else s[:, at[e]].reshape(x.shape[0], 1) for e in elements])


__all__ = ["Hopf", "hopf", "factorial"]
