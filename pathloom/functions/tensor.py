"""Truncated tensor algebra on batches: a signature is an array (batch, coordinates) without its scalar term."""

from __future__ import annotations

from functools import lru_cache
from math import factorial

import numpy as np

from . import tape
from .words import log_sig_length, lyndon_words, sig_length, word_to_idx


def transform_path(x, time_aug: bool = False, lead_lag: bool = False, end_time: float = 1.0):
    """Lead-lag (channels lag, then lead; 2L - 1 points), then a time channel at the end. x: (batch, length, d)."""
    if lead_lag:
        n = x.shape[1]
        lag = np.repeat(np.arange(n), 2)[: 2 * n - 1]
        lead = np.repeat(np.arange(n), 2)[1 : 2 * n]
        x = tape.concat([x[:, lag], x[:, lead]])
    if time_aug:
        if x.shape[1] < 2:
            raise ValueError("a time channel needs at least two points")
        t = np.arange(x.shape[1]) * (end_time / (x.shape[1] - 1))
        x = tape.concat([x, np.broadcast_to(t[None, :, None], (x.shape[0], x.shape[1], 1))])
    return x


def levels(s, d: int, degree: int):
    out, at = [], 0
    for k in range(1, degree + 1):
        out.append(s[:, at : at + d**k])
        at += d**k
    return out


def outer(a, b):
    n = a.shape[0]
    return (a.reshape(n, -1, 1) * b.reshape(n, 1, -1)).reshape(n, -1)


def multiply(a, b, scalar_a: float = 1.0, scalar_b: float = 1.0):
    """Levels of the product of scalar_a + a and scalar_b + b, without its scalar."""
    out = []
    for k in range(len(a)):
        total = a[k] * scalar_b + b[k] * scalar_a
        for i in range(k):
            total = total + outer(a[i], b[k - 1 - i])
        out.append(total)
    return out


def exp_levels(x):
    """exp of levels without scalar: 1 + x(1 + x/2(1 + x/3(...)))"""
    n = len(x)
    out = [v / n for v in x]
    for k in range(n - 1, 0, -1):
        out = [v / k for v in multiply(x, out, scalar_a=0.0)]
    return out


def log_levels(x):
    """log of 1 + x: x(1 - x(1/2 - x(1/3 - ...)))"""
    n = len(x)
    out, scalar = [v * 0.0 for v in x], 1.0 / n
    for k in range(n - 1, 0, -1):
        out, scalar = [-v for v in multiply(x, out, scalar_a=0.0, scalar_b=scalar)], 1.0 / k
    return multiply(x, out, scalar_a=0.0, scalar_b=scalar)


def step(s, delta):
    """Levels of s times exp(delta), by Horner's rule."""
    out = []
    for k in range(len(s), 0, -1):
        acc = delta / k
        for j in range(1, k):
            acc = outer(acc + s[j - 1], delta / (k - j))
        out.append(acc + s[k - 1])
    return out[::-1]


def zeros(n: int, d: int, degree: int):
    return np.zeros((n, sig_length(d, degree)))


def sig(x, degree: int, correction=None):
    """Signatures of paths (batch, length, d). correction: (length - 1, c) or (batch, length - 1, c) level 2 and higher
    terms that are added to each segment before its exponential."""
    n, length, d = x.shape
    if degree == 0 or length < 2:
        return zeros(n, d, degree)
    delta = x[:, 1:] - x[:, :-1]
    if correction is None:
        if degree == 1:
            return x[:, -1] - x[:, 0]
        if d == 1:
            total = x[:, -1] - x[:, 0]
            out = [total]
            for k in range(2, degree + 1):
                out.append(out[-1] * total / k)
            return tape.concat(out)
        s = levels(zeros(n, d, degree), d, degree)
        for i in range(length - 1):
            s = step(s, delta[:, i])
        return tape.concat(s)
    c = np.asarray(correction, dtype=float)
    c = np.broadcast_to(c if c.ndim == 3 else c.reshape(1, -1, c.shape[-1]) if c.ndim == 2 else c.reshape(1, 1, -1), (n, length - 1, c.shape[-1]))
    full = np.zeros((n, length - 1, max(0, sig_length(d, degree) - d)))
    full[:, :, : min(c.shape[2], full.shape[2])] = c[:, :, : full.shape[2]]
    s = None
    for i in range(length - 1):
        seg = exp_levels(levels(tape.concat([delta[:, i], full[:, i]]), d, degree))
        s = seg if s is None else multiply(s, seg)
    return tape.concat(s)


def combine(a, b, d: int, degree: int):
    return tape.concat(multiply(levels(a, d, degree), levels(b, d, degree)))


def linear_sig(delta, degree: int):
    out = [delta]
    for k in range(2, degree + 1):
        out.append(outer(out[-1], delta / k))
    return tape.concat(out[:degree]) if degree else delta[:, :0]


def join(s, delta, d: int, degree: int, prepend: bool = False):
    if prepend:
        return combine(linear_sig(delta, degree), s, d, degree)
    return tape.concat(step(levels(s, d, degree), delta))


def inverse(s, d: int, degree: int):
    """The signature of the reversed path: words reversed, sign by length."""
    out = []
    for k, v in enumerate(levels(s, d, degree), 1):
        order = np.arange(d**k).reshape((d,) * k).transpose(range(k)[::-1]).ravel()
        out.append(v[:, order] * (-1.0) ** k)
    return tape.concat(out)


@lru_cache(maxsize=32)
def lyndon_tables(d: int, degree: int):
    """(places of the Lyndon words, coefficients of their brackets at Lyndon words, brackets as rows of all words)."""
    found = lyndon_words(d, degree)
    place = np.array([word_to_idx(w, d) for w in found], dtype=np.int64)
    known = set(found)
    rows = {}

    def bracket(w):
        if w not in rows:
            if len(w) == 1:
                rows[w] = {w: 1.0}
            else:
                cut = next(i for i in range(1, len(w)) if w[i:] in known)  # the longest proper Lyndon suffix
                u, v, out = bracket(w[:cut]), bracket(w[cut:]), {}
                for a, x in u.items():
                    for b, y in v.items():
                        out[a + b] = out.get(a + b, 0.0) + x * y
                        out[b + a] = out.get(b + a, 0.0) - x * y
                rows[w] = out
        return rows[w]

    spread = np.zeros((len(found), sig_length(d, degree)))
    for i, w in enumerate(found):
        for word, x in bracket(w).items():
            spread[i, word_to_idx(word, d)] += x
    return place, spread[:, place], spread


def project(log, d: int, degree: int, method: int):
    """Method 0: all coordinates; 1: those of Lyndon words; 2 and 3: the Lyndon bracket basis."""
    if method == 0:
        return log
    place, square, _ = lyndon_tables(d, degree)
    out = log[:, place]
    return out if method == 1 else out @ np.linalg.inv(square)


def expand(log, d: int, degree: int, method: int):
    """All coordinates of a log-signature given by `method`."""
    if method == 0:
        return log
    _, square, spread = lyndon_tables(d, degree)
    return (log @ np.linalg.inv(square) if method == 1 else log) @ spread


def sig_to_log_sig(s, d: int, degree: int, method: int = 1):
    return project(tape.concat(log_levels(levels(s, d, degree))), d, degree, method)


def log_sig_to_sig(log, d: int, degree: int, method: int = 1):
    return tape.concat(exp_levels(levels(expand(log, d, degree, method), d, degree)))


def log_sig(x, degree: int, method: int = 1, correction=None):
    if method == 3 and correction is not None:
        raise ValueError("method 3 takes no correction")
    return sig_to_log_sig(sig(x, degree, correction), x.shape[2], degree, method)


def log_combine(a, b, d: int, degree: int, method: int = 2):
    """log(exp a exp b): exact in the truncated algebra, so no table of Baker-Campbell-Hausdorff terms is needed."""
    return sig_to_log_sig(combine(log_sig_to_sig(a, d, degree, method), log_sig_to_sig(b, d, degree, method), d, degree), d, degree, method)


def linear_log_sig(delta, degree: int, method: int = 1):
    d = delta.shape[1]
    width = sig_length(d, degree) if method == 0 else log_sig_length(d, degree)
    return tape.concat([delta, np.zeros((delta.shape[0], width - d))])


def log_join(log, delta, d: int, degree: int, method: int = 2):
    return log_combine(log, linear_log_sig(delta, degree, method), d, degree, method)


def coefficients(x, words, prefixes: bool = False):
    """Only the coefficients of these words (and of their prefixes): cascaded running sums, no tensor."""
    if not len(words):
        raise ValueError("no words were given")
    n, length, _ = x.shape
    delta = x[:, 1:] - x[:, :-1]
    out = []
    for w in words:
        state = [np.ones((n, 1))] + [np.zeros((n, 1)) for _ in w]
        for i in range(length - 1):
            for k in range(len(w), 0, -1):
                run, total = 1.0, state[k]
                for j in range(k - 1, -1, -1):
                    run = run * delta[:, i, w[j]].reshape(n, 1)
                    total = total + state[j] * run / factorial(k - j)
                state[k] = total
        out += state[1:] if prefixes else [state[len(w)]]
    return tape.concat(out)
