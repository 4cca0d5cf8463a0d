"""Kernels of all pairs of two samples: values and gradients of a whole block, without a copy of a path for each pair."""

from __future__ import annotations

from itertools import product as grid
from math import exp, factorial, sqrt

import numpy as np

from . import kernels, tape

#: Cells of pairs at once: 1 MB an array. Fewer cost more calls a pair, more don't stay in a core's cache.
CELLS = 1 << 17
#: Features that stand for a static kernel at most; beyond that it is evaluated on every pair of points.
FEATURES = 200


class Pairwise:
    """Any kernel fn(x, y) of batches of pairs, in tiles."""

    symmetric = True  # fn(x, y) = fn(y, x)

    def __init__(self, fn):
        self.fn = fn

    def _tiles(self, x, y, cells):
        few = max(1, cells // max(1, x.shape[1] * y.shape[1]))
        for t in range(0, len(y), few):
            yield slice(t, t + few), y[t : t + few]

    def product(self, x, y=None):
        """(a, b): fn(x[a], y[b]); without y, of x with itself."""
        y = x if y is None else y
        out = np.empty((len(x), len(y)))
        for at, few in self._tiles(x, y, CELLS):
            for a in range(len(x)):
                out[a, at] = self.fn(np.broadcast_to(x[a], (len(few), *x.shape[1:])), few)
        return out

    def gradient(self, x, y):
        """Of sum_b fn(x[a], y[b]) with respect to each x[a]."""
        out = np.zeros(x.shape)
        for _, few in self._tiles(x, y, CELLS):
            for a in range(len(x)):
                (g,) = tape.vjp(lambda v: self.fn(v, few), [np.repeat(x[a : a + 1], len(few), axis=0)], np.ones(len(few)))
                out[a] += g.sum(axis=0)
        return out


def order_for(bound: float, d: int, most: int = FEATURES) -> int | None:
    """The degree at which the series of exp leaves less than a rounding error of 1 for arguments up to `bound`; None
    if it takes more than `most` monomials in d letters, or if the bound is no finite number."""
    count = 1
    for n in range(64):
        count = count * (n + d) // n if n else 1
        if count > most or not bound < 16:
            return None
        if bound ** (n + 1) / factorial(n + 1) * exp(bound) <= 1e-16:
            return n
    return None


def monomials(u, order: int):
    """(features, ...) of u (..., d): the inner product of two of them is the series of exp(<u, v>) up to `order`."""
    d = u.shape[-1]
    powers = sorted((p for p in grid(range(order + 1), repeat=d) if sum(p) <= order), key=sum)
    place, letters = {p: i for i, p in enumerate(powers)}, [np.ascontiguousarray(u[..., k]) for k in range(d)]
    out = np.ones((len(powers), *u.shape[:-1]))
    for i, p in enumerate(powers[1:], 1):
        k = next(k for k, n in enumerate(p) if n)
        np.multiply(out[place[tuple(n - (j == k) for j, n in enumerate(p))]], letters[k], out=out[i])
        out[i] *= 1 / sqrt(p[k])
    return out


def needed(a, b):
    """The features that count, from each one's largest value on either side: the others add up to less than a rounding
    error of 1."""
    most = a * b
    at = np.argsort(most)
    return np.sort(at[np.cumsum(most[at]) > 1e-17])


def norm(u) -> float:
    return float(np.sqrt((u * u).sum(axis=-1)).max()) if u.size else 0.0


def linear(static) -> bool:
    return isinstance(static, kernels.LinearKernel) and type(static).increments is kernels.LinearKernel.increments


def split(delta, order: int, axis: int = 1):
    """Each increment cut in 2**order equal ones."""
    return np.repeat(delta, 1 << order, axis=axis) * 0.5**order if order else delta


def diagonal(a, lo: int, hi: int, q: int, i: int = 0, j: int = 0):
    """The view of a (n, m, p) at (r + i, q - r + j), lo <= r <= hi."""
    return np.lib.stride_tricks.as_strided(a[lo + i, q - lo + j :], (hi - lo + 1, a.shape[2]), (a.strides[0] - a.strides[1], a.strides[2]))


class Sheet:
    """Buffers for the finite differences of p pairs with n by m cells, and their anti-diagonals."""

    def __init__(self, n: int, m: int, p: int):
        self.half, self.up, self.down = (np.empty((n, m, p)) for _ in range(3))  # half: of each cell's increment
        self.rings, self.steps = np.ones((3, n + 1, p)), []
        s, t = np.empty((n, p)), np.empty((n, p))
        for q in range(n + m - 1):
            lo, hi, k = max(0, q - m + 1), min(n - 1, q), q % 3
            old, last, new = self.rings[k], self.rings[(k + 1) % 3], self.rings[(k + 2) % 3]
            self.steps.append((last[lo : hi + 1], last[lo + 1 : hi + 2], old[lo : hi + 1], new[lo + 1 : hi + 2], diagonal(self.up, lo, hi, q), diagonal(self.down, lo, hi, q), s[: hi - lo + 1], t[: hi - lo + 1]))
        self.end = self.rings[(n + m) % 3][n]

    def solve(self):
        """u at the last corner. Entry r of a diagonal is its point in row r; the entries beside the inner points keep
        the axes' value 1, as a ring is written at an entry only after the axis has passed it."""
        h, up, down = self.half, self.up, self.down
        np.multiply(h, h, out=down)
        down *= 1 / 3
        np.add(h, down, out=up)
        up += 1.0
        down -= 1.0
        self.rings[:] = 1.0
        for north, west, c, new, up, down, s, t in self.steps:
            np.add(north, west, out=s)
            s *= up
            np.multiply(c, down, out=t)
            np.add(s, t, out=new)
        return self.end


class Slope:
    """The finite differences of p pairs and, backwards, twice the gradient of the last corner with respect to each
    cell."""

    def __init__(self, n: int, m: int, p: int):
        self.g, self.third, self.up, self.down, self.du = (np.empty((n, m, p)) for _ in range(5))
        self.rings, self.ups, self.downs = np.ones((3, n + 1, p)), np.zeros((2, n + 1, p)), np.zeros((2, n + 1, p))
        s, t, self.forth, self.home = np.empty((n, p)), np.empty((n, p)), [], []
        for q in range(n + m - 1):
            lo, hi, k = max(0, q - m + 1), min(n - 1, q), q % 3
            old, last, new = self.rings[k], self.rings[(k + 1) % 3], self.rings[(k + 2) % 3]
            third, up, down, du = (diagonal(a, lo, hi, q) for a in (self.third, self.up, self.down, self.du))
            self.forth.append((last[lo : hi + 1], last[lo + 1 : hi + 2], old[lo : hi + 1], new[lo + 1 : hi + 2], third, up, down, du, s[: hi - lo + 1], t[: hi - lo + 1]))
            # what the end gains from a point: by way of the points right of it and below, and of the one across
            at, later, across = q % 2, (q + 1) % 2, q % 2
            self.home.append((self.ups[later, lo : hi + 1], self.ups[later, lo + 1 : hi + 2], self.downs[across, lo + 1 : hi + 2], up, down, du, s[: hi - lo + 1], self.ups[at, lo : hi + 1], self.downs[at, lo : hi + 1]))
        self.home.reverse()

    def solve(self):
        g, third, up, down = self.g, self.third, self.up, self.down
        np.multiply(g, 1 / 3, out=third)
        np.multiply(g, third, out=down)
        down *= 0.25
        np.multiply(g, 0.5, out=up)
        up += down
        up += 1.0
        down -= 1.0
        self.rings[:] = 1.0
        for north, west, c, new, third, up, down, du, s, t in self.forth:
            np.add(north, west, out=s)
            np.add(s, c, out=t)
            t *= third
            np.add(s, t, out=du)
            s *= up
            np.multiply(c, down, out=t)
            np.add(s, t, out=new)
        self.ups[:] = 0.0
        self.downs[:] = 0.0
        _, _, _, up, down, _, _, ups, downs = self.home[0]
        ups[:], downs[:] = up, down
        for right, below, across, up, down, du, s, ups, downs in self.home[1:]:
            np.add(right, below, out=s)
            s += across
            np.multiply(s, up, out=ups)
            np.multiply(s, down, out=downs)
            du *= s
        return self.du


class SigKernel(Pairwise):
    """Finite differences of the signature kernel."""

    def __init__(self, dyadic_order=0, static: kernels.StaticKernel | None = None):
        self.static = static or kernels.LinearKernel()
        self.orders = (dyadic_order, dyadic_order) if isinstance(dyadic_order, int) else tuple(dyadic_order)
        self.symmetric = self.orders[0] == self.orders[1]
        super().__init__(lambda x, y: kernels.sig_kernel(x, y, self.orders, self.static))

    def _lift(self, x, y):
        """A map from paths to (features, paths, segments), increments of features whose inner products are the static kernel's mixed increments, to
        rounding; None if there is none, or it has too many features."""
        if linear(self.static):
            return lambda z: (np.diff(z, axis=1) * self.static.scale).transpose(2, 0, 1)
        if type(self.static) is not kernels.RBFKernel:
            return None
        # exp(-|x - y|^2 / s) = exp(-|x|^2 / s) exp(-|y|^2 / s) exp(2 <x, y> / s), about any centre
        centre, root = (x.mean(axis=(0, 1)) + y.mean(axis=(0, 1))) / 2, sqrt(2 / self.static.sigma)
        order = order_for(norm((x - centre) * root) * norm((y - centre) * root), x.shape[2])
        if order is None:
            return None

        def lift(z):
            z = (z - centre) * root
            return np.diff(monomials(z, order) * np.exp((z * z).sum(axis=2) * -0.5), axis=2)

        top = [np.max([np.abs(lift(z[k : k + 256])).max(axis=(1, 2)) for k in range(0, len(z), 256)], axis=0) for z in (x, y)]
        kept = needed(*top)
        return lambda z: lift(z)[kept]

    def product(self, x, y=None):
        one = y is None
        y = x if one else y
        (a, b), n, m = self.orders, x.shape[1] - 1, y.shape[1] - 1
        if type(self.static).increments not in (kernels.StaticKernel.increments, kernels.LinearKernel.increments):
            return super().product(x, y)
        if not len(x) or not len(y) or n < 1 or m < 1:
            return np.ones((len(x), len(y)))
        lift, out = self._lift(x, y), np.empty((len(x), len(y)))
        cells = (n << a) * (m << b)
        width, strip, sheets = max(1, min(len(y), CELLS // cells)), max(1, (1 << 14) // (n << a)), {}
        for r in range(0, len(x), strip):
            rows = (split(lift(x[r : r + strip]), a, 2) * 0.5).transpose(1, 2, 0) if lift else x[r : r + strip]
            for t in range(r // width * width if one else 0, len(y), width):
                few = y[t : t + width]
                p = len(few)
                if p not in sheets:
                    sheets[p] = Sheet(n << a, m << b, p)
                half = sheets[p].half
                # the pairs of a cell lie side by side
                side = split(lift(few), b, 2) if lift else few.transpose(2, 0, 1)
                side = np.ascontiguousarray(side.transpose(0, 2, 1)).reshape(len(side), -1)
                for i, row in enumerate(rows[: t + p - r] if one else rows):
                    if lift:
                        np.matmul(row, side, out=half.reshape(len(half), -1))
                    else:
                        k = self.static(row[None], side.T[None]).reshape(n + 1, m + 1, p)
                        g = np.diff(np.diff(k, axis=0), axis=1) * 0.5 ** (a + b + 1)
                        half[:] = np.repeat(np.repeat(g, 1 << a, axis=0), 1 << b, axis=1)
                    out[r + i, t : t + p] = sheets[p].solve()
        if one:
            low = np.tri(len(x), k=-1, dtype=bool)
            out[low] = out.T[low]
        return out

    def gradient(self, x, y):
        (a, b), n, m = self.orders, x.shape[1] - 1, y.shape[1] - 1
        if not linear(self.static) or n < 1 or m < 1:
            return super().gradient(x, y)
        scale, width = self.static.scale**2, max(1, min(len(y), 2 * CELLS // (n * m << a + b)))
        dx, slopes = split(np.diff(x, axis=1), a) * scale, {}
        out = np.zeros(dx.shape)
        for t in range(0, len(y), width):
            few = np.ascontiguousarray(split(np.diff(y[t : t + width], axis=1), b).transpose(1, 0, 2))
            p, few = few.shape[1], few.reshape(-1, few.shape[2])
            if p not in slopes:
                slopes[p] = Slope(n << a, m << b, p)
            side, flat = np.ascontiguousarray(few.T), slopes[p].g.reshape(n << a, -1)
            for i in range(len(x)):
                np.matmul(dx[i], side, out=flat)
                out[i] += slopes[p].solve().reshape(n << a, -1) @ few
        out = out.reshape(len(x), n, 1 << a, -1).sum(axis=2) * (scale * 0.5 ** (a + 1))
        whole = np.zeros(x.shape)
        whole[:, 1:] += out
        whole[:, :-1] -= out
        return whole


class BranchedSigKernel(Pairwise):
    """The branched kernel. With linear static kernel and a depth up to 2 it is exp of an inner product of features."""

    def __init__(self, depth: int, dyadic_order=0, static: kernels.StaticKernel | None = None):
        self.static, self.depth = static or kernels.LinearKernel(), depth
        self.orders = (dyadic_order, dyadic_order) if isinstance(dyadic_order, int) else tuple(dyadic_order)
        self.symmetric = self.orders[0] == self.orders[1]
        super().__init__(lambda x, y: kernels.branched_sig_kernel(x, y, depth, self.orders, self.static))

    def _features(self, x, y):
        if not linear(self.static) or not len(x) or not len(y) or not 1 <= self.depth <= 2 or self.depth == 2 and any(self.orders):
            return None
        if self.depth == 1:  # a sum over all cells, in which the points between fall out
            return tuple((z[:, -1] - z[:, 0]) * self.static.scale for z in (x, y))
        u, v = ((z - z[:, :1]) * self.static.scale for z in (x, y))
        order = order_for(norm(u) * norm(v), x.shape[2])
        if order is None:
            return None
        found = tuple(self._second(z, order) for z in (u, v))
        kept = needed(*(np.abs(f).max(axis=0) for f in found))
        return tuple(f[:, kept] for f in found)

    @staticmethod
    def _second(u, order: int):
        """The kernel of depth 1 at two grid points is exp <u_i, v_j>; it is averaged over a cell's corners and taken
        times the product of the increments, over all cells."""
        out = []
        for t in range(0, len(u), 256):
            f = monomials(u[t : t + 256], order)
            mean = (f[..., 1:] + f[..., :-1]) * 0.5
            out.append((mean.transpose(1, 0, 2) @ np.diff(u[t : t + 256], axis=1)).reshape(f.shape[1], -1))
        return np.concatenate(out)

    def product(self, x, y=None):
        found = self._features(x, x if y is None else y)
        if found is None:
            return super().product(x, y)
        out = found[0] @ found[1].T
        return np.exp(out, out=out)

    def gradient(self, x, y):
        if self.depth != 1 or x.shape[1] < 2 or (found := self._features(x, y)) is None:
            return super().gradient(x, y)
        k = found[0] @ found[1].T
        end = np.exp(k, out=k) @ found[1] * self.static.scale
        whole = np.zeros(x.shape)
        whole[:, -1], whole[:, 0] = end, -end
        return whole
