"""The state of one growing path (or a batch of paths that grow together), with checkpoints and windows."""

from __future__ import annotations

import numpy as np

from ..functions import branched, tensor


class Algebra:
    """What a stream multiplies: `of` a path, product, inverse, and the form that is handed out."""

    def __init__(self, dimension: int, degree: int, planar: bool | None = None, method: int | None = None):
        self.d, self.n, self.planar, self.method = dimension, degree, planar, method

    def of(self, x):
        return tensor.sig(x, self.n) if self.planar is None else branched.sig(x, self.n, self.planar)

    def times(self, a, b):
        return tensor.combine(a, b, self.d, self.n) if self.planar is None else branched.combine(a, b, self.d, self.n, self.planar)

    def inverse(self, a):
        return tensor.inverse(a, self.d, self.n) if self.planar is None else branched.inverse(a, self.d, self.n, self.planar)

    def out(self, s):
        if self.method is None:
            return s
        return tensor.sig_to_log_sig(s, self.d, self.n, self.method) if self.planar is None else branched.to_log(s, self.d, self.n, self.planar, self.method)


class _Stream:
    planar: bool | None = None

    def __init__(self, dimension: int, degree: int, method: int | None = None):
        if dimension < 1:
            raise ValueError("dimension must be positive")
        self.algebra = Algebra(dimension, degree, self.planar, method)
        self.shape = None

    def _points(self, x, ndim: int) -> np.ndarray:
        """(batch, length, d); the first non-empty call fixes the batch shape."""
        x = np.asarray(x, dtype=float)
        if x.ndim < ndim or x.shape[-1] != self.algebra.d:
            raise ValueError("points must have the stream's dimension")
        if ndim == 1:
            x = x[..., None, :]
        shape = x.shape[:-2]
        if x.shape[-2]:
            if self.shape is None:
                self.shape = shape
            elif shape != self.shape:
                raise ValueError("the batch shape has changed")
        return x.reshape(-1, *x.shape[-2:])

    def _shaped(self, s):
        return s.reshape(*(self.shape or ()), s.shape[-1])


class SigStream(_Stream):
    """Checkpoints after each push. push adds one; push_batch adds one for all of its points (and one for the very
    first point of the stream). sig(a, b) is that of the path between two checkpoints, numbered from the first point
    that was ever pushed; b < a gives the way back. pop_front drops the oldest ones."""

    def __init__(self, dimension: int, degree: int, method: int | None = None):
        super().__init__(dimension, degree, method)
        self.sums, self.inverses, self.last, self.start_index = [], [], None, 0

    def __len__(self):
        return len(self.sums)

    def _add(self, s):
        self.sums.append(s)
        self.inverses.append(self.algebra.inverse(s))

    def push(self, point):
        self.push_batch_(self._points(point, 1))

    def push_batch(self, points):
        x = self._points(points, 2)
        if x.shape[1]:
            self.push_batch_(x)

    def push_batch_(self, x):
        if self.last is None:
            self._add(self.algebra.of(x[:, :1]))
            if x.shape[1] == 1:
                self.last = x[:, -1:]
                return
        else:
            x = np.concatenate([self.last, x], axis=1)
        self._add(self.algebra.times(self.sums[-1], self.algebra.of(x)))
        self.last = x[:, -1:]

    def _between(self, a: int, b: int):
        i, j = a - self.start_index, b - self.start_index
        if not (0 <= i < len(self.sums) and 0 <= j < len(self.sums)):
            raise IndexError("no such checkpoint")
        return self.algebra.times(self.inverses[i], self.sums[j])

    def sig(self, start: int, end: int):
        return self._shaped(self.algebra.out(self._between(start, end)))

    def sig_batch(self, starts, ends):
        return np.stack([self.sig(a, b) for a, b in zip(starts, ends, strict=True)])

    def sig_all(self):
        """From the stream's first point to each checkpoint."""
        return np.stack([self._shaped(self.algebra.out(s)) for s in self.sums])

    def pop_front(self, n: int = 1):
        if not 0 <= n < len(self.sums):
            raise IndexError("not so many checkpoints")
        del self.sums[:n], self.inverses[:n]
        self.start_index += n


class BranchedSigStream(SigStream):
    def __init__(self, dimension: int, degree: int, planar: bool = False, method: int | None = None):
        self.planar = planar
        super().__init__(dimension, degree, method)


class LogSigStream(SigStream):
    def __init__(self, dimension: int, degree: int, method: int = 2):
        if method not in (2, 3):
            raise ValueError("a log-signature stream takes method 2 or 3")
        super().__init__(dimension, degree, method)

    log_sig = SigStream.sig


class BranchedLogSigStream(BranchedSigStream):
    def __init__(self, dimension: int, degree: int, planar: bool = False, method: int | None = None):
        if method == 3:
            raise ValueError("method 3 starts from a path")
        super().__init__(dimension, degree, planar, branched.default_method(planar, method))

    log_sig = SigStream.sig


class SigWindowStream(_Stream):
    """Features of the windows of `window` points that start every `stride` points; whole windows only."""

    def __init__(self, dimension: int, degree: int, window: int, stride: int = 1, method: int | None = None):
        if window < 1 or stride < 1:
            raise ValueError("window and stride must be positive")
        super().__init__(dimension, degree, method)
        self.window, self.stride, self.rows, self.skip, self.found = window, stride, None, 0, []

    def push(self, point):
        self._push(self._points(point, 1))

    def push_batch(self, points):
        self._push(self._points(points, 2))

    def _push(self, x):
        gone = min(self.skip, x.shape[1])
        self.skip -= gone
        x = x[:, gone:]
        self.rows = x if self.rows is None or not self.rows.shape[1] else np.concatenate([self.rows, x], axis=1)
        while self.rows.shape[1] >= self.window:
            self.found.append(self.algebra.out(self.algebra.of(self.rows[:, : self.window])))
            gone = min(self.stride, self.rows.shape[1])
            self.skip += self.stride - gone
            self.rows = self.rows[:, gone:]

    def sig(self):
        if not self.found:
            raise ValueError("no window is complete")
        return np.stack([self._shaped(s) for s in self.found])


class LogSigWindowStream(SigWindowStream):
    def __init__(self, dimension: int, degree: int, window: int, stride: int = 1, method: int = 2):
        super().__init__(dimension, degree, window, stride, method)

    log_sig = SigWindowStream.sig


class BranchedSigWindowStream(SigWindowStream):
    def __init__(self, dimension: int, degree: int, window: int, stride: int = 1, planar: bool = False, method: int | None = None):
        self.planar = planar
        super().__init__(dimension, degree, window, stride, method)


class BranchedLogSigWindowStream(BranchedSigWindowStream):
    def __init__(self, dimension: int, degree: int, window: int, stride: int = 1, planar: bool = False, method: int | None = None):
        super().__init__(dimension, degree, window, stride, planar, branched.default_method(planar, method))

    log_sig = SigWindowStream.sig
