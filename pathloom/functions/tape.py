"""A small reverse-mode tape over numpy arrays, for the vector-Jacobian products of every feature map."""

from __future__ import annotations

import numpy as np


def _fit(g: np.ndarray, shape) -> np.ndarray:
    """Sums a gradient over what broadcasting repeated."""
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(axis=i, keepdims=True)
    return g


class Var:
    """An array that remembers what it was made from: pairs (parent, gradient -> parent's gradient)."""

    __array_priority__ = 100

    def __init__(self, value, made=()):
        self.value, self.made = np.asarray(value, dtype=float), made

    shape = property(lambda s: s.value.shape)
    ndim = property(lambda s: s.value.ndim)

    def __add__(self, o):
        v, ov = self, o if isinstance(o, Var) else None
        made = [(v, lambda g: _fit(g, v.shape))] + ([(ov, lambda g: _fit(g, ov.shape))] if ov is not None else [])
        return Var(v.value + val(o), made)

    __radd__ = __add__

    def __mul__(self, o):
        v, x = self, val(o)
        made = [(v, lambda g: _fit(g * x, v.shape))] + ([(o, lambda g: _fit(g * v.value, o.shape))] if isinstance(o, Var) else [])
        return Var(v.value * x, made)

    __rmul__ = __mul__

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + (-o)

    def __rsub__(self, o):
        return -self + o

    def __truediv__(self, o):
        return self * (o**-1.0 if isinstance(o, Var) else 1.0 / val(o))

    def __rtruediv__(self, o):
        return (self**-1.0) * o

    def __pow__(self, p: float):
        out = self.value**p
        return Var(out, [(self, lambda g: g * p * self.value ** (p - 1))])

    def __getitem__(self, key):
        def back(g):
            out = np.zeros(self.shape)
            np.add.at(out, key, g)
            return out

        return Var(self.value[key], [(self, back)])

    def __matmul__(self, o):
        a, b = self.value, val(o)
        made = [(self, lambda g: _fit(g @ np.swapaxes(b, -1, -2), a.shape))]
        if isinstance(o, Var):
            made.append((o, lambda g: _fit(np.swapaxes(a, -1, -2) @ g, b.shape)))
        return Var(a @ b, made)

    def __rmatmul__(self, o):
        return Var(o @ self.value, [(self, lambda g: _fit(np.swapaxes(o, -1, -2) @ g, self.shape))])

    def reshape(self, *shape):
        return Var(self.value.reshape(*shape), [(self, lambda g: g.reshape(self.shape))])

    def sum(self, axis, keepdims=False):
        def back(g):
            return np.broadcast_to(g if keepdims else np.expand_dims(g, axis), self.shape)

        return Var(self.value.sum(axis=axis, keepdims=keepdims), [(self, back)])

    def swap(self):
        return Var(np.swapaxes(self.value, -1, -2), [(self, lambda g: np.swapaxes(g, -1, -2))])


def val(x):
    return x.value if isinstance(x, Var) else x


def swap(x):
    return x.swap() if isinstance(x, Var) else np.swapaxes(x, -1, -2)


def exp(x):
    if not isinstance(x, Var):
        return np.exp(x)
    out = np.exp(x.value)
    return Var(out, [(x, lambda g: g * out)])


def root(x):
    """Square root with gradient 0 at 0."""
    if not isinstance(x, Var):
        return np.sqrt(np.maximum(x, 0))
    out = np.sqrt(np.maximum(x.value, 0))
    return Var(out, [(x, lambda g: np.where(out > 0, g / (2 * np.where(out > 0, out, 1)), 0))])


def concat(parts, axis=-1):
    if not any(isinstance(p, Var) for p in parts):
        return np.concatenate(parts, axis=axis)
    parts = [p if isinstance(p, Var) else Var(p) for p in parts]
    ends = np.cumsum([p.shape[axis] for p in parts])

    def piece(i):
        return lambda g: np.take(g, np.arange(ends[i] - parts[i].shape[axis], ends[i]), axis=axis)

    return Var(np.concatenate([p.value for p in parts], axis=axis), [(p, piece(i)) for i, p in enumerate(parts)])


def vjp(fn, inputs, cotangent):
    """Gradients of sum(fn(*inputs) * cotangent) for each input, in float64."""
    leaves = [Var(x) for x in inputs]
    out = fn(*leaves)
    if not isinstance(out, Var):
        return [np.zeros(x.shape) for x in leaves]
    order, seen, stack = [], set(), [(out, False)]
    while stack:
        v, done = stack.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack.append((v, True))
            stack += [(p, False) for p, _ in v.made]
    grads = {id(out): np.broadcast_to(np.asarray(cotangent, dtype=float), out.shape)}
    for v in reversed(order):
        g = grads.get(id(v))
        for p, back in v.made:
            grads[id(p)] = grads.get(id(p), 0) + back(g)
    return [np.broadcast_to(grads.get(id(x), np.zeros(x.shape)), x.shape).copy() for x in leaves]
