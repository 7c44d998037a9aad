"""Reverse-mode derivatives of NumPy expressions.

A ``Value`` holds an array and, if any of its inputs is to be differentiated, how a gradient flows back to them.
Operations broadcast as NumPy's do; what was broadcast is summed on the way back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def _unbroadcast(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    if g.shape == shape:
        return g
    g = g.sum(axis=tuple(range(g.ndim - len(shape))))
    return g.sum(axis=tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1), keepdims=True)


class Value:
    """An array with its history. ``wanted``: whether a gradient is asked for."""

    __slots__ = ("x", "wanted", "back", "grad")
    __array_priority__ = 100

    def __init__(self, x, wanted: bool = False, back: Sequence[tuple[Value, Callable]] = ()):
        self.x = np.asarray(x, np.float64)
        self.back = [(v, f) for v, f in back if v.wanted]
        self.wanted = wanted or bool(self.back)
        self.grad: np.ndarray | None = None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.x.shape

    def __add__(self, o):
        o = value(o)
        return Value(self.x + o.x, back=[(self, lambda g: g), (o, lambda g: g)])

    def __sub__(self, o):
        o = value(o)
        return Value(self.x - o.x, back=[(self, lambda g: g), (o, lambda g: -g)])

    def __mul__(self, o):
        o = value(o)
        return Value(self.x * o.x, back=[(self, lambda g: g * o.x), (o, lambda g: g * self.x)])

    def __truediv__(self, o):
        o = value(o)
        return Value(self.x / o.x, back=[(self, lambda g: g / o.x), (o, lambda g: -g * self.x / o.x**2)])

    def __neg__(self):
        return Value(-self.x, back=[(self, lambda g: -g)])

    def __pow__(self, n: float):
        return Value(self.x**n, back=[(self, lambda g: g * n * self.x ** (n - 1))])

    def __radd__(self, o):
        return self + o

    def __rmul__(self, o):
        return self * o

    def __rsub__(self, o):
        return value(o) - self

    def __rtruediv__(self, o):
        return value(o) / self

    def __matmul__(self, o):
        o = value(o)
        flip = lambda a: np.swapaxes(a, -1, -2)
        return Value(self.x @ o.x, back=[(self, lambda g: g @ flip(o.x)), (o, lambda g: flip(self.x) @ g)])

    def __getitem__(self, key):
        def back(g):
            out = np.zeros_like(self.x)
            if any(isinstance(k, np.ndarray) for k in (key if isinstance(key, tuple) else (key,))):
                np.add.at(out, key, g)
            else:
                out[key] = g
            return out

        return Value(self.x[key], back=[(self, back)])

    def sum(self, axis=None, keepdims: bool = False):
        def back(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return np.broadcast_to(g, self.shape)

        return Value(self.x.sum(axis=axis, keepdims=keepdims), back=[(self, back)])

    def mean(self, axis=None, keepdims: bool = False):
        out = self.sum(axis, keepdims)
        return out * (out.x.size / max(1, self.x.size))

    def reshape(self, *shape: int):
        return Value(self.x.reshape(shape), back=[(self, lambda g: g.reshape(self.shape))])

    def swap(self):
        """The last two axes exchanged."""
        return Value(np.swapaxes(self.x, -1, -2), back=[(self, lambda g: np.swapaxes(g, -1, -2))])

    def backward(self, seed: np.ndarray | float = 1.0) -> None:
        """Gradients of this value, times ``seed``, into ``grad`` of all that were wanted."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack.extend((u, False) for u, _ in v.back)
        self.grad = np.broadcast_to(np.asarray(seed, np.float64), self.shape).copy()
        for v in reversed(order):
            for u, f in v.back:
                g = _unbroadcast(f(v.grad), u.shape)
                u.grad = g.copy() if u.grad is None else u.grad + g


def value(x) -> Value:
    return x if isinstance(x, Value) else Value(x)


def _unary(f: Callable, slope: Callable) -> Callable[[Value], Value]:
    """``slope`` takes the input and the output."""

    def run(v) -> Value:
        v = value(v)
        y = f(v.x)
        return Value(y, back=[(v, lambda g: g * slope(v.x, y))])

    return run


_sigma = lambda x: 0.5 * (1 + np.tanh(0.5 * x))
exp = _unary(np.exp, lambda x, y: y)
log = _unary(np.log, lambda x, y: 1 / x)
sqrt = _unary(np.sqrt, lambda x, y: 0.5 / np.maximum(y, 1e-12))
absolute = _unary(np.abs, lambda x, y: np.sign(x))
tanh = _unary(np.tanh, lambda x, y: 1 - y**2)
sin = _unary(np.sin, lambda x, y: np.cos(x))
cos = _unary(np.cos, lambda x, y: -np.sin(x))
sigmoid = _unary(_sigma, lambda x, y: y * (1 - y))
softplus = _unary(lambda x: np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x))), lambda x, y: _sigma(x))
relu = _unary(lambda x: np.maximum(x, 0), lambda x, y: (x > 0).astype(float))
elu = _unary(lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))), lambda x, y: np.where(x > 0, 1.0, y + 1))
#: distance below the next whole number is dropped: x - floor(x)
fraction = _unary(lambda x: x - np.floor(x), lambda x, y: np.ones_like(x))


def where(mask: np.ndarray, a, b) -> Value:
    a, b = value(a), value(b)
    return Value(np.where(mask, a.x, b.x), back=[(a, lambda g: np.where(mask, g, 0)), (b, lambda g: np.where(mask, 0, g))])


def maximum(a, b) -> Value:
    a, b = value(a), value(b)
    return where(a.x >= b.x, a, b)


def minimum(a, b) -> Value:
    a, b = value(a), value(b)
    return where(a.x <= b.x, a, b)


def concat(values: Sequence[Value]) -> Value:
    """Along the last axis; the other axes are broadcast."""
    values = [value(v) for v in values]
    lead = np.broadcast_shapes(*(v.shape[:-1] for v in values))
    cuts = np.cumsum([0, *(v.shape[-1] for v in values)])
    whole = np.concatenate([np.broadcast_to(v.x, (*lead, v.shape[-1])) for v in values], axis=-1)
    return Value(whole, back=[(v, lambda g, a=a, b=b: g[..., a:b]) for v, a, b in zip(values, cuts, cuts[1:], strict=False)])


def stack(values: Sequence[Value]) -> Value:
    """Along a new axis before the last one."""
    values = [value(v) for v in values]
    shape = np.broadcast_shapes(*(v.shape for v in values))
    return Value(np.stack([np.broadcast_to(v.x, shape) for v in values], axis=-2), back=[(v, lambda g, i=i: g[..., i, :]) for i, v in enumerate(values)])


def norm(v: Value, p: float = 2, power: bool = False) -> Value:
    """The p-norm of the last axis, or the sum of powers that it is the root of."""
    a = absolute(v)
    total = a.sum(-1) if p == 1 else (v * v if p == 2 else a**p).sum(-1)
    if power or p == 1:
        return total
    return sqrt(total) if p == 2 else maximum(total, 1e-300) ** (1 / p)


def log_sum_exp(v: Value, axis: int = -1) -> Value:
    top = np.max(v.x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return log(exp(v - top).sum(axis)) + np.squeeze(top, axis)


def softmax(v: Value, axis: int = -1) -> Value:
    e = exp(v - np.max(v.x, axis=axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)
