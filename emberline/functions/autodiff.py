"""Reverse-mode differentiation of numpy expressions, enough for small networks."""

from __future__ import annotations

import numpy as np


class Var:
    """An array with the derivative of a later scalar by it; of what is not ``live`` there is none, nor is it computed."""

    __array_priority__ = 100

    def __init__(self, value, parents=(), live: bool = True):
        value = np.asarray(value)
        self.value, self.grad = value if value.dtype.kind == "f" else value.astype(float), None
        self.parents = tuple(p for p in parents if p[0].live)
        self.live = bool(self.parents) if parents else live

    def _join(self, other, value, mine, others):
        other = other if isinstance(other, Var) else Var(np.asarray(other, self.value.dtype), live=False)
        return Var(value(self.value, other.value), ((self, lambda g: mine(g, self.value, other.value)), (other, lambda g: others(g, self.value, other.value))))

    def __add__(self, o):
        return self._join(o, np.add, lambda g, a, b: g, lambda g, a, b: g)

    def __sub__(self, o):
        return self._join(o, np.subtract, lambda g, a, b: g, lambda g, a, b: -g)

    def __mul__(self, o):
        return self._join(o, np.multiply, lambda g, a, b: g * b, lambda g, a, b: g * a)

    def __truediv__(self, o):
        return self._join(o, np.divide, lambda g, a, b: g / b, lambda g, a, b: -g * a / b**2)

    def __matmul__(self, o):
        return self._join(o, np.matmul, lambda g, a, b: g @ np.swapaxes(b, -1, -2), lambda g, a, b: np.swapaxes(a, -1, -2) @ g)

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self):
        return self * -1.0

    def __rsub__(self, o):
        return -self + o

    def __getitem__(self, key):
        def back(g):
            out = np.zeros_like(self.value)
            np.add.at(out, key, g)
            return out

        return Var(self.value[key], ((self, back),))

    def _map(self, value, slope):
        return Var(value, ((self, lambda g: g * slope),))

    def relu(self):
        return self._map(np.maximum(self.value, 0), self.value > 0)

    def exp(self):
        v = np.exp(self.value)
        return self._map(v, v)

    def log(self):
        return self._map(np.log(self.value), 1 / self.value)

    def tanh(self):
        v = np.tanh(self.value)
        return self._map(v, 1 - v**2)

    def sigmoid(self):
        v = 1 / (1 + np.exp(-np.clip(self.value, -60, 60)))
        return self._map(v, v * (1 - v))

    def root(self):
        v = np.sqrt(self.value)
        return self._map(v, 0.5 / v)

    def sum(self, axis=None, keepdims=False):
        def back(g):
            return np.broadcast_to(g if axis is None or keepdims else np.expand_dims(g, axis), self.value.shape)

        return Var(self.value.sum(axis=axis, keepdims=keepdims), ((self, back),))

    def mean(self, axis=None, keepdims=False):
        n = self.value.size if axis is None else self.value.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)

    def reshape(self, *shape):
        return Var(self.value.reshape(*shape), ((self, lambda g: g.reshape(self.value.shape)),))

    def swap(self, a, b):
        return Var(np.swapaxes(self.value, a, b), ((self, lambda g: np.swapaxes(g, a, b)),))

    def softmax(self):
        e = (self - self.value.max(axis=-1, keepdims=True)).exp()
        return e / e.sum(axis=-1, keepdims=True)

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p, _ in v.parents]
        for v in order:
            v.grad = None
        self.grad = np.ones_like(self.value)
        for v in reversed(order):
            for p, back in v.parents:
                g = _fit(back(v.grad), p.value.shape)
                p.grad = g if p.grad is None else p.grad + g


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Undo broadcasting: sum over the axes that were added or stretched."""
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(axis=i, keepdims=True)
    return g


class Adam:
    """Moves weights by their slopes; those of one step are moved as one vector."""

    def __init__(self, rate: float = 1e-3):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        keys = tuple(grads)
        g = np.concatenate([grads[k].ravel() for k in keys])
        m = self.m[keys] = 0.9 * self.m.get(keys, 0.0) + 0.1 * g
        v = self.v[keys] = 0.999 * self.v.get(keys, 0.0) + 0.001 * g * g
        far, at = self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8), 0
        for k in keys:
            n = grads[k].size
            weights[k] = weights[k] - far[at : at + n].reshape(weights[k].shape)
            at += n
