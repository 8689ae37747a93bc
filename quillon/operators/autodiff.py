"""Reverse-mode gradients over NumPy arrays: as much as the graph models need."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sum_rows(x: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    out = np.zeros((n, *x.shape[1:]), x.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        i = index[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        out[i[starts]] = np.add.reduceat(x[order], starts, axis=0)
    return out


class Var:
    """An array in a computation; grad() fills the gradients of all it came from."""

    def __init__(self, value, parents: tuple = (), back: Callable | None = None):
        self.value, self.parents, self.back, self.gradient = np.asarray(value, np.float64), parents, back, None

    def __add__(self, other):
        other = other if isinstance(other, Var) else Var(other)
        return Var(self.value + other.value, (self, other), lambda g: (_like(g, self.value), _like(g, other.value)))

    def __mul__(self, other):
        other = other if isinstance(other, Var) else Var(other)
        return Var(self.value * other.value, (self, other), lambda g: (_like(g * other.value, self.value), _like(g * self.value, other.value)))

    def __matmul__(self, other: "Var"):
        return Var(self.value @ other.value, (self, other), lambda g: (g @ other.value.T, self.value.T @ g))

    def through(self, f: np.ndarray, slope: np.ndarray) -> "Var":
        """An elementwise function, given by its values and slopes."""
        return Var(f, (self,), lambda g: (g * slope,))

    def relu(self):
        return self.through(np.maximum(self.value, 0), self.value > 0)

    def elu(self):
        e = np.exp(np.minimum(self.value, 0))
        return self.through(np.where(self.value > 0, self.value, e - 1), np.where(self.value > 0, 1.0, e))

    def leaky(self, slope: float = 0.2):
        return self.through(np.where(self.value > 0, self.value, slope * self.value), np.where(self.value > 0, 1.0, slope))

    def exp(self):
        e = np.exp(self.value)
        return self.through(e, e)

    def inverse(self):
        return self.through(1 / self.value, -1 / self.value**2)

    def take(self, index: np.ndarray):
        return Var(self.value[index], (self,), lambda g: (sum_rows(g, index, len(self.value)),))

    def scatter(self, index: np.ndarray, n: int):
        return Var(sum_rows(self.value, index, n), (self,), lambda g: (g[index],))

    def largest(self, index: np.ndarray, n: int):
        """The greatest row value per index and column."""
        out = np.full((n, self.value.shape[1]), -np.inf)
        np.maximum.at(out, index, self.value)
        first = self.value == out[index]
        share = first / sum_rows(first.astype(float), index, n)[index]
        return Var(np.where(np.isfinite(out), out, 0), (self,), lambda g: (g[index] * share,))

    def reshape(self, *shape):
        return Var(self.value.reshape(shape), (self,), lambda g: (g.reshape(self.value.shape),))

    def total(self, axis: int):
        return Var(self.value.sum(axis), (self,), lambda g: (np.broadcast_to(np.expand_dims(g, axis), self.value.shape),))

    def grad(self) -> None:
        order, seen = [], set()

        def visit(v):
            if id(v) not in seen:
                seen.add(id(v))
                for p in v.parents:
                    visit(p)
                order.append(v)

        visit(self)
        for v in order:
            v.gradient = np.zeros_like(v.value)
        self.gradient = np.ones_like(self.value)
        for v in reversed(order):
            if v.back:
                for p, g in zip(v.parents, v.back(v.gradient)):
                    p.gradient = p.gradient + g


def _like(g: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A gradient summed over the axes that were stretched."""
    while g.ndim > x.ndim:
        g = g.sum(0)
    for k, n in enumerate(x.shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(k, keepdims=True)
    return g


def join(parts: list[Var]) -> Var:
    cuts = np.cumsum([p.value.shape[1] for p in parts])[:-1]
    return Var(np.concatenate([p.value for p in parts], axis=1), tuple(parts), lambda g: tuple(np.split(g, cuts, axis=1)))
