"""Mixed models of one small study by whole matrices, to compare with."""

from __future__ import annotations

import math

import numpy as np


def minimise(f, low: float, high: float, tolerance: float = 1e-9) -> float:
    """The argument of a minimum of ``f`` between two bounds, by golden sections."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while abs(b - a) > tolerance * (1 + abs(a)):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2


class SpectralModel:
    """y = X b + g + e with var(g) = s2g K, on the rotation by K's eigenvectors: one decomposition, then O(n) per likelihood.

    Bounded by the samples of one study (n x n on one machine, as kinship files are).
    """

    def __init__(self, y: np.ndarray, x: np.ndarray, kinship: np.ndarray):
        self.values, self.vectors = np.linalg.eigh(np.asarray(kinship, dtype=np.float64))
        self.values = np.maximum(self.values, 0)
        self.y, self.x, self.n = self.vectors.T @ y, self.vectors.T @ x, len(y)

    def at(self, log_delta: float) -> tuple[float, np.ndarray, float]:
        """(minus log-likelihood, beta, s2g) for delta = s2e / s2g."""
        d = self.values + math.exp(log_delta)
        xw = self.x / d[:, None]
        beta = np.linalg.pinv(self.x.T @ xw) @ (xw.T @ self.y)
        r = self.y - self.x @ beta
        s2g = float((r * r / d).sum() / self.n)
        return 0.5 * (self.n * math.log(2 * math.pi * max(s2g, 1e-300)) + float(np.log(d).sum()) + self.n), beta, s2g

    def fit(self, low: float = -10.0, brackets: int = 100, step: float = 0.2) -> dict:
        """The best of a grid of log delta, refined in each bracket that holds a minimum."""
        grid = [low + step * i for i in range(brackets + 1)]
        value = [self.at(g)[0] for g in grid]
        best, at = min((v, g) for v, g in zip(value, grid))
        for i in range(1, len(grid) - 1):
            if value[i] <= value[i - 1] and value[i] <= value[i + 1]:
                g = minimise(lambda t: self.at(t)[0], grid[i - 1], grid[i + 1])
                if (v := self.at(g)[0]) < best:
                    best, at = v, g
        nll, beta, s2g = self.at(at)
        delta = math.exp(at)
        weight = 1 / (s2g * (self.values + delta))
        return {"log_likelihood": -nll, "beta": beta, "s2g": s2g, "s2e": s2g * delta, "h2": 1 / (1 + delta), "weight": weight, "residual": self.y - self.x @ beta, "rotation": self.vectors}


def variance_components(y: np.ndarray, x: np.ndarray, parts: list[np.ndarray], rounds: int = 400) -> dict:
    """Maximum-likelihood variances of ``parts`` and of the residual, by a simplex search over log variances; sizes of one study."""
    n, k = len(y), len(parts) + 1
    every = [*parts, np.eye(n)]

    def nll(t: np.ndarray) -> float:
        v = sum(math.exp(a) * m for a, m in zip(t, every))
        try:
            c = np.linalg.cholesky(v)
        except np.linalg.LinAlgError:
            return math.inf
        xs, ys = np.linalg.solve(c, x), np.linalg.solve(c, y)
        beta = np.linalg.pinv(xs.T @ xs) @ (xs.T @ ys)
        r = ys - xs @ beta
        return 0.5 * (n * math.log(2 * math.pi) + r @ r) + float(np.log(np.diag(c)).sum())

    start = np.full(k, math.log(max(float(np.var(y)) / k, 1e-12)))
    simplex = [start] + [start + np.eye(k)[i] for i in range(k)]
    value = [nll(s) for s in simplex]
    for _ in range(rounds):
        order = np.argsort(value)
        simplex, value = [simplex[i] for i in order], [value[i] for i in order]
        if abs(value[-1] - value[0]) < 1e-10 * (1 + abs(value[0])):
            break
        middle = np.mean(simplex[:-1], axis=0)
        out = middle + (middle - simplex[-1])
        f_out = nll(out)
        if f_out < value[0]:
            far = middle + 2 * (middle - simplex[-1])
            f_far = nll(far)
            simplex[-1], value[-1] = (far, f_far) if f_far < f_out else (out, f_out)
        elif f_out < value[-2]:
            simplex[-1], value[-1] = out, f_out
        else:
            near = middle + 0.5 * (simplex[-1] - middle)
            f_near = nll(near)
            if f_near < value[-1]:
                simplex[-1], value[-1] = near, f_near
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (s - simplex[0]) for s in simplex[1:]]
                value = [value[0]] + [nll(s) for s in simplex[1:]]
    best = simplex[int(np.argmin(value))]
    return {"variances": np.exp(best), "log_likelihood": -min(value)}
