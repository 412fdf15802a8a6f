"""Gaussian mixtures with diagonal, regularised covariance: the numpy side."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Array = np.ndarray
FLOOR = 0.02  # least variance of a standardised feature within a component
ROUNDS, TRIAL_ROUNDS = 8, 3  # in all, and before numbers of components are compared


@dataclass
class Reduction:
    """Standardised principal components of one collection."""

    mean: Array
    axes: Array  # (dim, features), scaled to unit variance

    def apply(self, x: Array) -> Array:
        return ((x - self.mean) @ self.axes).astype(np.float32)

    def spread(self, raw: float) -> float:
        """What a squared distance in the vectors' space is in the features', on average over directions."""
        return raw * float((self.axes**2).sum()) / len(self.axes)


def reduction(n: float, first: Array, second: Array, variance: float, most: int) -> Reduction:
    """From a count, the sum of rows and the sum of their outer products: the components that hold `variance` of the whole."""
    mean = first / max(n, 1)
    cov = second / max(n, 1) - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    total = values.sum()
    if total <= 0:
        return Reduction(mean.astype(np.float32), np.zeros((len(mean), 1), np.float32))
    r = int(min(most, max(1, np.searchsorted(np.cumsum(values) / total, variance) + 1)))
    return Reduction(mean.astype(np.float32), (axes[:, :r] / np.sqrt(np.maximum(values[:r], 1e-9 * total))).astype(np.float32))


@dataclass
class Mixture:
    weight: Array
    mean: Array
    var: Array

    def log_joint(self, z: Array) -> Array:
        """log(weight * density) of each row under each component."""
        inv = 1 / self.var
        const = np.log(np.maximum(self.weight, 1e-12)) - 0.5 * (np.log(self.var).sum(1) + z.shape[1] * np.log(2 * np.pi) + (self.mean**2 * inv).sum(1))
        return -0.5 * ((z * z) @ inv.T.astype(np.float32)) + z @ (self.mean * inv).T.astype(np.float32) + const.astype(np.float32)

    @property
    def parameters(self) -> int:
        return len(self.weight) * (1 + 2 * self.mean.shape[1]) - 1


def posteriors(joint: Array) -> tuple[Array, Array]:
    """(responsibilities, log density) of each row."""
    top = joint.max(axis=1, keepdims=True)
    r = np.exp(joint - top)
    total = r.sum(axis=1, keepdims=True)
    return r / total, (top + np.log(total))[:, 0]


def statistics(m: Mixture, z: Array, w: Array) -> Array:
    """What one round needs of some rows, flat: sums of responsibilities, of rows, of squares, and the log likelihood. Adds up."""
    r, ll = posteriors(m.log_joint(z))
    r *= w[:, None]
    return np.concatenate([r.sum(0), (r.T @ z).ravel(), (r.T @ (z * z)).ravel(), [float((ll * w).sum())]]).astype(np.float64)


def maximised(stats: Array, k: int, floor: float = FLOOR) -> tuple[Mixture, float]:
    """The next mixture and the log likelihood of the last one."""
    d = (len(stats) - 1 - k) // (2 * k)
    n = np.maximum(stats[:k], 1e-9)
    mean = stats[k : k + k * d].reshape(k, d) / n[:, None]
    var = np.maximum(stats[k + k * d : -1].reshape(k, d) / n[:, None] - mean**2, 0) + floor
    return Mixture(stats[:k] / max(stats[:k].sum(), 1e-9), mean, var), float(stats[-1])


def bic(ll: float, m: Mixture, n: float) -> float:
    return m.parameters * np.log(max(n, 2)) - 2 * ll


def density_peaks(z: Array, w: Array, reach: float, least: float) -> Array:
    """Rows to start components from, densest first: no two nearer than reach, each with `least` weight within it."""
    sq = (z * z).sum(1)
    near = np.empty((len(z), len(z)), dtype=bool)
    for i in range(0, len(z), 1024):
        near[i : i + 1024] = (sq[i : i + 1024, None] + sq[None, :] - 2 * (z[i : i + 1024] @ z.T)) <= reach
    weight = near @ w
    free, peaks = weight >= least, []
    for i in np.argsort(-weight, kind="stable"):
        if not free[i]:
            continue
        peaks.append(i)
        free &= ~near[i]
    return np.array(peaks, dtype=np.int64)


def spherical(m: Mixture, but_last: int = 1) -> Mixture:
    """One variance for all features of a component, but for the last ones: the regularisation for components of few rows."""
    var = m.var.copy()
    var[:-but_last] = var[:-but_last].mean(axis=1, keepdims=True)
    return Mixture(m.weight, m.mean, var)


def fit_local(z: Array, w: Array, reach: float, least: float, rounds: int = ROUNDS) -> tuple[Mixture, Array, Array, Array]:
    """(mixture, component of each row, log density of each row in it, density peaks); the last component is the broad background.

    Components start at density peaks and are spherical; how many of them stay is decided by the Bayesian information
    criterion; all peaks are given, also those without a component.
    """
    d, total = z.shape[1], w.sum()
    mu = (w @ z) / total
    broad_var = (w @ (z - mu) ** 2) / total + FLOOR
    peaks = density_peaks(z, w, reach, least)
    tried: dict[int, tuple[float, Mixture]] = {}

    def improved(m: Mixture, k: int, rounds: int) -> tuple[float, Mixture]:
        """(criterion before the last round, mixture)"""
        ll = 0.0
        for _ in range(rounds):
            m, ll = maximised(statistics(m, z, w), k + 1)
            m = spherical(m)
        return (k * (d + 2) + 2 * d) * np.log(max(total, 2)) - 2 * ll, m

    def score(k: int) -> None:
        if k not in tried:
            tried[k] = improved(Mixture(np.full(k + 1, 1 / (k + 1)), np.concatenate([z[peaks[:k]], mu[None]]), np.concatenate([np.full((k, d), reach / (2 * d) + FLOOR), broad_var[None]])), k, TRIAL_ROUNDS)

    for k in {0, len(peaks) // 2, len(peaks)}:
        score(k)
    step = len(peaks) // 4
    while step >= max(1, len(peaks) // 16):  # the best so far and what lies a step around it; the step halves
        at_best = min(tried, key=lambda k: tried[k][0])
        for k in (at_best - step, at_best + step):
            if 0 <= k <= len(peaks):
                score(k)
        step //= 2
    k = min(tried, key=lambda k: (tried[k][0], k))
    best = improved(tried[k][1], k, rounds - TRIAL_ROUNDS)
    joint = best[1].log_joint(z)
    at = joint.argmax(1)
    return best[1], at, joint[np.arange(len(z)), at], peaks
