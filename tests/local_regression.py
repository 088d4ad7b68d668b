"""Regressions on one table in memory: what the sums of clusters are held against."""

from __future__ import annotations

import math

import numpy as np


def _sandwich(bread: np.ndarray, scores: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    _, at = np.unique(cluster.astype(str), return_inverse=True)
    sums = np.zeros((at.max() + 1, scores.shape[1]))
    np.add.at(sums, at, scores)
    return bread @ (sums.T @ sums) @ bread


def ols_clustered(x: np.ndarray, y: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and their covariance, with the usual small-sample factor for clusters."""
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ x.T @ y
    g, (n, p) = len(np.unique(cluster.astype(str))), x.shape
    factor = g / max(g - 1, 1) * (n - 1) / max(n - p, 1)
    return beta, factor * _sandwich(bread, x * (y - x @ beta)[:, None], cluster)


def mixed(x: np.ndarray, y: np.ndarray, cluster: np.ndarray, rounds: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, float, float]:
    """A random intercept for each cluster by maximum likelihood: coefficients, covariance, variance between and within.

    The likelihood is maximised over the ratio of the two variances; given it, the rest has closed forms.
    """
    _, at = np.unique(cluster.astype(str), return_inverse=True)
    size = np.bincount(at).astype(float)

    def sums(v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(size), v.shape[1]))
        np.add.at(out, at, v)
        return out

    both = np.column_stack((x, y))
    cross, by_cluster, p, n = both.T @ both, sums(both), x.shape[1], len(y)

    def at_ratio(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        m = cross - (by_cluster * (ratio / (1 + ratio * size))[:, None]).T @ by_cluster
        bread = np.linalg.pinv(m[:p, :p])
        beta = bread @ m[:p, p]
        within = max((m[p, p] - beta @ m[:p, p]) / n, 1e-300)
        return -0.5 * (n * math.log(2 * math.pi * within) + np.log1p(ratio * size).sum() + n), beta, bread, within

    low, high, golden = -20.0, 15.0, (math.sqrt(5) - 1) / 2
    grid = np.linspace(low, high, 71)
    best = grid[int(np.argmax([at_ratio(math.exp(g))[0] for g in grid]))]
    low, high = best - 0.5, best + 0.5
    for _ in range(rounds):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if at_ratio(math.exp(a))[0] > at_ratio(math.exp(b))[0] else (a, high)
        if high - low < tol:
            break
    ratio = math.exp((low + high) / 2)
    if at_ratio(0.0)[0] >= at_ratio(ratio)[0]:
        ratio = 0.0
    _, beta, bread, within = at_ratio(ratio)
    return beta, bread * within, ratio * within, within


def gee(x: np.ndarray, y: np.ndarray, cluster: np.ndarray, family: str = "binomial", exchangeable: bool = True, rounds: int = 100, tol: float = 1e-10, trials: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Generalised estimating equations: coefficients, robust covariance, and the correlation within clusters (0 without ``exchangeable``).

    With ``trials``, y is a number of successes. An exchangeable inverse is applied by sums over clusters.
    """
    _, at = np.unique(cluster.astype(str), return_inverse=True)
    size, (n, p) = np.bincount(at).astype(float), x.shape
    m = np.ones(n) if trials is None else trials.astype(float)
    beta, alpha = np.zeros(p), 0.0

    def sums(v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(size), v.shape[1]))
        np.add.at(out, at, v)
        return out

    for _ in range(rounds):
        eta = np.clip(x @ beta, -30, 30)
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else x @ beta
        v = np.maximum(m * mu * (1 - mu), 1e-12) if family == "binomial" else np.ones(n)
        d = x * (v if family == "binomial" else np.ones(n))[:, None]  # of the mean with respect to the coefficients
        resid = (y - m * mu) / np.sqrt(v)
        phi = (resid**2).sum() / max(n - p, 1)
        if exchangeable:
            pairs = (size * (size - 1) / 2).sum() - p
            total = ((sums(resid[:, None])[:, 0] ** 2).sum() - (resid**2).sum()) / 2
            alpha = float(np.clip(total / max(pairs, 1) / max(phi, 1e-300), -0.99 / max(size.max() - 1, 1), 0.99))
        z, r = d / np.sqrt(v)[:, None], resid[:, None]
        shrink = (alpha / (1 - alpha + alpha * size))[:, None]
        left = lambda u: (u - (shrink * sums(u))[at]) / (1 - alpha)  # noqa: E731  # the inverse correlation times u
        hessian, score = z.T @ left(z), z.T @ left(r)
        step = np.linalg.pinv(hessian) @ score[:, 0]
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    bread = np.linalg.pinv(hessian)
    return beta, _sandwich(bread, left(z) * r, at), alpha
