"""One set of maps clustered in memory: what the distributed fits are held against."""

from __future__ import annotations

import math

import numpy as np

from stateflux.functions.special import digamma
from stateflux.operators.clustering import EPS, normal, principal


def seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k maps, each drawn by its squared distance 1 - r^2 from those before."""
    out = [x[rng.integers(len(x))]]
    d2 = np.ones(len(x))
    while len(out) < k:
        d2 = np.clip(np.minimum(d2, 1 - (x @ out[-1]) ** 2), 0, None)
        p = d2 / d2.sum() if d2.sum() > EPS else None
        out.append(x[rng.choice(len(x), p=p)])
    return normal(np.array(out))


def fit_measures(x: np.ndarray, labels: np.ndarray, centres: np.ndarray, weight: np.ndarray | None = None) -> dict[str, float]:
    """Explained variance, residual, cross-validation, silhouette by centres, similarity and state shares of normalised maps."""
    sim = np.abs(x @ centres.T)
    best, k = sim.max(axis=1), len(centres)
    w = np.ones(len(x)) if weight is None or weight.sum() <= EPS else weight
    wss = float((w * (1 - best**2)).sum())
    residual = wss / w.sum()
    share = np.bincount(labels, minlength=k) / len(labels)
    silhouette = math.nan
    if k > 1 and len(x) > k:
        own = 1 - sim[np.arange(len(x)), labels]
        rest = sim.copy()
        rest[np.arange(len(x)), labels] = -np.inf
        other = 1 - rest.max(axis=1)
        top = np.maximum(own, other)
        silhouette = float(np.mean((other - own)[top > 0] / top[top > 0])) if (top > 0).any() else 0.0
    n = x.shape[1]
    return {
        "gev": float((w * best**2).sum() / w.sum()), "wss": wss, "residual_variance": residual, "cross_validation": residual * ((n - 1) / max(1, n - k - 1)) ** 2, "silhouette": silhouette,
        "mean_abs_corr": float(best.mean()), "min_share": float(share.min()), "max_share": float(share.max()), "empty_states": int((share == 0).sum()), "calinski_harabasz": calinski_harabasz(x, labels),
    }


def calinski_harabasz(x: np.ndarray, labels: np.ndarray) -> float:
    k, n = len(np.unique(labels)), len(x)
    if k < 2 or n <= k:
        return math.nan
    within = between = 0.0
    for own in np.unique(labels):
        part = x[labels == own]
        within += ((part - part.mean(axis=0)) ** 2).sum()
        between += len(part) * ((part.mean(axis=0) - x.mean(axis=0)) ** 2).sum()
    return math.inf if within <= EPS else float(between / (k - 1) / (within / (n - k)))


def updated(x: np.ndarray, labels: np.ndarray, centres: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The principal axis of each state's maps; an empty state gets some map."""
    out = centres.copy()
    for k in range(len(centres)):
        own = x[labels == k]
        out[k] = principal(own.T @ own, own.mean(axis=0)) if len(own) else x[rng.integers(len(x))]
    return normal(out)


def topographic_kmeans(x: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 300, tol: float = 1e-6, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of normalised maps: assignment by |r|, centres by principal axes, until the weighted residual settles."""
    rng = np.random.default_rng(seed)
    centres, before = seeds(x, k, rng) if start is None else normal(np.array(start, float)), math.inf
    for _ in range(rounds):
        labels = np.abs(x @ centres.T).argmax(axis=1)
        centres = updated(x, labels, centres, rng)
        now = float((weight * (1 - np.abs(x @ centres.T).max(axis=1) ** 2)).sum())
        if abs(before - now) <= tol * max(1.0, before if math.isfinite(before) else 1.0):
            break
        before = now
    return centres, np.abs(x @ centres.T).argmax(axis=1)


def modified_kmeans(x: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 300, tol: float = 1e-6, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The modified k-means of Pascual-Marqui and others (1995): random maps first, residual noise variance as the end; maps keep their strength in the axes."""
    rng = np.random.default_rng(seed)
    scaled = x * np.sqrt(weight)[:, None]
    centres = normal(x[rng.choice(len(x), k, replace=False)]) if start is None else normal(np.array(start, float))
    before, total = math.inf, (scaled**2).sum()
    for _ in range(rounds):
        labels = np.abs(x @ centres.T).argmax(axis=1)
        for j in range(k):
            own = scaled[labels == j]
            centres[j] = principal(own.T @ own) if len(own) else x[rng.integers(len(x))]
        noise = float(total - ((scaled * centres[labels]).sum(axis=1) ** 2).sum()) / (len(x) * (x.shape[1] - 1))
        if abs(before - noise) <= tol * noise:
            break
        before = noise
    return centres, np.abs(x @ centres.T).argmax(axis=1)


def projective(x: np.ndarray, least_variance: float = 1e-12) -> np.ndarray:
    """Upper triangles of outer products, off-diagonal cells times sqrt 2, constant dimensions left out: a map and its negative are one point."""
    i, j = np.triu_indices(x.shape[1])
    out = x[:, i] * x[:, j] * np.where(i == j, 1.0, math.sqrt(2))
    return out[:, out.var(axis=0) > least_variance]


def components(x: np.ndarray, share: float = 0.999, most: int = 8) -> np.ndarray:
    """Standardised scores of the principal components that explain ``share`` of the variance, ``most`` at most."""
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    power = s**2
    if power.sum() <= EPS:
        return np.zeros((len(x), 1))
    d = min(most, int(np.searchsorted(np.cumsum(power) / power.sum(), share - 1e-12)) + 1)
    scores = u[:, :d] * s[:d]
    sd = scores.std(axis=0, ddof=1) if len(x) > 1 else np.ones(d)
    return scores / np.where(sd > EPS, sd, 1.0)


def rank(x: np.ndarray) -> int:
    """The numerical rank: singular values above the usual tolerance."""
    s = np.linalg.svd(x, compute_uv=False)
    return int((s > max(x.shape) * np.finfo(float).eps * s.max(initial=0.0)).sum())


def variational_mixture(f: np.ndarray, k: int, labels: np.ndarray, rounds: int = 200, tol: float = 1e-6) -> dict:
    """A variational Gaussian mixture with full covariances (Bishop, 2006, chapter 10.2) from first labels: responsibilities, means, covariances, priors and the free energy (the lower bound of the evidence)."""
    n, d = f.shape
    alpha0, beta0, nu0 = 1.0 / k, 1e-2, d + 1.0
    m0, w0 = f.mean(axis=0), np.atleast_2d(np.cov(f.T)) + 1e-6 * np.eye(d)  # the scale's inverse
    r = np.full((n, k), 0.1 / k)
    r[np.arange(n), labels] += 0.9
    r /= r.sum(axis=1, keepdims=True)
    lgamma = np.vectorize(math.lgamma)

    def log_b(inverse: np.ndarray, nu: float) -> float:
        return nu / 2 * np.linalg.slogdet(inverse)[1] - (nu * d / 2 * math.log(2) + d * (d - 1) / 4 * math.log(math.pi) + lgamma((nu + 1 - np.arange(1, d + 1)) / 2).sum())

    before, out = -math.inf, {}
    for _ in range(rounds):
        size = r.sum(axis=0) + 1e-10
        mean = (r.T @ f) / size[:, None]
        alpha, beta, nu = alpha0 + size, beta0 + size, nu0 + size
        m = (beta0 * m0 + size[:, None] * mean) / beta[:, None]
        inverse, log_det, quad = np.empty((k, d, d)), np.empty(k), np.empty((n, k))
        for j in range(k):
            c = f - mean[j]
            inverse[j] = w0 + (r[:, j, None] * c).T @ c + beta0 * size[j] / (beta0 + size[j]) * np.outer(mean[j] - m0, mean[j] - m0)
            log_det[j] = digamma((nu[j] + 1 - np.arange(1, d + 1)) / 2).sum() + d * math.log(2) - np.linalg.slogdet(inverse[j])[1]
            c = f - m[j]
            quad[:, j] = d / beta[j] + nu[j] * (c * np.linalg.solve(inverse[j], c.T).T).sum(axis=1)
        log_pi = digamma(alpha) - digamma(np.array([alpha.sum()]))
        log_rho = log_pi + 0.5 * log_det - 0.5 * d * math.log(2 * math.pi) - 0.5 * quad
        top = log_rho.max(axis=1, keepdims=True)
        log_norm = top[:, 0] + np.log(np.exp(log_rho - top).sum(axis=1))
        r = np.exp(log_rho - log_norm[:, None])
        # with the responsibilities just made, the terms of data and labels are the normalisers; the rest are divergences from the priors
        bound = log_norm.sum()
        bound -= lgamma(alpha.sum()) - lgamma(alpha).sum() - (math.lgamma(k * alpha0) - k * math.lgamma(alpha0)) + ((alpha - alpha0) * log_pi).sum()
        for j in range(k):
            precision = nu[j] * np.linalg.inv(inverse[j])
            gap = m[j] - m0
            bound -= 0.5 * (d * (beta0 / beta[j] - 1 + math.log(beta[j] / beta0)) + beta0 * gap @ precision @ gap)
            bound -= log_b(inverse[j], nu[j]) - log_b(w0, nu0) + (nu[j] - nu0) / 2 * log_det[j] + 0.5 * (np.trace(w0 @ precision) - nu[j] * d)
        covariance = inverse / np.maximum(nu - d - 1, 1.0)[:, None, None]
        out = {"responsibilities": r, "means": m, "covariances": covariance, "priors": alpha / alpha.sum(), "free_energy": float(bound)}
        if abs(bound - before) <= tol * abs(bound):
            break
        before = bound
    return out


def repaired(x: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Labels in which no state is empty: the map least like its own centre begins the missing one."""
    labels = labels.copy()
    for missing in np.setdiff1d(np.arange(k), labels):
        centres = updated(x, labels, np.zeros((k, x.shape[1])) + x[0], np.random.default_rng(0))
        own = np.abs((x * centres[labels]).sum(axis=1))
        own[np.bincount(labels, minlength=k)[labels] < 2] = np.inf
        labels[int(own.argmin())] = missing
    return labels
