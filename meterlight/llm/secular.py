"""Eigendecomposition of a growing scatter matrix, by rank-one updates.

A spectrum holds a count, a mean, and the eigenvalues and eigenvectors of the scatter (the sum of centred outer
products) of the rows seen. A new row adds a multiple of the outer product of its distance from the mean; a second
spectrum adds its eigenpairs, one rank-one update each, and one for the distance of the means.

An update of ``diag(values) + rho z z'`` first deflates: components of z that are too small to matter leave their
eigenpairs as they are, and within a run of equal eigenvalues a reflection gathers z in one of them. The roots of the
secular equation 1 + rho sum z_i^2 / (values_i - x) = 0 lie between the remaining eigenvalues; all are found together,
as distances from the nearer eigenvalue, by rational interpolation within a shrinking bracket. The z for which these
roots are exact gives eigenvectors that are orthogonal to working precision.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
ROUNDS = 80
#: Updates between corrections of the eigenvectors' orthogonality.
TIDY = 256


def roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """Differences d_i - x_j (row i, column j) for the roots x_j, ``d`` rising and distinct, ``z2`` squares above 0."""
    k = len(d)
    total = rho * z2.sum()
    upper = np.append(d[1:], d[-1] + total)
    width = upper - d
    mid = d + width / 2
    value = 1 + rho * (z2[:, None] / (d[:, None] - mid)).sum(axis=0)
    left = value >= 0  # the root lies in the left half of its interval
    left[-1] = True
    base = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    gaps = d[:, None] - d[base]  # of the poles from each root's base
    low = np.where(left, 0.0, -width / 2)
    high = np.where(left, width / 2, 0.0)
    high[-1] = total * (1 + 8 * EPS)
    if value[-1] < 0:
        low[-1] = total / 2
    else:
        high[-1] = total / 2
    t = (low + high) / 2
    below = np.arange(k)[:, None] <= np.arange(k)[None, :]  # poles at or below a root
    pole_a, pole_b = gaps[np.arange(k), np.arange(k)], np.append(gaps[np.arange(1, k), np.arange(k - 1)], np.inf)
    active = np.arange(k)
    for _ in range(ROUNDS):
        delta = gaps[:, active] - t[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = rho * z2[:, None] / delta
            steep = terms / delta
        side = below[:, active]
        psi, phi = np.where(side, terms, 0).sum(axis=0), np.where(side, 0, terms).sum(axis=0)
        f = 1 + psi + phi
        size = 1 + np.abs(psi) + np.abs(phi)
        up = f < 0  # f rises between poles
        low[active] = np.where(up, t[active], low[active])
        high[active] = np.where(up, high[active], t[active])
        done = (np.abs(f) <= 4 * EPS * size) | (high[active] - low[active] <= 2 * EPS * np.abs(t[active]))
        if done.all():
            break
        active, delta, f = active[~done], delta[:, ~done], f[~done]
        side = side[:, ~done]
        slope_a, slope_b = np.where(side, steep[:, ~done], 0).sum(axis=0), np.where(side, 0, steep[:, ~done]).sum(axis=0)
        # f is taken as c + a / (A - t) + b / (B - t), with the poles A and B beside the root; slopes agree.
        da, db = pole_a[active] - t[active], pole_b[active] - t[active]
        last = np.isinf(db)
        db = np.where(last, 0.0, db)
        with np.errstate(all="ignore"):
            # A quadratic c x^2 - p x + q = 0 for the step x; beyond the last pole c + a / (A - t) alone.
            c = f - slope_a * da - slope_b * db
            p = f * (da + db) - da * db * (slope_a + slope_b)
            q = f * da * db
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step = np.where(last, da + slope_a * da * da / c, step)
        there = t[active] + step
        bad = ~np.isfinite(there) | (there <= low[active]) | (there >= high[active])
        t[active] = np.where(bad, (low[active] + high[active]) / 2, there)
    return gaps - t


def _householder(z: np.ndarray) -> tuple[np.ndarray, float]:
    """A unit u with (I - 2 u u') z = (norm, 0, ...)."""
    norm = float(np.linalg.norm(z))
    u = z.copy()
    u[0] += np.copysign(norm, z[0]) if z[0] else norm
    sign = -1.0 if z[0] >= 0 else 1.0
    return u / np.linalg.norm(u), sign * norm


def update(values: np.ndarray, vectors: np.ndarray, row: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of the matrix with ``rho`` times row row' added."""
    z = vectors.T @ row
    norm = float(np.sqrt(z @ z))
    if not norm or not rho:
        return values, vectors
    z, rho = z / norm, rho * norm * norm
    least = 8 * EPS * max(float(np.abs(values).max()), rho)
    vectors = vectors.copy()
    close = np.diff(values) <= least
    if close.any():
        edges = np.flatnonzero(~np.concatenate([[False], close]))
        for a, b in zip(edges, [*edges[1:], len(values)]):
            if b - a > 1 and np.count_nonzero(z[a:b]) > 1:
                u, length = _householder(z[a:b])
                vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ u, u)
                z[a:b] = 0
                z[a] = length
    moving = rho * np.abs(z) > least
    # Of a run of nearly equal eigenvalues only one moves, so those that move are distinct.
    at = np.flatnonzero(moving)
    if not len(at):
        return values, vectors
    d, z2 = values[at], z[at] ** 2
    delta = roots(d, z2, rho)
    out = values.copy()
    nearest = np.abs(delta).argmin(axis=0)
    out[at] = d[nearest] - delta[nearest, np.arange(len(at))]
    if len(at) > 1:
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = d[None, :] - d[:, None]  # d_j - d_i
            ratio = -delta / np.where(spread == 0, 1.0, spread)
        exact = np.sqrt(np.abs(np.prod(ratio, axis=1)) / rho) * np.sign(z[at])
        turn = exact[:, None] / delta
    else:
        turn = np.ones((1, 1))
    turn /= np.linalg.norm(turn, axis=0)
    vectors[:, at] = vectors[:, at] @ turn
    order = np.argsort(out, kind="stable")
    return out[order], vectors[:, order]


class Spectrum:
    """Count, mean and scatter of the rows seen, the scatter as eigenvalues (rising) and eigenvectors."""

    def __init__(self, size: int):
        self.n = 0
        self.mean = np.zeros(size)
        self.values = np.zeros(size)
        self.vectors = np.eye(size)
        self._since = 0

    def _update(self, row: np.ndarray, rho: float) -> None:
        self.values, self.vectors = update(self.values, self.vectors, row, rho)
        self._since += 1
        if self._since >= TIDY:
            self.tidy()

    def tidy(self) -> None:
        """One Newton step towards orthogonal eigenvectors."""
        q = self.vectors
        self.vectors = q @ (1.5 * np.eye(len(q)) - 0.5 * (q.T @ q))
        self._since = 0

    def add(self, row: np.ndarray) -> None:
        away = row - self.mean
        self.n += 1
        self._update(away, (self.n - 1) / self.n)
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, row in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(row, float(value))
        n = self.n + other.n
        away = other.mean - self.mean
        self._update(away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.n = n
