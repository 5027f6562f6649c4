"""Spectra of scatter matrices that grow by rank-one updates.

A scatter matrix M = U diag(values) U' becomes M + rho v v' without being formed: with z = U'v, the new values are the roots
of the secular equation 1 + rho * sum(z_i^2 / (values_i - root)) = 0, one between each two neighbouring old values, and the new
vectors are U times the columns z_i / (values_i - root).  Places where z is nothing keep their value and vector, and of values that
are nearly equal all but one are rotated to such places (deflation).  Each root is found as its distance from the nearer old value, and z is
worked out anew from the roots, which keeps the vectors orthogonal however close the roots are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps
STEPS = 64


def secular_roots(old: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots for rising, distinct old values, a z of length 1 without zeros and rho > 0; and old_i - root_j as a matrix (j, i)."""
    k, z2 = len(old), z * z * rho
    gap = np.append(np.diff(old), rho)
    half = gap / 2
    apart = old[None, :] - old[:, None]
    right = 1.0 + (z2 / (apart - half[:, None])).sum(axis=1) < 0  # the root lies in the upper half
    right[-1] = False
    lower, upper = np.zeros(k), half.copy()
    upper[-1] = rho
    lower[right], upper[right] = -half[right], 0.0
    near = np.arange(k) + right
    apart = old[None, :] - old[near][:, None]
    for _ in range(STEPS):
        middle = (lower + upper) / 2
        with np.errstate(divide="ignore"):
            below = 1.0 + (z2 / (apart - middle[:, None])).sum(axis=1) < 0
        lower, upper = np.where(below, middle, lower), np.where(below, upper, middle)
    shift = (lower + upper) / 2
    shift = np.where(shift == 0, np.where(right, -1, 1) * np.finfo(float).tiny, shift)
    return old[near] + shift, apart - shift[:, None]


def updated(values: np.ndarray, vectors: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, rising, and vectors of M + rho v v', rho > 0."""
    z = vectors.T @ v
    length = float(np.sqrt(z @ z))
    rho = rho * length * length
    tolerance = 8 * EPS * max(abs(values[0]), abs(values[-1]), rho)
    if length == 0 or rho <= EPS * tolerance:
        return values, vectors
    z = z / length
    vectors = vectors.copy()
    live = np.flatnonzero(rho * np.abs(z) > tolerance)
    keep: list[int] = []
    if len(live) > 1 and (np.diff(values[live]) <= 4 * tolerance).any():
        for i in live.tolist():
            if keep:
                j = keep[-1]
                r = float(np.hypot(z[i], z[j]))
                c, s = z[i] / r, z[j] / r
                if abs((values[i] - values[j]) * c * s) <= tolerance:
                    vectors[:, j], vectors[:, i] = c * vectors[:, j] - s * vectors[:, i], s * vectors[:, j] + c * vectors[:, i]
                    z[j], z[i] = 0.0, r
                    values = values.copy()
                    a, b = values[j], values[i]
                    values[j], values[i] = a * c * c + b * s * s, a * s * s + b * c * c
                    keep.pop()
            keep.append(i)
        live = np.array(keep)
    if not len(live):
        return values, vectors
    order = live[np.argsort(values[live], kind="stable")]
    roots, apart = secular_roots(values[order], z[order], rho)
    old = values[order]
    if len(order) > 1:
        between = old[None, :] - old[:, None]  # (j, i): old_i - old_j
        np.fill_diagonal(between, 1.0)
        ratio = apart / between
        fitted = np.sqrt(np.abs(ratio.prod(axis=0)))
    else:
        fitted = np.ones(1)
    columns = (np.copysign(fitted, z[order])[None, :] / apart).T
    columns /= np.sqrt((columns * columns).sum(axis=0))
    vectors[:, order] = vectors[:, order] @ columns
    values = values.copy()
    values[order] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """The number of rows, their exact sums (whole numbers of any size), and the values and vectors of their scatter about the mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, [0] * size, np.zeros(size), np.eye(size))

    def joined(self, n: int, sums: list[int], directions: np.ndarray) -> Spectrum:
        """With n more rows of these sums, whose scatter about their own mean is the sum of v v' over `directions`."""
        if not n:
            return self
        values, vectors = self.values, self.vectors
        for v in directions:
            values, vectors = updated(values, vectors, 1.0, v)
        if self.n:
            shift = np.array([(b * self.n - a * n) / (n * self.n) for a, b in zip(self.sums, sums, strict=True)])
            values, vectors = updated(values, vectors, self.n * n / (self.n + n), shift)
        return Spectrum(self.n + n, [a + b for a, b in zip(self.sums, sums, strict=True)], values, vectors)

    def with_rows(self, x: np.ndarray) -> Spectrum:
        """With the rows of a block of whole numbers.  More rows than columns are first turned into as many rows of equal scatter (QR)."""
        if not len(x):
            return self
        sums = [sum(c) for c in x.T.tolist()]
        centred = x - x[0]  # exact
        centred = centred.astype(float)
        centred -= centred.mean(axis=0)
        directions = np.linalg.qr(centred, mode="r") if len(x) > x.shape[1] else centred
        return self.joined(len(x), sums, directions)

    def merged(self, other: Spectrum) -> Spectrum:
        """Of the rows of both: the other's values and vectors come in as successive updates."""
        directions = (other.vectors * np.sqrt(np.maximum(other.values, 0.0))).T
        return self.joined(other.n, other.sums, directions[other.values > 0])
