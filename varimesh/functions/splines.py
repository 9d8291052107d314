"""Spline bases on a small grid, and their values at data points.

A basis is computed once on a grid of a hundred points or so; data points take their values by linear interpolation between grid points, as
column expressions on a broadcast grid, so no rows leave the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def natural_cubic(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The natural cubic splines that are one at a knot and zero at the others; linear beyond the ends."""
    k = np.asarray(knots, float)
    n, h = len(k), np.diff(k)
    a, r = np.zeros((n, n)), np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    m = np.linalg.solve(a, r)  # second derivatives at the knots, for each unit vector of values
    y = np.eye(n)
    at = np.clip(np.searchsorted(k, x, "right") - 1, 0, n - 2)
    left, right, w = (k[at + 1] - x)[:, None], (x - k[at])[:, None], h[at][:, None]
    out = (m[at] * left**3 + m[at + 1] * right**3) / (6 * w) + (y[at] / w - m[at] * w / 6) * left + (y[at + 1] / w - m[at + 1] * w / 6) * right
    for end, s, below in ((0, (y[1] - y[0]) / h[0] - h[0] * m[1] / 6, True), (n - 1, (y[-1] - y[-2]) / h[-1] + h[-1] * m[-2] / 6, False)):
        far = x < k[0] if below else x > k[-1]
        out[far] = y[end] + (x[far] - k[end])[:, None] * s
    return out


def b_splines(x: np.ndarray, knots: np.ndarray, ends: tuple[float, float], degree: int = 3) -> np.ndarray:
    """B-splines by the Cox-de Boor recursion; the first is left out, as a constant column stands for it."""
    t = np.concatenate(([ends[0]] * (degree + 1), np.sort(knots), [ends[1]] * (degree + 1)))
    x = np.clip(x, *ends)
    n = len(t) - 1
    b = np.array([(t[i] <= x) & (x < t[i + 1]) for i in range(n)], float).T
    last = np.flatnonzero(np.diff(t) > 0)[-1]
    b[x == ends[1], last] = 1
    for d in range(1, degree + 1):
        new = np.zeros((len(x), n - d))
        for i in range(n - d):
            if t[i + d] > t[i]:
                new[:, i] += (x - t[i]) / (t[i + d] - t[i]) * b[:, i]
            if t[i + d + 1] > t[i + 1]:
                new[:, i] += (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * b[:, i + 1]
        b = new
    return b[:, 1:]


def natural_b_splines(x: np.ndarray, knots: np.ndarray, ends: tuple[float, float]) -> np.ndarray:
    """A basis of natural cubic splines with the span of B-splines whose second derivative is zero at both ends."""
    basis = natural_cubic(x, np.concatenate(([ends[0]], np.sort(knots), [ends[1]])))
    return basis[:, 1:]


def remove_powers(x: np.ndarray, basis: np.ndarray, powers: list[int]) -> np.ndarray:
    """The basis without what powers of ``x`` explain."""
    if not powers:
        return basis
    p = np.stack([x**k for k in powers], 1)
    return basis - p @ np.linalg.lstsq(p, basis, rcond=None)[0]


def orthonormal(basis: np.ndarray, drop: int = 1) -> np.ndarray:
    """Left singular vectors of the centred basis without the last ``drop``, each scaled to a largest size of one with that entry positive."""
    u = np.linalg.svd(basis - basis.mean(axis=0), full_matrices=False)[0]
    u = u[:, : u.shape[1] - drop]
    top = u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]
    return u / top


@dataclass
class Basis:
    grid: np.ndarray
    values: np.ndarray
    knots: list[float]

    @property
    def gradient(self) -> np.ndarray:
        return np.gradient(self.values, self.grid, axis=0)

    def curve(self, beta: np.ndarray, cov: np.ndarray, derivative: bool = False) -> list[tuple[float, float, float, float]]:
        """``(x, effect, se, z)`` along the grid; with an intercept's estimate last, it is part of the effect but not of the slope."""
        b = self.gradient if derivative else self.values
        if len(beta) == b.shape[1] + 1:
            b = np.concatenate((b, np.full((len(b), 1), 0.0 if derivative else 1.0)), 1)
        effect, se = b @ beta, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", b, cov, b), 0))
        return [(float(x), float(e), float(s), float(e / s) if s else float("nan")) for x, e, s in zip(self.grid, effect, se, strict=True)]


def basis(ends: tuple[float, float], knots: list[float], kind: str = "nsk", method: str = "svd", powers: list[int] | None = None, points: int = 101) -> Basis:
    """A basis on a grid over ``ends``: ``nsk`` (unit at its knots), ``ns`` or ``bs``; then orthonormal (``svd``) or as it is (``raw``)."""
    grid = np.linspace(*ends, points)
    inner = [k for k in sorted(set(knots)) if ends[0] < k < ends[1]]
    if kind in ("nsk", "nsk-R"):
        values = natural_cubic(grid, np.array([ends[0], *inner, ends[1]]))
        values = values if method == "svd" else values[:, 1:]
    elif kind == "ns":
        values = natural_b_splines(grid, np.array(inner), ends)
    elif kind == "bs":
        values = b_splines(grid, np.array(inner), ends)
    else:
        raise ValueError(f"unknown spline {kind}")
    values = remove_powers(grid, values, powers or [])
    return Basis(grid, orthonormal(values) if method == "svd" else values, [float(ends[0]), *inner, float(ends[1])])


def add_basis(df: DataFrame, column: str, b: Basis) -> tuple[DataFrame, list[str]]:
    """Columns ``<column>_bf<k>``: values at each row by linear interpolation, beyond the ends by the end's slope."""
    lo, step, n = float(b.grid[0]), float(b.grid[1] - b.grid[0]), len(b.grid)
    at = F.greatest(F.lit(0), F.least(F.lit(n - 2), F.floor((F.col(column) - lo) / step).cast("int")))
    w = (F.col(column) - (F.lit(lo) + at * step)) / step
    made = {}
    for k in range(b.values.shape[1]):
        grid = F.array(*[F.lit(float(v)) for v in b.values[:, k]])
        made[f"{column}_bf{k + 1}"] = F.get(grid, at) * (1 - w) + F.get(grid, at + 1) * w
    return df.withColumns(made), list(made)
