"""Least squares from sufficient statistics, contrasts and Wald tests.

One aggregate over the rows gives X'X, X'Y and Y'Y; only these matrices, whose size is set by the number of columns, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varimesh.functions.dist import chi2_log10sf, f_sf, signed_log10p


@dataclass
class Gram:
    """X'X, X'Y, the diagonal of Y'Y, and the number of rows."""

    xs: list[str]
    ys: list[str]
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    n: int
    eigen: np.ndarray = field(default=None, repr=False)


def _sums(xs: list[str], ys: list[str]) -> list:
    p = len(xs)
    c = lambda name: F.col(f"`{name}`").cast("double")
    sums = [F.sum(c(xs[i]) * c(xs[j])) for i in range(p) for j in range(i, p)]
    sums += [F.sum(c(x) * c(y)) for x in xs for y in ys] + [F.sum(c(y) * c(y)) for y in ys] + [F.count(F.lit(1))]
    return [s.alias(f"s{k}") for k, s in enumerate(sums)]


def _gram(xs: list[str], ys: list[str], row: list[float]) -> Gram:
    p, v = len(xs), len(ys)
    row = [x or 0.0 for x in row]
    xx = np.zeros((p, p))
    upper = np.triu_indices(p)
    xx[upper] = row[: len(upper[0])]
    xx = xx + np.triu(xx, 1).T
    at = len(upper[0])
    return Gram(xs, ys, xx, np.array(row[at : at + p * v]).reshape(p, v), np.array(row[at + p * v : at + p * v + v]), int(row[-1]))


def gram(df: DataFrame, xs: list[str], ys: list[str]) -> Gram:
    """Sums of products of columns in one aggregate; the partial sums combine on the map side. Rows with a null in any column must be gone."""
    return _gram(xs, ys, list(df.agg(*_sums(xs, ys)).first()))


def grams(df: DataFrame, key: str, xs: list[str], ys: list[str]) -> dict:
    """The Gram matrix of each of a few values of ``key``, from one pass."""
    return {row[0]: _gram(xs, ys, list(row[1:])) for row in df.groupBy(key).agg(*_sums(xs, ys)).collect()}


def part(g: Gram, xs: list[str]) -> Gram:
    """The Gram matrix of some of the columns."""
    at = [g.xs.index(x) for x in xs]
    return Gram(xs, g.ys, g.xx[np.ix_(at, at)], g.xy[at], g.yy, g.n)


def gram_arrays(df: DataFrame, xs: list[str], y: str, width: int) -> Gram:
    """The same for outcomes in one array column: each Arrow batch is one matrix product, and the partial matrices are added up by place."""
    p = len(xs)

    def run(batches):
        from .arrays import sliced

        total, n = np.zeros((p, p + width)), 0
        squares = np.zeros(width)
        for b in sliced(batches, p):
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)], 1).astype(float)
            m = b.column(p).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
            total[:, :p] += x.T @ x
            total[:, p:] += x.T @ m
            squares += np.einsum("ij,ij->j", m, m)
            n += len(x)
        flat = np.concatenate((total.ravel(), squares, [n]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "x"])

    parts = df.select(*[F.col(x).cast("double") for x in xs], y).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    flat = np.zeros(p * (p + width) + width + 1)
    for r in parts.collect():
        flat[r["i"]] = r["x"]
    m = flat[: p * (p + width)].reshape(p, p + width)
    return Gram(xs, [f"y{k}" for k in range(width)], m[:, :p], m[:, p:], flat[-width - 1 : -1], int(flat[-1]))


def inverse(a: np.ndarray) -> np.ndarray:
    """The inverse, or the pseudo-inverse where the rank falls short."""
    return np.linalg.inv(a) if np.linalg.matrix_rank(a, hermitian=True) == len(a) else np.linalg.pinv(a, hermitian=True)


def nearest_spd(a: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, bool]:
    """The nearest symmetric positive definite matrix (Higham), and whether it was reached."""
    b = (a + a.T) / 2
    try:
        np.linalg.cholesky(b)
        return b, True
    except np.linalg.LinAlgError:
        pass
    _, s, vt = np.linalg.svd(b)
    b = (b + vt.T @ (s[:, None] * vt)) / 2
    b = (b + b.T) / 2
    for k in range(1, rounds + 1):
        try:
            np.linalg.cholesky(b)
            return b, True
        except np.linalg.LinAlgError:
            low = np.linalg.eigvalsh(b).min()
            b = b + np.eye(len(b)) * (-low * k * k + np.spacing(max(np.linalg.norm(b), 1e-300)))
    return b, False


def independent_columns(xx: np.ndarray) -> list[int]:
    """Columns to keep, by QR with pivots run on the Gram matrix; the tolerance follows the largest column."""
    a = xx.astype(float).copy()
    p, kept = len(a), []
    norm = np.diag(a).copy()
    first = np.sqrt(max(norm.max(initial=0.0), 0.0))
    tol = first * min(max(p, 1) * np.finfo(float).eps * 1e3, np.sqrt(np.finfo(float).eps))
    tol = max(tol, first * 1e-7)  # a Gram matrix holds squares, so half of the digits
    left = list(range(p))
    while left:
        k = max(left, key=lambda i: (a[i, i], -i))
        if a[k, k] <= tol * tol:
            break
        kept.append(k)
        left.remove(k)
        col = a[:, k].copy()
        a -= np.outer(col, col) / a[k, k]
    return sorted(kept)


def singularity(xx: np.ndarray) -> float:
    """cond(X'X) relative to that of its diagonal."""
    return float(np.linalg.cond(xx) / np.linalg.cond(np.diag(np.diag(xx))))


@dataclass
class Fit:
    """Estimates for all outcomes; ``cov`` is shared up to the factor ``sigma2``."""

    terms: list[str]
    ys: list[str]
    beta: np.ndarray
    cov: np.ndarray
    sigma2: np.ndarray
    n: int

    def covariance(self, k: int) -> np.ndarray:
        return (self.cov if self.cov.ndim == 2 else self.cov[k]) * self.sigma2[k]

    def table(self, spark: SparkSession, contrasts: np.ndarray | None = None, names: list[str] | None = None) -> DataFrame:
        """``(y_id, term, beta, se, z, logp)``; contrast rows come first."""
        rows = []
        for k, y in enumerate(self.ys):
            c = self.covariance(k)
            l = np.eye(len(self.terms)) if contrasts is None else np.vstack((contrasts, np.eye(len(self.terms))))
            est, se = l @ self.beta[:, k], np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", l, c, l), 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                z = est / se
            p = signed_log10p(z)
            labels = [*(names or [f"contrast_{i}" for i in range(len(l) - len(self.terms))]), *self.terms]
            rows += [(y, t, *map(float, x)) for t, x in zip(labels, zip(est, se, z, p, strict=True), strict=True)]
        return spark.createDataFrame(rows, "y_id string, term string, beta double, se double, z double, logp double")


def ols(g: Gram) -> Fit:
    """Ordinary least squares; the residual variance has n minus the number of columns below it."""
    c = inverse(g.xx)
    beta = c @ g.xy
    rss = g.yy - np.einsum("ij,ij->j", beta, g.xy)
    return Fit(g.xs, g.ys, beta, c, np.maximum(rss, 0) / max(1, g.n - len(g.xs)), g.n)


def residuals(df: DataFrame, fit: Fit, keep: list[str]) -> DataFrame:
    """``keep`` and ``r_<y>`` for every outcome, as plain expressions."""
    out = {}
    for k, y in enumerate(fit.ys):
        fitted = sum((F.lit(float(b)) * F.col(f"`{x}`") for b, x in zip(fit.beta[:, k], fit.terms, strict=True)), F.lit(0.0))
        out[f"r_{y}"] = F.col(f"`{y}`") - fitted
    return df.select(*keep, *[c.alias(n) for n, c in out.items()])


def wald(fit: Fit, contrasts: list[np.ndarray], hypothesis: float = 0.0, use_f: bool = False) -> list[tuple]:
    """``(y, set, statistic, df, -log10 p)`` of each set of contrast rows; the pseudo-inverse where it is singular."""
    out = []
    for k, y in enumerate(fit.ys):
        for i, l in enumerate(contrasts):
            d = l @ fit.beta[:, k] - hypothesis
            w, rank = float(d @ inverse(l @ fit.covariance(k) @ l.T) @ d), int(np.linalg.matrix_rank(l))
            if use_f:
                with np.errstate(divide="ignore"):
                    p = -np.log10(f_sf(w / rank, rank, fit.n - len(fit.terms)))[0]
                out.append((y, i, w / rank, rank, float(p)))
            else:
                out.append((y, i, w, rank, float(-chi2_log10sf(w, rank)[0])))
    return out


def omnibus(fit: Fit, prefixes: list[str], use_f: bool = False) -> list[tuple]:
    """A joint Wald test of all columns of each variable, such as those of its spline: the terms that begin with its name and an underscore."""
    sets = [np.eye(len(fit.terms))[[i for i, t in enumerate(fit.terms) if t == p or t.startswith(f"{p}_")]] for p in prefixes]
    if empty := [p for p, s in zip(prefixes, sets, strict=True) if not len(s)]:
        raise ValueError(f"no column of {', '.join(empty)}")
    return wald(fit, sets, use_f=use_f)


def delta_r2(df: DataFrame, full: Fit, reduced: Fit) -> float:
    """Mean share of the outcomes' variance that the full model's fitted values have over the reduced one's."""
    fitted = [sum((F.lit(float(b)) * F.col(f"`{x}`") for b, x in zip(fit.beta[:, k], fit.terms, strict=True)), F.lit(0.0)) for fit in (full, reduced) for k in range(len(fit.ys))]
    row = df.agg(*[F.var_samp(f).alias(f"f{k}") for k, f in enumerate(fitted)], *[F.var_samp(f"`{y}`").alias(f"v{k}") for k, y in enumerate(full.ys)]).first()
    v = len(full.ys)
    return sum(row[:v]) / sum(row[2 * v :]) - sum(row[v : 2 * v]) / sum(row[2 * v :])
