"""p-values beyond the range of resamples: a law fitted to the tail of the resampled statistics, blended into their empirical distribution.

Statistics are counted in cells of a histogram, one for each key; a key may stand for one outcome or for all of them, and then every outcome is judged by one fit over resamples times
outcomes. What a task gets is histograms, never statistics. Their laws are fitted all at once by weighted least squares on -log of the survival, from a low to a high quantile, with the curve set to meet the
empirical one at the low end; the weights are those of binomial intervals on a double logarithmic scale. Between the two quantiles the result passes from the empirical curve to the law.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1000
LOG10 = math.log(10)
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _gamma_nlsf(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """-log Q(a, x) of the regularised upper incomplete gamma function, elementwise: a series below, a continued fraction above."""
    x, a = np.broadcast_arrays(np.maximum(x, 1e-300), a)
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        front = -x + a * np.log(x) - _lgamma(a)
        low = x < a + 1
        term = total = 1 / a
        for k in range(1, 400):
            term = term * np.where(low, x, 0) / (a + k)
            total = total + term
            if (term < 1e-17 * total).all():
                break
        below = -np.log1p(-np.minimum(np.exp(np.where(low, front, -np.inf)) * total, 1 - 1e-16))
        y = np.where(low, a + 2, x)
        b = y + 1 - a
        c, d = np.full(y.shape, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 400):
            an, b = -i * (i - a), b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        return np.where(low, below, -(front + np.log(h)))


def _beta_nlcdf(logp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-log I_p(a, b) for p = exp(logp), elementwise: the power series in p, or its complement's where p is over one half."""
    logp, a, b = np.broadcast_arrays(np.minimum(logp, -1e-12), a, b)

    def series(p, logp, a, b):
        """log of I_p(a, b) for p up to a half."""
        term = total = np.ones(p.shape)
        for k in range(1, 400):
            term = term * (k - b) / k * p
            total = total + term * a / (a + k)
            if (np.abs(term) < 1e-17 * np.abs(total)).all():
                break
        return a * logp - np.log(a) + _lgamma(a + b) - _lgamma(a) - _lgamma(b) + np.log(np.maximum(total, 1e-300))

    p = np.exp(logp)
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        small = p <= 0.5
        direct = series(np.where(small, p, 0.25), np.where(small, logp, math.log(0.25)), a, b)
        rest = np.where(small, 0.25, 1 - p)
        other = np.minimum(np.exp(series(rest, np.log(np.maximum(rest, 1e-300)), b, a)), 1 - 1e-16)
        return -np.where(small, direct, np.log1p(-other))


#: -log of the survival of each law at x; the parameters are logarithms, one row for each key.
LAWS: dict[str, tuple[int, Callable[[np.ndarray, np.ndarray], np.ndarray]]] = {
    "gamma": (2, lambda x, t: _gamma_nlsf(x * np.exp(-t[:, 1:2]), np.exp(t[:, :1]))),
    "weibull": (2, lambda x, t: (x * np.exp(-t[:, 1:2])) ** np.exp(t[:, :1])),
    "chi2": (1, lambda x, t: _gamma_nlsf(x / 2, np.exp(t[:, :1]))),
    "beta": (2, lambda x, t: _beta_nlcdf(-x * LOG10, np.exp(t[:, :1]), np.exp(t[:, 1:2]))),
    "sidak": (1, lambda x, t: -np.log(-np.expm1(np.exp(t[:, :1]) * np.log1p(-np.exp(np.minimum(-x * LOG10, -1e-12)))))),
}


def _start(law: str, m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Logarithms of first parameters, from the mean and variance of the statistics."""
    m, v = np.maximum(m, 1e-12), np.maximum(v, 1e-12)
    if law == "gamma":
        return np.log(np.stack((m * m / v, v / m), 1))
    if law == "weibull":
        shape = np.clip((np.sqrt(v) / m) ** -1.086, 0.1, 50)  # a close approximation by the coefficient of variation
        return np.stack((np.log(shape), np.log(m) - _lgamma(1 + 1 / shape)), 1)
    if law == "chi2":
        return np.log(m / 2)[:, None]
    # x is -log10 of a p-value: with p of beta(a, 1) the mean of x is 1 / (a log 10)
    return np.stack((-np.log(m * LOG10), np.zeros(len(m))), 1) if law == "beta" else np.log(np.maximum(10 ** np.minimum(m, 8) - 0.5, 1.0))[:, None]


def fitted(law: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, first: np.ndarray, start: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logarithms of the parameters that bring -log survival, moved to meet ``y`` at each row's cell ``first``, closest to ``y`` under weights ``w``: Gauss-Newton with damping, all rows at once."""
    n, k = LAWS[law][0], np.arange(len(x))
    of = lambda t: (lambda f: f - f[k, first][:, None] + y[k, first][:, None])(LAWS[law][1](x, t))

    def cost(t):
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.where(w > 0, of(t) - y, 0.0)
        return d, np.where(np.isfinite(c := (w * d * d).sum(1)), c, np.inf)

    t, damp = start.copy(), np.full(len(x), 1e-2)
    d, best = cost(t)
    for _ in range(rounds):
        j = np.stack([(np.where(w > 0, of(t + 1e-5 * np.eye(n)[i]), 0) - np.where(w > 0, of(t - 1e-5 * np.eye(n)[i]), 0)) / 2e-5 for i in range(n)], 2)
        j = np.nan_to_num(j, posinf=0, neginf=0)
        g, h = np.einsum("rc,rci,rc->ri", w, j, np.nan_to_num(d)), np.einsum("rc,rci,rcj->rij", w, j, j)
        h = h + np.einsum("r,rij->rij", damp, h * np.eye(n)) + 1e-12 * np.eye(n)
        step = np.clip(-np.linalg.solve(h, g[:, :, None])[:, :, 0], -1, 1)
        tried, c = cost(t + step)
        better = c < best
        t[better], d[better] = (t + step)[better], tried[better]
        change = np.where(better, best - c, 0.0)
        best = np.where(better, c, best)
        damp = np.where(better, damp / 5, np.minimum(damp * 5, 1e12))
        if (np.abs(step).max(1) < 1e-9).all() or ((damp > 1e8) | (better & (change < 1e-13 * np.maximum(best, 1e-300)))).all():
            break
    return t


def _interval(k: np.ndarray, n: np.ndarray, z: float = 1.959963984540054) -> tuple[np.ndarray, np.ndarray]:
    p, d = k / n, 1 + z * z / n
    half = z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    middle = (p + z * z / (2 * n)) / d
    return np.maximum(middle - half, 1e-300), np.minimum(middle + half, 1 - 1e-12)


class Curve:
    """-log of the survival on the cells' upper edges, for a batch of keys."""

    def __init__(self, law: str, counts: np.ndarray, width: np.ndarray, low: float, high: float):
        n = counts.sum(1, keepdims=True)
        self.width, cells = width, counts.shape[1]
        x = width[:, None] * np.arange(1, cells + 1)
        above = n - np.cumsum(counts, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.y = -np.log(above / n)
            lower, upper = _interval(above, n)
            w = (np.log(-np.log(upper)) - np.log(-np.log(lower))) ** -2
        share = 1 - above / n
        first, last = (share < low).sum(1), np.minimum((share < high).sum(1), cells - 1)
        inside = (np.arange(cells) >= first[:, None]) & (np.arange(cells) <= last[:, None]) & (above > 0)
        w = np.where(inside & np.isfinite(w), w, 0.0)
        middle = x - width[:, None] / 2
        m = (counts * middle).sum(1) / n[:, 0]
        v = (counts * (middle - m[:, None]) ** 2).sum(1) / n[:, 0]
        self.good = (inside.sum(1) > LAWS[law][0]) & (first < last) & np.isfinite(self.y[np.arange(len(x)), np.minimum(first, cells - 1)])
        first = np.where(self.good, first, 0)
        y = np.where(np.isfinite(self.y), self.y, 0.0)
        self.law, self.first, self.last = law, first, last
        self.theta = fitted(law, x, y, np.where(self.good[:, None], w, 0.0), first, _start(law, m, v))
        self.offset = y[np.arange(len(x)), first] - LAWS[law][1](x[np.arange(len(x)), first][:, None], self.theta)[:, 0]
        self.n = n[:, 0]

    def __call__(self, row: np.ndarray, x: np.ndarray) -> np.ndarray:
        """-log10 p of statistics ``x``, each by its key's row of the batch; nan where the key has no law and ``x`` is past its resamples."""
        cell = x / self.width[row] - 1  # between the cells' upper edges
        at = np.clip(np.floor(cell), -1, self.y.shape[1] - 2).astype(int)
        part = np.clip(cell - at, 0, None)
        left, right = np.where(at >= 0, self.y[row, np.maximum(at, 0)], 0.0), self.y[row, at + 1]
        with np.errstate(invalid="ignore", divide="ignore"):
            own = np.where(np.isfinite(right), left + (right - left) * np.minimum(part, 1), np.nan)
            law = self.offset[row] + LAWS[self.law][1](x[:, None], self.theta[row])[:, 0]
            b = np.clip((cell - self.first[row]) / np.maximum(1, self.last[row] - self.first[row]), 0, 1)
            mixed = np.exp((1 - b) * np.log(np.maximum(own, 1e-300)) + b * np.log(np.maximum(law, 1e-300)))
            out = np.where((b >= 1) | np.isnan(own), law, np.where(b <= 0, own, mixed))
        return np.where(self.good[row], out, own) / LOG10 + 0.0


def tail_p(perms: DataFrame, keys: list[str], value: str = "z", law: str = "gamma", low: float = 0.9, high: float = 0.999, over: list[str] = (), stat: Column | None = None) -> DataFrame:
    """``keys, observed, logp`` of resample 0 among the others, by the blend of empirical tail and law.

    ``over`` are those of ``keys`` across which one law is fitted, such as the outcomes. The statistic is ``value`` squared, or ``stat``, which must not be negative; ``beta`` and ``sidak`` take it as a -log10 p-value. A
    key whose resamples have no spread between the quantiles keeps its empirical p-value, null past the largest resample. Null and infinite statistics are left out.
    """
    if law not in LAWS:
        raise ValueError(f"unknown law {law}")
    fit_keys = [k for k in keys if k not in over]
    x = F.col(value) ** 2 if stat is None else stat
    clean = perms.select(*keys, "perm_id", x.cast("double").alias("x")).where("x is not null and not isnan(x) and abs(x) < double('inf')")
    rest = clean.where("perm_id > 0")
    group = fit_keys or [F.lit(0).alias("_all")]
    names = fit_keys or ["_all"]
    width = rest.groupBy(*group).agg((F.max("x") * (1 + 1e-9) / CELLS).alias("width")).where("width > 0")
    cells = rest.select(*keys, "x", *([] if fit_keys else group)).join(F.broadcast(width) if not fit_keys else width, names)
    counted = cells.groupBy(*names, "width", F.least(F.floor(F.col("x") / F.col("width")), F.lit(CELLS - 1)).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    histograms = counted.groupBy(*names, "width").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # CELLS entries at most
    seen = clean.where("perm_id = 0").select(*keys, F.col("x").alias("observed"), *([] if fit_keys else group))
    kinds = {f.name: f.dataType.simpleString() for f in seen.schema}
    params = histograms.mapInArrow(_fit_batches(law, low, high, len(names)), ", ".join(f"{c} {kinds.get(c, 'int')}" for c in names) + ", curve binary")
    joined = seen.join(params, names, "left").select(*keys, "observed", "curve")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in batches:
            d = batch.column(len(keys) + 1).dictionary_encode()
            at, obs = d.indices.to_numpy(zero_copy_only=False), batch.column(len(keys)).to_numpy(zero_copy_only=False)
            logp = np.full(batch.num_rows, np.nan)
            for k, body in enumerate(d.dictionary.to_pylist()):
                own = np.flatnonzero(at == k)
                curve, row = pickle.loads(body)
                logp[own] = curve(np.full(len(own), row), obs[own])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array(logp, mask=~np.isfinite(logp))], [*keys, "observed", "logp"])

    return joined.mapInArrow(judge, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", observed double, logp double")


def family_tail_p(perms: DataFrame, over: list[str], keys: list[str], value: str = "z", law: str = "gamma", low: float = 0.1, high: float = 0.99) -> DataFrame:
    """The same against the largest absolute statistic of each resample over all outcomes; ``over`` are those of ``keys`` that stay apart."""
    top = perms.where("perm_id > 0").groupBy(*over, "perm_id").agg(F.max(F.abs(value)).alias("v"))
    seen = perms.where("perm_id = 0").select(*keys, "perm_id", F.abs(value).alias("v"))
    return tail_p(seen.unionByName(top, allowMissingColumns=True), keys, "v", law, low, high, [k for k in keys if k not in over], F.col("v")).where(" and ".join(f"{k} is not null" for k in keys))


def _fit_batches(law: str, low: float, high: float, n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                counts = np.zeros((some.num_rows, CELLS))
                for k, cells in enumerate(some.column(n_keys + 1)):
                    counts[k, cells.values.field("cell").to_numpy()] = cells.values.field("n").to_numpy()
                width = some.column(n_keys).to_numpy(zero_copy_only=False)
                whole, bodies = Curve(law, counts, width, low, high), []
                for k in range(some.num_rows):
                    one = object.__new__(Curve)
                    one.__dict__ = {a: (x[k : k + 1] if isinstance(x, np.ndarray) else x) for a, x in whole.__dict__.items()}
                    bodies.append(pickle.dumps((one, 0)))
                yield pa.RecordBatch.from_arrays([*some.columns[:n_keys], pa.array(bodies, pa.binary())], [*some.schema.names[:n_keys], "curve"])

    return run
