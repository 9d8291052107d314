"""Variance components of largest Gaussian likelihood, and intervals from the profile of the likelihood.

A pass over the data gives, for any number of outcomes and points at once, the log-likelihood, its derivatives and the expected information as sums over families. Effects of shared groups need of a
family its groups' residual sums and the counts of rows that groups share, packed into one row once; families of like counts are worked out together. Relatedness (A, D) takes the family's rows. The driver
makes the steps: scoring on the logarithms of the variances with damping, so every component stays positive, and the variances that a profile does not hold are maximised anew at each of its points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .groups import ID_OF, _ids
from .storage import saved

#: Half of the chi-squared value that one parameter's 95 % interval allows (fixed value).
DROP = 1.9207294103470618
#: Bytes of the matrices of families that are worked out together.
HELD = 8 << 20
Evaluate = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def packed(res: DataFrame, ys: list[str], effects: tuple[str, ...]) -> DataFrame:
    """``(n, effect, counts, sums, squares)`` of each family: each group's effect, the rows that groups share, residual sums of groups by outcomes, squares by outcome.

    A task holds one family's cells, rows with all ids alike as one, and its groups' counts.
    """
    own = [k for k, e in enumerate(effects) if e != "E"]
    r = [F.col(f"`r_{y}`") for y in ys]
    v = len(ys)
    cells = res.groupBy(*_ids(effects)).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(r)], *[F.sum(x * x).alias(f"q{i}") for i, x in enumerate(r)])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        n, s = part["n"].to_numpy(), part[[f"s{i}" for i in range(v)]].to_numpy(float)
        code = [pd.factorize(part[ID_OF[effects[k]]])[0] for k in own]
        start = np.cumsum([0, *(c.max(initial=-1) + 1 for c in code)])
        g = int(start[-1])
        counts, sums = np.zeros((g, g)), np.zeros((g, v))
        for i, a in enumerate(code):
            np.add.at(sums, start[i] + a[a >= 0], s[a >= 0])
            for j, b in enumerate(code):
                both = (a >= 0) & (b >= 0)
                np.add.at(counts, (start[i] + a[both], start[j] + b[both]), n[both])
        effect = np.repeat(np.array(own, np.int32), np.diff(start))
        squares = part[[f"q{i}" for i in range(v)]].sum().to_numpy(float)
        return pd.DataFrame({"n": [n.sum()], "effect": [effect.tobytes()], "counts": [counts.tobytes()], "sums": [sums.tobytes()], "squares": [squares.tobytes()]})

    made = cells.groupBy("fid").applyInPandas(run, "n double, effect binary, counts binary, sums binary, squares binary")
    # few bytes, but read and worked through by every pass: dealt to all cores, which their size would not call for
    return saved(made.repartition(max(2, res.sparkSession.sparkContext.defaultParallelism)))


def _grouped(n: np.ndarray, effect: np.ndarray, counts: np.ndarray, of: np.ndarray, u: np.ndarray, rr: np.ndarray, theta: np.ndarray) -> tuple:
    """Value, gradient and information of families whose groups have the same effects, in order: ``n`` and ``counts`` are by kind, ``of`` is each family's kind, ``u`` is families by groups, ``rr`` the squares of each."""
    k, e, m = len(theta), theta[-1], np.bincount(of, minlength=len(n)).astype(float)
    inner = counts.copy()
    at = np.arange(len(effect))
    inner[:, at, at] += e / theta[effect]
    inv = np.linalg.inv(inner)
    _, logdet = np.linalg.slogdet(inner)
    gi = counts @ inv
    gig = gi @ counts
    uk = (u[:, None, :] @ inv[of])[:, 0]
    ug = (uk[:, None, :] @ counts[of])[:, 0]
    fitted = np.einsum("fg,fg->f", uk, u)
    value = -0.5 * ((rr - fitted).sum() / e + m @ (n * np.log(2 * np.pi * e) + logdet + np.log(theta[effect] / e).sum()))
    w = (((u - ug) / e) ** 2).sum(0)
    p, p2 = (counts - gig) / e, (counts - 2 * gig + gi @ gig) / e**2
    trace, trace2 = np.einsum("dgg->dg", p), np.einsum("dgg->dg", p2)
    first, second, both = m @ trace, m @ trace2, np.einsum("d,dgh->gh", m, p**2)
    grad, info = np.zeros(k), np.zeros((k, k))
    own = [np.flatnonzero(effect == a) for a in range(k - 1)]
    for a, i in enumerate(own):
        grad[a] = 0.5 * (w[i].sum() - first[i].sum())
        info[a, k - 1] = info[k - 1, a] = 0.5 * second[i].sum()
        for b, j in enumerate(own):
            info[a, b] = 0.5 * both[np.ix_(i, j)].sum()
    q = (rr - 2 * fitted + np.einsum("fg,fg->f", uk, ug)).sum() / e**2
    one, two = np.einsum("dgg->d", gi), np.einsum("dgh,dhg->d", gi, gi)
    grad[-1] = 0.5 * (q - m @ (n - one) / e)
    info[-1, -1] = 0.5 * (m @ (n - 2 * one + two)) / e**2
    return value, grad, info


def _dense(matrices: np.ndarray, r: np.ndarray, theta: np.ndarray) -> tuple:
    """The same of one family from the matrices of its effects over its rows."""
    v = np.einsum("a,aij->ij", theta, matrices)
    sign, logdet = np.linalg.slogdet(v)
    k = len(theta)
    if sign <= 0:
        return np.nan, np.full(k, np.nan), np.full((k, k), np.nan)
    inv = np.linalg.inv(v)
    x = inv @ r
    value = -0.5 * (r @ x + logdet + len(r) * np.log(2 * np.pi))
    weighted = inv @ matrices
    grad = 0.5 * (np.einsum("i,aij,j->a", x, matrices, x) - np.einsum("aii->a", weighted))
    return value, grad, 0.5 * np.einsum("aij,bji->ab", weighted, weighted)


def evaluator(res: DataFrame, ys: list[str], effects: tuple[str, ...]) -> Evaluate:
    """A function of points: outcomes by number, and variances, one row each; it returns values, gradients and informations. Each call is one pass."""
    k = len(effects)
    size = 1 + k + k * k

    def summed(parts: DataFrame, points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.zeros(points * size)
        for row in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():
            flat[row["i"]] = row["x"]
        flat = flat.reshape(points, size)
        return flat[:, 0], flat[:, 1 : 1 + k], flat[:, 1 + k :].reshape(points, k, k)

    if {"A", "D"} & set(effects):
        kept = saved(res)

        def by_rows(at: np.ndarray, theta: np.ndarray):
            def run(part: pd.DataFrame) -> pd.DataFrame:
                matrices = np.stack(blocks.relatedness(blocks._rel(part), effects))
                r = part[[f"r_{y}" for y in ys]].to_numpy(float)
                out = [np.concatenate(([x], g, i.ravel())) for x, g, i in (_dense(matrices, r[:, o], t) for o, t in zip(at, theta, strict=True))]
                return pd.DataFrame({"i": np.arange(len(out) * size), "x": np.concatenate(out)})

            return summed(kept.groupBy("fid").applyInPandas(run, "i long, x double"), len(at))

        return by_rows
    families, v = packed(res, ys, effects), len(ys)

    def by_groups(at: np.ndarray, theta: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(at), size))
            for batch in batches:
                alike: dict[bytes, list] = {}
                for n, effect, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    alike.setdefault(effect, []).append((row[0], n, *row[1:]))
                for effect, rows in alike.items():
                    effect = np.frombuffer(effect, np.int32)
                    g = len(effect)
                    rows.sort(key=lambda r: r[:2])
                    step = max(1, HELD // max(1, 8 * g * g))
                    for first in range(0, len(rows), step):
                        some = rows[first : first + step]
                        kinds = {kind: i for i, kind in enumerate(dict.fromkeys(r[:2] for r in some))}
                        of = np.array([kinds[r[:2]] for r in some])
                        counts = np.stack([np.frombuffer(c).reshape(g, g) for c, _ in kinds])
                        u, rr = np.stack([np.frombuffer(r[2]).reshape(g, v) for r in some]), np.stack([np.frombuffer(r[3]) for r in some])
                        for i, (o, t) in enumerate(zip(at, theta, strict=True)):
                            x, slope, info = _grouped(np.array([n for _, n in kinds]), effect, counts, of, u[:, :, o], rr[:, o], t)
                            total[i] += np.concatenate(([x], slope, info.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "x"])

        return summed(families.select("n", "effect", "counts", "sums", "squares").mapInArrow(run, "i long, x double"), len(at))

    return by_groups


def maximised(evaluate: Evaluate, at: np.ndarray, start: np.ndarray, free: np.ndarray | None = None, rounds: int = 60, gain: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances of largest likelihood from ``start``, those that are not ``free`` held; values and informations there. A point stops when a step promises less than ``gain``."""
    theta = np.maximum(start, 1e-9 * start.sum(1, keepdims=True))
    floor = 1e-10 * theta.sum(1, keepdims=True)
    free = np.ones(theta.shape, bool) if free is None else free
    value, grad, info = evaluate(at, theta)
    damp, open_ = np.zeros(len(at)), np.ones(len(at), bool)
    for _ in range(rounds):
        step = np.zeros_like(theta)
        for i in np.flatnonzero(open_):
            own = np.flatnonzero(free[i])
            g, h = (grad[i] * theta[i])[own], (info[i] * np.outer(theta[i], theta[i]))[np.ix_(own, own)]
            h[np.diag_indices(len(own))] *= 1 + damp[i]
            h[np.diag_indices(len(own))] += 1e-12 * max(1.0, np.trace(h))
            step[i, own] = np.clip(np.linalg.solve(h, g), -2, 2)
            stuck = (theta[i, own] <= floor[i]) & (step[i, own] < 0)
            step[i, own[stuck]] = 0
            if not len(own) or abs(step[i, own] @ g) < gain:
                open_[i] = False
        todo = np.flatnonzero(open_)
        if not len(todo):
            break
        tried = np.maximum(theta[todo] * np.exp(step[todo]), floor[todo])
        x, g, h = evaluate(at[todo], tried)
        better = x >= value[todo] - 1e-12 * np.abs(value[todo])
        damp[todo] = np.where(better, damp[todo] / 10, np.maximum(damp[todo] * 10, 0.1))
        won = todo[better]
        theta[won], value[won], grad[won], info[won] = tried[better], x[better], g[better], h[better]
        open_[todo[damp[todo] > 1e8]] = False
    return theta, value, info


def maximum_likelihood(res: DataFrame, ys: list[str], effects: tuple[str, ...], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variances (outcomes by effects, E last) of largest likelihood of the residuals ``r_<y>``, and the likelihoods. A component may end at nothing."""
    theta, value, _ = maximised(evaluator(res, ys, effects), np.arange(len(ys)), np.asarray(start, float))
    return theta, value


def profile_intervals(res: DataFrame, ys: list[str], effects: tuple[str, ...], best: np.ndarray, drop: float = DROP, rounds: int = 40) -> np.ndarray:
    """Ends of each component's interval, (outcomes, effects, 2): where the likelihood, maximised anew over the other components, is ``drop`` below its largest.

    All ends of all outcomes are sought at once. A lower end is 0 where even no variance keeps the likelihood within ``drop``.
    """
    evaluate = evaluator(res, ys, effects)
    v, k = best.shape
    theta, value, info = maximised(evaluate, np.arange(v), best)
    out = np.full((v, k, 2), np.nan)
    ends = [(o, c, side) for o in range(v) for c in range(k) for side in (0, 1)]
    at, comp, side = (np.array(x) for x in zip(*ends, strict=True))
    sign = np.where(side == 1, 1.0, -1.0)
    scale = np.array([1.96 * np.sqrt(max(np.linalg.pinv(info[o] * np.outer(theta[o], theta[o]))[c, c], 1e-8)) for o, c in zip(at, comp, strict=True)])
    held = theta[at].copy()
    free = np.ones(held.shape, bool)
    free[np.arange(len(at)), comp] = False
    base = np.log(theta[at, comp])
    least = np.log(1e-9 * theta[at].sum(1))
    inside, f_in = np.zeros(len(at)), np.full(len(at), -drop)
    outside, f_out = np.full(len(at), np.nan), np.full(len(at), np.nan)
    reach, done, last = np.minimum(scale, 1.5), np.zeros(len(at), bool), np.zeros(len(at), int)
    for _ in range(rounds):
        todo = np.flatnonzero(~done)
        if not len(todo):
            break
        known = np.isfinite(outside[todo])
        guess = np.where(known, inside[todo] - f_in[todo] * (outside[todo] - inside[todo]) / np.where(known, f_out[todo] - f_in[todo], 1.0), reach[todo])
        log = np.maximum(base[todo] + sign[todo] * guess, least[todo])
        points = held[todo].copy()
        points[np.arange(len(todo)), comp[todo]] = np.exp(log)
        points, x, _ = maximised(evaluate, at[todo], points, free[todo])
        held[todo] = points
        f = value[at[todo]] - x - drop
        for i, j in enumerate(todo):
            d = sign[j] * (log[i] - base[j])
            if abs(f[i]) < 1e-7 or (np.isfinite(outside[j]) and abs(outside[j] - inside[j]) < 1e-9):
                out[at[j], comp[j], side[j]], done[j] = np.exp(log[i]), True
            elif f[i] < 0 and side[j] == 0 and log[i] <= least[j]:
                out[at[j], comp[j], 0], done[j] = 0.0, True
            elif f[i] < 0:
                inside[j], f_in[j] = d, f[i]
                f_out[j] *= 0.5 if last[j] == -1 else 1.0  # the Illinois rule: an end that stays counts for less
                last[j] = -1
                reach[j] = max(2 * d, d + 1e-3) if np.isnan(outside[j]) else reach[j]
            else:
                outside[j], f_out[j] = d, f[i]
                f_in[j] *= 0.5 if last[j] == 1 else 1.0
                last[j] = 1
    return out
