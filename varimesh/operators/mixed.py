"""Mixed models with family (F), subject (S) and error (E) effects, and others.

Two rows share a family effect when their families are equal and a subject effect when their subjects are. Subjects lie within families. So every
sum over pairs of rows of one family is a difference of squared group sums, and the inverse covariance of a family has a closed form in group sums. Nothing of
the size of a family squared is ever built, and a family of any size costs no more than its rows.

For effects without such a form (genetic relatedness and shared parents, homes or pregnancies) a family is a block of its own; see :mod:`.blocks`.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linear import Fit, Gram, gram, nearest_spd, ols, residuals

EFFECTS = ("F", "S", "E")
#: Sums that one aggregate may hold as expressions.
MOST = 2000


def with_groups(df: DataFrame, effects: tuple[str, ...]) -> DataFrame:
    """Families and subjects as the effects ask for them: without S each family is one subject, without F each subject its own family."""
    if "S" not in effects:
        df = df.withColumn("iid", F.col("fid"))
    if "F" not in effects:
        df = df.withColumn("fid", F.col("iid"))
    return df


def nested(df: DataFrame) -> bool:
    """Whether every subject lies in one family."""
    return not df.groupBy("iid").agg(F.countDistinct("fid").alias("n")).where("n > 1").take(1)


def family_types(df: DataFrame) -> DataFrame:
    """``(fid, n_obs, n_subjects, shape)``: the sorted numbers of rows of a family's subjects."""
    per = df.groupBy("fid", "iid").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("fid").agg(F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("n_subjects"), F.array_sort(F.collect_list("n")).alias("shape"))


def type_ids(families: DataFrame) -> DataFrame:
    """``type_id`` for what :func:`family_types` gives: shapes numbered by the smallest family that has each, from 1."""
    seen = families.groupBy("shape").agg(F.min("fid").alias("first"))
    return families.join(F.broadcast(seen.select("shape", F.row_number().over(Window.orderBy("first")).alias("type_id"))), "shape")  # a row for each shape


def nnls_by_subsets(mm: np.ndarray, md: np.ndarray, dd: float) -> np.ndarray:
    """Non-negative least squares from normal equations: of all subsets of effects, solved and clipped at zero, the one with the least cost."""
    best, cost = np.zeros(len(md)), None
    for mask in product((0, 1), repeat=len(md)):
        use = np.flatnonzero(mask)
        b = np.zeros(len(md))
        if len(use):
            b[use] = np.linalg.pinv(mm[np.ix_(use, use)]) @ md[use]
        b = np.maximum(b, 0)
        c = dd - 2 * b @ md + b @ mm @ b
        if cost is None or c < cost - 1e-12 * max(1.0, abs(cost)):
            best, cost = b, c
    return best


@dataclass
class Moments:
    """Normal equations of the method of moments over pairs of rows in a family, for each outcome."""

    mm: np.ndarray
    md: np.ndarray
    dd: np.ndarray


def pair_moments(res: DataFrame, ys: list[str], sigma2: np.ndarray) -> Moments:
    """From residuals ``r_<y>`` with ``fid, iid``, by sums over subjects and then families: two shuffles of sums, none of pairs."""
    r = [F.col(f"`r_{y}`") for y in ys]
    sub = res.groupBy("fid", "iid").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(r)], *[F.sum(x * x).alias(f"q{k}") for k, x in enumerate(r)])
    fam = sub.groupBy("fid").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("ns2"),
        *[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(ys))], *[F.sum(F.col(f"s{k}") ** 2).alias(f"ss{k}") for k in range(len(ys))], *[F.sum(f"q{k}").alias(f"q{k}") for k in range(len(ys))],
    )
    c = [F.sum(F.col("n").cast("double") ** 2), F.sum(F.col("ns2").cast("double")), F.sum(F.col("n").cast("double"))]
    for k in range(len(ys)):
        c += [F.sum(F.col(f"s{k}") ** 2), F.sum(f"ss{k}"), F.sum(f"q{k}"), F.sum(F.col(f"q{k}") ** 2)]
    row = [float(x or 0) for x in fam.agg(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first()]
    a, s, e = row[:3]
    per = np.array(row[3:]).reshape(len(ys), 4)
    return Moments(np.array([[a, s, e], [s, s, e], [e, e, e]]), per[:, :3] / sigma2[:, None], per[:, 3] / sigma2**2)


def components(m: Moments, effects: tuple[str, ...], nonnegative: bool = True) -> np.ndarray:
    """Shares of the variance ``(outcomes, effects)`` in the order of ``effects``, which ends in E; clipped at zero and normed to one."""
    at = [EFFECTS.index(e) for e in effects]
    mm = m.mm[np.ix_(at, at)]
    out = np.zeros((len(m.md), len(at)))
    for k, d in enumerate(m.md[:, at]):
        free = np.linalg.pinv(mm) @ d
        b = nnls_by_subsets(mm, d, m.dd[k]) if nonnegative and (free < 0).any() else np.maximum(free, 0)
        out[k] = b / max(np.finfo(float).eps, b.sum())
    return out


def bins(shares: np.ndarray, n: int) -> np.ndarray:
    """The cell of each outcome on a grid over all shares but the last; 0 cells mean one for each outcome. nan goes to the middle cell."""
    if not n:
        return np.arange(len(shares))
    x = np.where(np.isfinite(shares[:, :-1]), shares[:, :-1], 0.5)
    cell = np.minimum(np.floor(np.clip(x, 0, 1) * n), n - 1).astype(int)
    return np.ravel_multi_index(cell.T, (n,) * cell.shape[1]) if cell.shape[1] else np.zeros(len(shares), int)


def _group_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per subject: rows and the sum of each column."""
    return df.groupBy("fid", "iid").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.col(f"`{c}`").cast("double")).alias(f"u{k}") for k, c in enumerate(columns)])


def weighted_grams(g: Gram, sums: DataFrame, shares: list[np.ndarray], outcomes: list[list[int]]) -> list[np.ndarray]:
    """For each bin of outcomes X'V⁻¹X, and beside it X'V⁻¹y of the bin's outcomes; V = share_F in a family + share_S in a subject + share_E on the diagonal.

    A subject's block is inverted by the Sherman-Morrison formula, then the family's shared part by the same. All bins are columns of one aggregate over
    families of group sums.
    """
    p = len(g.xs)
    inner, outer = [], []
    for b, ((f, s, e), own) in enumerate(zip(shares, outcomes, strict=True)):
        f, s, e = float(f), float(s), float(e)
        d = F.lit(e) + F.lit(s) * F.col("n")
        at = [*range(p), *(p + y for y in own)]
        inner += [F.sum(F.col("n") / d).alias(f"q{b}"), *[F.sum(F.col(f"u{k}") / d).alias(f"w{b}_{k}") for k in at]]
        k = F.lit(f) / (F.lit(1.0) + F.lit(f) * F.col(f"q{b}"))
        for i in range(p):
            for j in at[i:]:
                inner.append(F.sum(F.lit(s) / d * F.col(f"u{i}") * F.col(f"u{j}")).alias(f"c{b}_{i}_{j}"))
                outer.append(F.sum(F.col(f"c{b}_{i}_{j}") / F.lit(e) + k * F.col(f"w{b}_{i}") * F.col(f"w{b}_{j}")).alias(f"t{b}_{i}_{j}"))
    row = sums.groupBy("fid").agg(*inner).agg(*outer).first()
    out = []
    for b, ((_, _, e), own) in enumerate(zip(shares, outcomes, strict=True)):
        taken = lambda i, j: float(row[f"t{b}_{i}_{j}"] or 0)  # noqa: B023, E731
        xx = np.array([[g.xx[i, j] / e - taken(min(i, j), max(i, j)) for j in range(p)] for i in range(p)])
        out.append(np.concatenate((xx, np.array([[g.xy[i, y] / e - taken(i, p + y) for y in own] for i in range(p)])), 1))
    return out


def gls(df: DataFrame, g: Gram, shares: np.ndarray, sigma2: np.ndarray, n_bins: int = 20) -> tuple[Fit, np.ndarray]:
    """Generalised least squares, one weighting for each bin of outcomes at the bin's mean shares; the variance is that of ordinary residuals. One job for all bins.

    Where the bins' sums would be more expressions than a plan should hold, they are vectors instead, with the same result.
    """
    cell = bins(shares, n_bins)
    p = len(g.xs)
    owners = [np.flatnonzero(cell == b) for b in np.unique(cell)]
    if sum(p * (p + len(own)) for own in owners) > MOST:
        from .groups import nested_gls

        return nested_gls(df, g, ["S", "F"], EFFECTS, shares, sigma2, n_bins)
    # with no error share the covariance is singular, so a little of it stands in
    means = [m if m[-1] > 0 else m + np.array([0, 0, 1e-6]) for m in (shares[own].mean(axis=0) for own in owners)]
    beta, cov = np.zeros((p, len(g.ys))), np.zeros((len(g.ys), p, p))
    for own, m in zip(owners, weighted_grams(g, _group_sums(df, [*g.xs, *g.ys]), means, [o.tolist() for o in owners]), strict=True):
        inv = np.linalg.pinv(m[:, :p], hermitian=True)
        cov[own], _ = nearest_spd(inv)
        beta[:, own] = inv @ m[:, p:]
    return Fit(g.xs, g.ys, beta, cov, sigma2, g.n), cell


@dataclass
class MixedFit:
    ols: Fit
    gls: Fit
    shares: np.ndarray
    bins: np.ndarray
    effects: tuple[str, ...]

    def share_table(self, spark: SparkSession) -> DataFrame:
        rows = [(y, e, float(x)) for y, own in zip(self.gls.ys, self.shares, strict=True) for e, x in zip(self.effects, own, strict=True)]
        return spark.createDataFrame(rows, "y_id string, effect string, share double")


def three(shares: np.ndarray, effects: tuple[str, ...]) -> np.ndarray:
    """Shares in the order F, S, E, with zeros for effects left out."""
    out = np.zeros((len(shares), 3))
    for k, e in enumerate(effects):
        out[:, EFFECTS.index(e)] = shares[:, k]
    return out


def fit(df: DataFrame, xs: list[str], ys: list[str], effects: tuple[str, ...] = EFFECTS, n_bins: int = 20, nonnegative: bool = True, fixed: str = "GLS") -> MixedFit:
    """The whole model: ordinary fit, variance shares by moments, weighted fit. ``df`` has ``fid``, ``iid`` and the columns; E is moved last.

    ``df`` is read three times: once for the Gram matrix, once for residual sums, once for group sums.
    """
    effects = (*[e for e in effects if e != "E"], "E")
    df = with_groups(df, effects)
    g = gram(df, xs, ys)
    o = ols(g)
    m = pair_moments(residuals(df, o, ["fid", "iid"]), ys, o.sigma2)
    shares = components(m, effects, nonnegative)
    if fixed == "OLS":
        return MixedFit(o, o, shares, bins(shares, n_bins), effects)
    w, cell = gls(df, g, three(shares, effects), o.sigma2, n_bins)
    return MixedFit(o, w, shares, cell, effects)


def visit_moments(res: DataFrame, y: str, visit: str = "visit", parts: int | None = None) -> DataFrame:
    """Unstructured covariance: for each pair of visits, the pair sums of one family and of one subject, from group sums.

    ``(v1, v2, family_pairs, subject_pairs, family_sum, subject_sum)``; the diagonal holds all pairs at one visit, each row with itself included.
    Rows are dealt by subject once, to ``parts`` tasks if given, so a task's memory is set by its rows; a group's visits are then one short list.
    """
    rows = res.where(F.col("fid").isNotNull() & F.col(visit).isNotNull())
    rows = rows.repartition(parts, "fid", "iid") if parts else rows.repartition("fid", "iid")
    cell = rows.groupBy("fid", "iid", visit).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(f"`r_{y}`")).alias("s"))

    def paired(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
        lists = groups.groupBy(*keys).agg(F.collect_list(F.struct(F.col(visit).alias("visit"), "n", "s")).alias("v"))
        both = lists.select("v", F.explode("v").alias("a")).select("a", F.explode(F.filter("v", lambda b: F.col("a.visit") <= b.visit)).alias("b"))
        return both.groupBy(F.col("a.visit").alias("v1"), F.col("b.visit").alias("v2")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias(f"{name}_pairs"), F.sum(F.col("a.s") * F.col("b.s")).alias(f"{name}_sum"))

    family = cell.groupBy("fid", visit).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return paired(family, ["fid"], "family").join(paired(cell.where(F.col("iid").isNotNull()), ["fid", "iid"], "subject"), ["v1", "v2"], "left")


def scores(df: DataFrame, f: MixedFit, k: int) -> DataFrame:
    """Each family's score X'V⁻¹r of outcome ``k`` as ``(fid, s0, s1, ...)``, by the closed form; their weighted sums give any number of resamples."""
    y, xs = f.gls.ys[k], f.gls.terms
    share = three(f.shares, f.effects)
    a, s, e = map(float, share[f.bins == f.bins[k]].mean(axis=0) + np.array([0, 0, 1e-12]))
    df = with_groups(df, f.effects)
    r = residuals(df, f.ols, ["fid", "iid", *[f"`{x}`" for x in xs]])
    rk = F.col(f"`r_{y}`")
    sub = r.groupBy("fid", "iid").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(rk).alias("r"), *[F.sum(F.col(f"`{x}`")).alias(f"u{i}") for i, x in enumerate(xs)], *[F.sum(F.col(f"`{x}`") * rk).alias(f"x{i}") for i, x in enumerate(xs)])
    d = F.lit(e) + F.lit(s) * F.col("n")
    fam = sub.groupBy("fid").agg(
        F.sum(F.col("n") / d).alias("q"), F.sum(F.col("r") / d).alias("wr"),
        *[F.sum(F.col(f"u{i}") / d).alias(f"w{i}") for i in range(len(xs))],
        *[F.sum((F.col(f"x{i}") - F.lit(s) / d * F.col(f"u{i}") * F.col("r")) / F.lit(e)).alias(f"a{i}") for i in range(len(xs))],
    )
    shrink: Column = F.lit(a) / (F.lit(1.0) + F.lit(a) * F.col("q"))
    return fam.select("fid", *[(F.col(f"a{i}") - shrink * F.col(f"w{i}") * F.col("wr")).alias(f"s{i}") for i in range(len(xs))])
