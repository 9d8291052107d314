"""Random effects without a closed form: each family is a block of its own, handled in one task by its size squared.

``relations`` lists, for each effect, when two rows of one family share it: ``F`` same family, ``S`` same subject, ``E`` same row, ``A`` the
relatedness of the two subjects (unknown: one half), ``D`` its square, and ``P``, ``M``, ``H``, ``T`` the same father, mother, home or
pregnancy. A null pregnancy is shared with nobody, not even with itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varimesh.functions.dist import mvn_logpdf

from .linear import Fit, nearest_spd

ID_OF = {"P": "father_id", "M": "mother_id", "H": "home_id", "T": "preg_id"}


def relatedness(block: pd.DataFrame, effects: tuple[str, ...]) -> list[np.ndarray]:
    """The matrix of each effect over the rows of one family; ``rel`` maps subjects to values where A or D is asked for."""
    n, iid = len(block), block["iid"].to_numpy()
    out = []
    for e in effects:
        if e == "F":
            m = np.ones((n, n))
        elif e == "S":
            m = (iid[:, None] == iid[None, :]).astype(float)
        elif e == "E":
            m = np.eye(n)
        elif e in ("A", "D"):
            known = {}
            for own, rel in zip(iid, block["rel"], strict=True):
                known.update({(own, other): x for other, x in (rel or [])} if rel is not None else {})
            m = np.array([[1.0 if a == b else known.get((a, b), known.get((b, a), 0.5)) for b in iid] for a in iid])
            m = np.where(np.isfinite(m), m, 0.5)
            m = m * m if e == "D" else m
        else:
            x = block[ID_OF[e]]
            m = (x.to_numpy()[:, None] == x.to_numpy()[None, :]) & (x.notna().to_numpy()[:, None] & x.notna().to_numpy()[None, :])
            m = m.astype(float)
        out.append(m)
    return out


def with_relatedness(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``rel``, each subject's list of ``(iid, rel)`` within its family, from pairs ``(iid_i, iid_j, rel)``."""
    members = df.select("fid", "iid").distinct()
    both = pairs.select("iid_i", "iid_j", "rel").union(pairs.select("iid_j", "iid_i", "rel"))
    near = both.join(members.withColumnRenamed("iid", "iid_i"), "iid_i").join(members.select(F.col("fid"), F.col("iid").alias("iid_j")), ["fid", "iid_j"])
    lists = near.groupBy("fid", F.col("iid_i").alias("iid")).agg(F.collect_list(F.struct(F.col("iid_j").alias("iid"), "rel")).alias("rel"))
    return df.join(lists, ["fid", "iid"], "left")


def _rel(block: pd.DataFrame) -> pd.DataFrame:
    if "rel" in block:
        block = block.assign(rel=[None if x is None else [(p["iid"], p["rel"]) for p in x] for x in block["rel"]])
    return block


def moments(res: DataFrame, ys: list[str], sigma2: np.ndarray, effects: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal equations over all pairs of rows in a family, summed over families."""
    k, v = len(effects), len(ys)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        m = np.stack([x.ravel() for x in relatedness(_rel(block), effects)])
        r = block[[f"r_{y}" for y in ys]].to_numpy(float)
        d = np.stack([np.outer(r[:, i], r[:, i]).ravel() for i in range(v)])
        flat = np.concatenate(((m @ m.T).ravel(), (d @ m.T).ravel(), (d * d).sum(1)))
        return pd.DataFrame({"i": np.arange(len(flat), dtype=np.int32), "x": flat})

    flat = np.zeros(k * k + v * k + v)
    for row in res.groupBy("fid").applyInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        flat[row["i"]] = row["x"]
    return flat[: k * k].reshape(k, k), flat[k * k : k * k + v * k].reshape(v, k) / sigma2[:, None], flat[k * k + v * k :] / sigma2**2


def _weighted(block: pd.DataFrame, effects: tuple[str, ...], share: np.ndarray) -> np.ndarray:
    v = sum(s * m for s, m in zip(share, relatedness(_rel(block), effects), strict=True))
    try:
        return np.linalg.inv(v) if np.linalg.cond(v) < 1e14 else np.linalg.pinv(v, hermitian=True)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(v, hermitian=True)


def gls(df: DataFrame, xs: list[str], ys: list[str], effects: tuple[str, ...], shares: np.ndarray, cells: np.ndarray, sigma2: np.ndarray, n: int) -> Fit:
    """Weighted least squares with each family's own inverse; one pass for all bins. ``df`` needs the columns the effects read."""
    p, groups = len(xs), {int(b): np.flatnonzero(cells == b) for b in np.unique(cells)}
    means = {b: shares[own].mean(axis=0) for b, own in groups.items()}

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, y = block[xs].to_numpy(float), block[ys].to_numpy(float)
        out = []
        for b, own in groups.items():
            w = _weighted(block, effects, means[b])
            out.append(np.concatenate(((x.T @ w @ x).ravel(), (x.T @ w @ y[:, own]).ravel())))
        flat = np.concatenate(out)
        return pd.DataFrame({"i": np.arange(len(flat), dtype=np.int32), "x": flat})

    size = sum(p * p + p * len(o) for o in groups.values())
    flat = np.zeros(size)
    for row in df.groupBy("fid").applyInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        flat[row["i"]] = row["x"]
    beta, cov, at = np.zeros((p, len(ys))), np.zeros((len(ys), p, p)), 0
    for own in groups.values():
        a = flat[at : at + p * p].reshape(p, p)
        b = flat[at + p * p : at + p * p + p * len(own)].reshape(p, len(own))
        at += p * p + p * len(own)
        inv = np.linalg.pinv(a, hermitian=True)
        beta[:, own], cov[own] = inv @ b, nearest_spd(inv)[0]
    return Fit(xs, ys, beta, cov, sigma2, n)


def log_likelihood(res: DataFrame, ys: list[str], effects: tuple[str, ...], variances: np.ndarray) -> np.ndarray:
    """Gaussian log-likelihood of residuals, summed over families; nan where a variance is negative. ``variances`` is (outcomes, effects)."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        m = relatedness(_rel(block), effects)
        got = [np.nan if (s < 0).any() else mvn_logpdf(block[f"r_{y}"].to_numpy(float), sum(a * b for a, b in zip(s, m, strict=True))) for y, s in zip(ys, variances, strict=True)]
        return pd.DataFrame({"i": np.arange(len(got), dtype=np.int32), "x": got})

    rows = res.groupBy("fid").applyInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.full(len(ys), np.nan)
    for r in rows:
        out[r["i"]] = np.nan if r["x"] is None else r["x"]
    return out


def sandwich(df: DataFrame, fit: Fit, k: int, keep: list[str] | None = None) -> np.ndarray:
    """Robust covariance of outcome ``k``: families' scores multiplied out and summed by plain aggregates, between the inverse Gram matrices."""
    from .linear import residuals

    xs, y = fit.terms, fit.ys[k]
    r = residuals(df, fit, ["fid", *[f"`{x}`" for x in xs]])
    fam = r.groupBy("fid").agg(*[F.sum(F.col(f"`{x}`") * F.col(f"`r_{y}`")).alias(f"s{i}") for i, x in enumerate(xs)])
    p = len(xs)
    row = fam.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(p)]).first()
    bread = fit.cov if fit.cov.ndim == 2 else fit.cov[k]
    return bread @ np.array(row, float).reshape(p, p) @ bread


def unstructured(cells: DataFrame, sigma2: float) -> tuple[list, dict[str, np.ndarray], np.ndarray]:
    """Covariance that differs between visits, from :func:`.mixed.visit_moments`: ``(visits, {F, S: matrices}, total)``.

    Each pair of visits has its own small regression on same-family and same-subject pairs: non-negative at one visit, free between two. The error is part of S at
    one visit. ``total`` is the mean product of a subject's residuals, over ``sigma2``. The table has a row for each pair of visits.
    """
    from .mixed import nnls_by_subsets

    rows = cells.collect()
    visits = sorted({r["v1"] for r in rows} | {r["v2"] for r in rows})
    at = {v: i for i, v in enumerate(visits)}
    k = len(visits)
    out, total = {"F": np.zeros((k, k)), "S": np.zeros((k, k))}, np.full((k, k), np.nan)
    for r in rows:
        i, j = at[r["v1"]], at[r["v2"]]
        nf, ns = float(r["family_pairs"]), float(r["subject_pairs"] or 0)
        md = np.array([r["family_sum"], r["subject_sum"] or 0.0]) / sigma2
        mm = np.array([[nf, ns], [ns, ns]])
        b = nnls_by_subsets(mm, md, float(md @ np.linalg.pinv(mm) @ md)) if i == j else np.linalg.pinv(mm) @ md
        for e, x in zip(("F", "S"), b, strict=True):
            out[e][i, j] = out[e][j, i] = x
        if ns:
            total[i, j] = total[j, i] = md[1] / ns
    return visits, out, total


def gls_unstructured(df: DataFrame, xs: list[str], y: str, visits: list, cov: dict[str, np.ndarray], sigma2: float, n: int, visit: str = "visit") -> Fit:
    """Weighted least squares of one outcome under a covariance that differs between visits; each family's matrix is made positive definite first."""
    at, p = {v: i for i, v in enumerate(visits)}, len(xs)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        v, iid = block[visit].map(at).to_numpy(), block["iid"].to_numpy()
        c = cov["F"][np.ix_(v, v)] + cov["S"][np.ix_(v, v)] * (iid[:, None] == iid[None, :])
        w = np.linalg.pinv(nearest_spd(c)[0], hermitian=True)
        x = block[xs].to_numpy(float)
        flat = np.concatenate(((x.T @ w @ x).ravel(), x.T @ w @ block[y].to_numpy(float)))
        return pd.DataFrame({"i": np.arange(len(flat), dtype=np.int32), "x": flat})

    flat = np.zeros(p * p + p)
    for r in df.groupBy("fid").applyInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        flat[r["i"]] = r["x"]
    c, _ = nearest_spd(np.linalg.pinv(flat[: p * p].reshape(p, p), hermitian=True))
    return Fit(xs, [y], (c @ flat[p * p :])[:, None], c, np.array([sigma2]), n)
