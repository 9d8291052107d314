"""A whole job: design, outcomes, fit, resamples, tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varimesh.functions import transforms as tr
from varimesh.operators import array_resample, arrays, blocks, groups, likelihood, linear, mixed, resample
from varimesh.operators.storage import saved
from varimesh.operators.tables import align, check_inputs, dropped, finite, varying

from .design import Design, build
from .spec import Spec


@dataclass
class Result:
    design: Design
    fit: mixed.MixedFit
    estimates: DataFrame
    shares: DataFrame
    resamples: DataFrame | None
    dropped: DataFrame | None
    constant: list[str]
    significance: DataFrame | None = None


def run(spec: Spec, data: DataFrame, outcomes: DataFrame | None = None, keys: list[str] | None = None, contrasts: list[list[float]] | None = None, pairs: DataFrame | None = None, seed: int = 0) -> Result:
    """Fit a spec to a table with ``fid``, ``iid``, ``eid`` and variables; outcomes may come in a table of their own with the same keys.

    Effects of shared groups go by group sums, relatedness (A and D, with its values in ``pairs``) by family blocks.
    """
    keys = keys or ["iid", "eid"]
    design = build(saved(data), spec)
    df, report = design.df, None
    if outcomes is not None:
        report = dropped(df, outcomes, keys)
        df = align(df.select("fid", *keys, *design.columns), outcomes.select(*keys, *spec.outcomes), keys)
    if spec.outcome_transform != "none":
        df = tr.scale(df, spec.outcomes, spec.outcome_transform)
        df = df.withColumns({y: F.col(f"{y}_{spec.outcome_transform}") for y in spec.outcomes})
    others = [c for c in ("father_id", "mother_id", "home_id", "preg_id", "rel") if c in df.columns]
    df = saved(df.select("fid", *dict.fromkeys(keys), *design.columns, *spec.outcomes, *others))
    if len(spec.outcomes) == 1 and df.schema[spec.outcomes[0]].dataType.typeName() == "array":
        return _run_arrays(spec, design, df, report, contrasts, seed)
    constant = check_inputs(df, design.columns, spec.outcomes)
    if spec.random_est == "MOM" and set(spec.random) <= {"F", "S", "E"}:
        fit = mixed.fit(df, design.columns, spec.outcomes, spec.random, spec.n_bins, fixed=spec.fixed)
    elif {"A", "D"} & set(spec.random):
        fit = fit_blocks(df if pairs is None else blocks.with_relatedness(df, pairs), design.columns, spec.outcomes, spec.random, spec.n_bins, spec.random_est)
    else:
        fit = groups.fit(df, design.columns, spec.outcomes, spec.random, spec.n_bins, spec.random_est)
    table = fit.gls.table(df.sparkSession, None if contrasts is None else np.array(contrasts, float))
    perms = None
    if spec.n_perm and spec.perm_kind != "none":
        null = spec.perm_kind != "wildbootstrap-nn"
        for k, y in enumerate(spec.outcomes):
            one = resample.wild_bootstrap(df, fit, k, spec.n_perm, seed, null=null).withColumn("y_id", F.lit(y))
            perms = one if perms is None else perms.unionByName(one)
    return Result(design, fit, table, fit.share_table(df.sparkSession), perms, report, constant)


def _run_arrays(spec: Spec, design: Design, df: DataFrame, report: DataFrame | None, contrasts: list[list[float]] | None, seed: int = 0) -> Result:
    """The same for very many outcomes in one array column; rows with a missing or infinite value in it are left out, as an image is whole or not."""
    if not set(spec.random) <= {"F", "S", "E"}:
        raise ValueError("array outcomes take effects F, S and E")
    y = spec.outcomes[0]
    df = saved(df.where(finite(y)))
    check_inputs(df, design.columns, [])
    width = df.agg(F.max(F.size(y))).first()[0]
    fit = arrays.fit(df, design.columns, y, width, spec.random, spec.n_bins)
    still = [f"y{r['pos']}" for r in varying(df, y).where("not in_mask").collect()]
    table = fit.gls.table(df.sparkSession, None if contrasts is None else np.array(contrasts, float))
    perms = significance = None
    if spec.n_perm and spec.perm_kind != "none":
        boot = array_resample.Bootstrap(df, fit, y, spec.n_perm, seed, null=spec.perm_kind != "wildbootstrap-nn")
        perms, significance = boot.table(), boot.significance()
    return Result(design, fit, table, fit.share_table(df.sparkSession), perms, report, still, significance)


def fit_blocks(df: DataFrame, xs: list[str], ys: list[str], effects: tuple[str, ...], n_bins: int = 20, random: str = "MOM") -> mixed.MixedFit:
    """The whole model with a dense block for each family, which A and D need."""
    effects = (*[e for e in effects if e != "E"], "E")
    g = linear.gram(df, xs, ys)
    o = linear.ols(g)
    extra = [c for c in ("father_id", "mother_id", "home_id", "preg_id", "rel") if c in df.columns]
    mm, md, dd = blocks.moments(linear.residuals(df, o, ["fid", "iid", *extra]), ys, o.sigma2, effects)
    shares = np.zeros((len(ys), len(effects)))
    for k in range(len(ys)):
        b = mixed.nnls_by_subsets(mm, md[k], dd[k])
        shares[k] = b / max(np.finfo(float).eps, b.sum())
    if random == "ML":
        best, _ = likelihood.maximum_likelihood(linear.residuals(df, o, ["fid", "iid", *extra]), ys, effects, (shares + 0.01) * o.sigma2[:, None])
        shares = best / best.sum(1, keepdims=True)
    cells = mixed.bins(shares, n_bins)
    w = blocks.gls(df, xs, ys, effects, shares, cells, o.sigma2, g.n)
    return mixed.MixedFit(o, w, shares, cells, effects)


def cross_validated_auc(df: DataFrame, xs: list[str], y: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``(fold, auc)`` of a linear score fitted on the other folds; folds are of whole families. One Gram matrix for each fold, and sums of the others."""
    from varimesh.operators.tables import auc, folds

    df = df.withColumn("fold", folds("fid", k, seed))
    by_fold = linear.grams(df, "fold", xs, [y])
    none = linear.Gram(xs, [y], np.zeros((len(xs), len(xs))), np.zeros((len(xs), 1)), np.zeros(1), 0)
    grams = [by_fold.get(i, none) for i in range(k)]
    score = None
    for i in range(k):
        rest = [g for j, g in enumerate(grams) if j != i]
        total = linear.Gram(xs, [y], sum(g.xx for g in rest), sum(g.xy for g in rest), sum(g.yy for g in rest), sum(g.n for g in rest))
        beta = linear.ols(total).beta[:, 0]
        own = sum((F.lit(float(b)) * F.col(f"`{x}`") for b, x in zip(beta, xs, strict=True)), F.lit(0.0))
        score = F.when(F.col("fold") == i, own) if score is None else score.when(F.col("fold") == i, own)
    return auc(df.withColumn("score", score), "score", y, ["fold"])


def synthesize(df: DataFrame, xs: list[str], beta: np.ndarray, variances: tuple[float, float, float], seed: int = 0) -> DataFrame:
    """Add outcomes ``y0, y1, ...`` with given effects and F, S, E variances; draws come from hashed keys, so they do not depend on partitions."""
    def normal(k: int, *cols: str):
        u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.lit(s), *[F.col(c) for c in cols]), F.lit(1 << 52)) + 0.5) / (1 << 52) for s in (0, 1)]
        return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * np.pi * u[1])

    made = {}
    for k in range(beta.shape[1]):
        fixed = sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta[:, k], xs, strict=True)), F.lit(0.0))
        f, s, e = (float(np.sqrt(v)) for v in variances)
        made[f"y{k}"] = fixed + f * normal(3 * k, "fid") + s * normal(3 * k + 1, "fid", "iid") + e * normal(3 * k + 2, "fid", "iid", "eid")
    return df.withColumns(made)
