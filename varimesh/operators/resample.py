"""Resampling inference: the wild bootstrap over families, rank and family-wise p-values, mediation, and multivariate statistics.

With the covariance held at the observed fit, a resample only reweights families, so its estimate is a weighted sum of the families'
scores. Weights are drawn from a hash of seed, resample and family: they do not depend on the order of rows or on partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varimesh.functions.dist import _column, chi2_log10p_col, gamma_fit, gamma_logsf, norm_ppf

from .mixed import MixedFit, scores


def _uniform(keys: np.ndarray, perms: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) from hashed families and resample numbers, one row for each family."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + (perms.astype(np.uint64) + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


def weights(keys: np.ndarray, perms: np.ndarray, seed: int, kind: str = "normal") -> np.ndarray:
    """Standard normal weights (the pair of two uniform draws), or random signs."""
    u = _uniform(keys, perms, seed)
    if kind == "rademacher":
        return np.where(u < 0.5, -1.0, 1.0)
    if kind != "normal":
        raise ValueError(f"unknown weights {kind}")
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniform(keys, perms, seed + 0x5BD1))


def wild_bootstrap(df: DataFrame, fit: MixedFit, k: int, perms: int, seed: int = 0, kind: str = "normal", null: bool = True) -> DataFrame:
    """``(perm_id, term, beta, se, z)`` of outcome ``k``: resample 0 is the observed fit. Standard errors stay at the observed fit.

    Each batch of families is one product of weights and scores, so what is shuffled is a partial sum for each resample and term.
    """
    spark, xs = df.sparkSession, fit.gls.terms
    p = len(xs)
    s = scores(df, fit, k)
    s = s.select(F.xxhash64("fid").alias("key"), *[F.col(f"s{i}") for i in range(p)])
    every = np.arange(1, perms + 1)

    def run(batches):
        total = np.zeros((perms, p))
        for b in batches:
            if b.num_rows:
                w = weights(b.column(0).to_numpy().view(np.uint64), every, seed, kind)
                total += w.T @ np.stack([b.column(i + 1).to_numpy() for i in range(p)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(every, p)), pa.array(np.tile(np.arange(p), perms)), pa.array(total.ravel())], ["perm_id", "i", "s"])

    sums = s.mapInArrow(run, "perm_id long, i long, s double").groupBy("perm_id", "i").agg(F.sum("s").alias("s"))
    cov = fit.gls.cov if fit.gls.cov.ndim == 2 else fit.gls.cov[k]
    se = np.sqrt(np.diag(fit.gls.covariance(k)))
    rows = [(i, j, float(cov[j, i]), xs[j], float(se[j]), float(fit.gls.beta[j, k])) for i in range(p) for j in range(p)]
    matrix = spark.createDataFrame(rows, "i long, j int, c double, term string, se double, observed double")
    base = F.col("observed") if not null else F.lit(0.0)
    out = sums.join(F.broadcast(matrix), "i").groupBy("perm_id", "term", "se", "observed").agg(F.sum(F.col("c") * F.col("s")).alias("d"))
    out = out.select("perm_id", "term", (base + F.col("d")).alias("beta"), "se")
    seen = matrix.where("i = 0").select(F.lit(0).cast("long").alias("perm_id"), "term", F.col("observed").alias("beta"), "se")
    return seen.unionByName(out).withColumn("z", F.col("beta") / F.col("se"))


def rank_p(perms: DataFrame, keys: list[str], value: str = "z", two_sided: bool = True) -> DataFrame:
    """``keys, observed, logp``: -log10 of the observed statistic's rank among all; on ties the observed one comes first."""
    stat: Column = F.abs(value) if two_sided else F.col(value)
    seen = perms.where("perm_id = 0").select(*keys, stat.alias("observed"))
    rest = perms.where("perm_id > 0").join(F.broadcast(seen), keys)
    out = rest.groupBy(*keys, "observed").agg(F.sum((stat > F.col("observed")).cast("long")).alias("above"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "observed", (-F.log10((F.col("above") + 1) / (F.col("n") + 1))).alias("logp"))


def family_wise_p(perms: DataFrame, over: list[str], keys: list[str], value: str = "z") -> DataFrame:
    """The same against the largest statistic over all outcomes in each resample; ``over`` are the keys that stay apart."""
    top = perms.where("perm_id > 0").groupBy(*over, "perm_id").agg(F.max(F.abs(value)).alias("top"))
    seen = perms.where("perm_id = 0").select(*keys, F.abs(value).alias("observed"))
    if over:
        both = seen.join(top, over)
        out = both.groupBy(*keys, "observed").agg(F.sum((F.col("top") > F.col("observed")).cast("long")).alias("above"), F.count(F.lit(1)).alias("n"))
    else:  # one number for each resample, as literals
        tops = [float(r["top"]) for r in top.select("top").collect()]
        above = F.size(F.filter(F.lit(tops), lambda x: x > F.col("observed")))
        out = seen.select(*keys, "observed", above.alias("above"), F.lit(len(tops)).alias("n"))
    return out.select(*keys, "observed", (-F.log10((F.col("above") + 1) / (F.col("n") + 1))).alias("logp"))


def tail_p(perms: DataFrame, keys: list[str], value: str = "z", quantile: float = 0.95, law: str = "gamma") -> DataFrame:
    """p-values beyond the resamples' range: a law fitted from the moments of the squared statistics continues the empirical tail.

    ``gamma`` and ``extreme`` (Gumbel) are fitted to all of them, ``chi2`` with the mean as its degrees of freedom, and ``pareto``, the generalised one, to what
    exceeds the ``quantile``. Where a law has nothing to say (no spread, a single value beyond the quantile, past the end of a bounded tail) the rank's p-value stands.
    """
    x = F.col(value) ** 2
    seen = perms.where("perm_id = 0").select(*keys, x.alias("observed"))
    rest = perms.where("perm_id > 0").select(*keys, x.alias("x"))
    fit = rest.groupBy(*keys).agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.percentile("x", F.lit(quantile)).alias("cut"), F.count("x").alias("n"))
    rows = fit.join(seen, keys)

    def logp(m, v, obs):
        return [-gamma_logsf(o / (b / a), a * a / b) / np.log(10) for a, b, o in zip(m, v, obs, strict=True)]

    m, v, o, cut = (F.col(c) for c in ("m", "v", "observed", "cut"))
    if law == "gamma":
        rows = rows.withColumn("tail", _column(logp, m, v, o))
    elif law == "chi2":
        rows = rows.withColumn("tail", chi2_log10p_col(o, m))
    elif law == "extreme":
        scale = F.sqrt(F.nullif(v, F.lit(0.0)) * 6) / np.pi
        rows = rows.withColumn("tail", -F.log10(-F.expm1(-F.exp(-(o - (m - scale * np.euler_gamma)) / scale))))
    elif law == "pareto":
        over = rest.join(fit, keys).where(F.col("x") > cut).groupBy(*keys).agg(F.avg(F.col("x") - cut).alias("em"), F.var_samp(F.col("x") - cut).alias("ev"), F.count("x").alias("above"))
        rows = rows.join(over, keys, "left")
        em, ev = F.col("em"), F.when(F.col("ev") > 0, F.col("ev"))
        shape, scale = (F.lit(1.0) - em * em / ev) / 2, em * (em * em / ev + 1) / 2
        left = F.lit(1.0) + shape * (o - cut) / scale  # not above 0 beyond the end of a bounded tail, where the law says nothing
        sf = F.when(F.abs(shape) > 1e-12, left ** (F.lit(-1.0) / F.nullif(shape, F.lit(0.0)))).otherwise(F.exp(-(o - cut) / scale))
        known = (F.col("above") > 1) & (left > 0)
        rows = rows.withColumn("tail", F.when(known & (sf > 0), -F.log10(F.col("above") / F.col("n") * sf)))
    else:
        raise ValueError(f"unknown law {law}")
    own = rank_p(perms, keys, value).select(*keys, "logp")
    return rows.join(own, keys).select(*keys, F.when(o > cut, F.coalesce("tail", "logp")).otherwise(F.col("logp")).alias("logp"))


def sidak(p_log: Column, tests: int) -> Column:
    """-log10 p for the smallest of so many independent tests."""
    return -F.log10(-F.expm1(F.log1p(-F.pow(F.lit(10.0), -p_log)) * F.lit(float(tests))))


def mediation(full: DataFrame, reduced: DataFrame, term: str, level: float = 0.05) -> dict:
    """Sobel's test from resamples of two models that share their weights: the difference of one term's estimates, its error over resamples, and intervals."""
    both = full.where(F.col("term") == term).select("perm_id", F.col("beta").alias("f")).join(reduced.where(F.col("term") == term).select("perm_id", F.col("beta").alias("r")), "perm_id")
    d = both.select("perm_id", (F.col("r") - F.col("f")).alias("d"))
    seen = d.where("perm_id = 0").first()["d"]
    rest = d.where("perm_id > 0")
    row = rest.agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.percentile("d", F.lit(level / 2)).alias("lo"), F.percentile("d", F.lit(1 - level / 2)).alias("hi")).first()
    t = seen / row["s"]
    z = float(norm_ppf(1 - level / 2))
    squares = np.array([((r["d"] - row["m"]) / row["s"]) ** 2 for r in rest.select("d").collect()])  # one number for each resample
    shape, scale = gamma_fit(squares)
    return {"estimate": seen, "se": row["s"], "t": t, "normal": (seen - z * row["s"], seen + z * row["s"]), "percentile": (row["lo"], row["hi"]), "logp": float(-gamma_logsf((t - row["m"] / row["s"]) ** 2 / scale, shape) / np.log(10))}


def lengths(h: np.ndarray, keep: int | None, outcomes: int) -> np.ndarray:
    """Squared Mahalanobis lengths of all resamples, the observed one first, from the products of their statistics over outcomes.

    The covariance is that of the resamples; its singular values beyond the ``keep``-th, those of directions that no resample takes among them, count as large as that one. So the leading
    directions, which the products give, are enough, and no matrix of outcomes by outcomes is made.
    """
    n = len(h) - 1
    middle = h[1:, 1:] - h[1:, 1:].mean(0) - h[1:, 1:].mean(1)[:, None] + h[1:, 1:].mean()
    value, vector = np.linalg.eigh((middle + middle.T) / 2)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(keep or outcomes, outcomes, int((value > 1e-12 * max(value[0], 1e-300)).sum()))
    if not k:
        return np.full(n + 1, np.nan)
    cross = h[1:] - h[1:].mean(0)
    along = (vector[:, :k].T @ cross) ** 2 / value[:k, None]
    spread = value[:k] / (n - 1)
    return (along / spread[:, None]).sum(0) + np.maximum(np.diag(h) - along.sum(0), 0) / spread[-1]


def multivariate(perms: DataFrame, outcomes: list[str] | None = None, keep: int | None = None) -> DataFrame:
    """``(perm_id, stat, logp)``: the Mahalanobis length of each resample's Z values under their covariance over resamples, for any number of outcomes.

    ``perms`` has ``perm_id`` from 0, ``y_id`` and ``z``. An outcome's values over resamples are one vector, and each task adds up its outcomes' products, resamples by resamples: that matrix, a
    number for each pair of resamples, is all that is moved. A missing value counts as 0.
    """
    from .arrays import _matrix, combine, lists, sliced

    if outcomes is not None:
        perms = perms.where(F.col("y_id").isin(outcomes))
    n = perms.agg(F.max("perm_id")).first()[0]
    if n is None:
        return perms.sparkSession.createDataFrame([], "perm_id long, stat double, logp double")
    vectors = perms.groupBy("y_id").agg(F.collect_list(F.struct("perm_id", "z")).alias("c"))  # a number for each resample

    def products(batches):
        h, seen = np.zeros((n + 1, n + 1)), 0
        for batch in batches:
            m = np.zeros((batch.num_rows, n + 1))
            for k, c in enumerate(batch.column(0)):
                m[k, c.values.field("perm_id").to_numpy()] = np.nan_to_num(c.values.field("z").to_numpy(zero_copy_only=False).astype(float))
            h += m.T @ m
            seen += batch.num_rows
        if seen:
            step = max(1, (1 << 20) // (n + 1))
            for at in range(0, n + 1, step):
                own = h[at : at + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(own))), lists(np.concatenate((own, np.full((len(own), 1), seen)), 1))], ["i", "m"])

    h, v = np.zeros((n + 1, n + 1)), 0
    for batch in sliced(iter(combine(vectors.select("c").mapInArrow(products, "i long, m array<double>"), ["i"]).toArrow().to_batches()), 1):
        m = _matrix(batch.column(1), batch.num_rows)
        h[batch.column(0).to_numpy()], v = m[:, :-1], int(m[0, -1])
    return length_table(perms.sparkSession, lengths(h, keep, v))


def length_table(spark, stat: np.ndarray) -> DataFrame:
    """``(perm_id, stat, logp)``, with the observed one's -log10 p among all resamples."""
    n = len(stat) - 1
    logp = float(-np.log10(((stat[1:] >= stat[0]).sum() + 1) / n))
    return spark.createDataFrame([(k, float(x), logp) for k, x in enumerate(stat)], "perm_id long, stat double, logp double")


def enhance(stats: DataFrame, edges: DataFrame, steps: int = 100, e: float = 0.5, h: float = 2.0) -> DataFrame:
    """Threshold-free cluster enhancement of maps ``(map_id, pos, value[, area])`` over a graph ``(a, b)`` of neighbouring places.

    All steps of all maps are clustered at once: nodes are (map, step, place), linked where both ends reach the step. A node's cluster extent is a
    grouped sum of its areas (1 where there is no ``area``).
    """
    from .graph import components

    if "area" not in stats.columns:
        stats = stats.withColumn("area", F.lit(1.0))
    top = stats.groupBy("map_id").agg(F.max(F.abs("value")).alias("top"))
    x = stats.join(top, "map_id").where("top > 0").withColumn("dh", F.col("top") / steps)
    x = x.withColumn("reach", F.least(F.floor(F.abs("value") / F.col("dh") + F.lit(1e-9)), F.lit(steps)).cast("int")).where("reach > 0")
    node = lambda p, s: F.xxhash64("map_id", F.col(p), F.col(s))
    ends = edges.join(x.select("map_id", F.col("pos").alias("a"), F.col("reach").alias("ra")), "a").join(x.select("map_id", F.col("pos").alias("b"), F.col("reach").alias("rb")), ["map_id", "b"])
    ends = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.least("ra", "rb"))))
    label = components(ends.select(node("a", "step").alias("u"), node("b", "step").alias("v")), "u", "v")
    nodes = x.select("map_id", "pos", "value", "area", "dh", F.explode(F.sequence(F.lit(1), F.col("reach"))).alias("step")).withColumn("node", node("pos", "step"))
    nodes = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    extent = nodes.groupBy("component").agg(F.sum("area").alias("extent"))
    part = F.col("extent") ** e * (F.col("step") * F.col("dh")) ** h * F.col("dh")
    made = nodes.join(extent, "component").groupBy("map_id", "pos").agg((F.sum(part)).alias("tfce"))
    return stats.select("map_id", "pos", "value").join(made, ["map_id", "pos"], "left").select("map_id", "pos", (F.signum("value") * F.coalesce("tfce", F.lit(0.0))).alias("tfce"))
