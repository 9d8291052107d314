"""Likelihood of variance components against dense formulas and a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varimesh.functions import dist
from varimesh.operators import blocks, likelihood
from varimesh.plans import model, spec

EFFECTS = ("F", "S", "H", "E")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    n, rows = 300, []
    f = np.sort(rng.integers(0, 50, n))
    s, h = f * 10 + rng.integers(0, 3, n), rng.integers(0, 2, n)
    fe, se, he = rng.normal(size=50) * 0.7, rng.normal(size=600) * 0.6, rng.normal(size=(50, 2)) * 0.5
    r = fe[f] + se[s] + he[f, h] + rng.normal(size=n)
    q = rng.normal(size=n) + 0.3 * fe[f]
    for k in range(n):
        rows.append((int(f[k]), int(s[k]), None if k % 17 == 0 else int(h[k]), float(r[k]), float(q[k])))
    return spark.createDataFrame(rows, "fid long, iid long, home_id long, r_y double, r_z double").cache(), rows


def dense(rows, theta, which):
    """Log-likelihood with the whole covariance of each family."""
    total = 0.0
    for fid in sorted({r[0] for r in rows}):
        part = [r for r in rows if r[0] == fid]
        s, h = np.array([r[1] for r in part]), np.array([-1 if r[2] is None else r[2] for r in part])
        v = theta[0] + theta[1] * (s[:, None] == s) + theta[2] * ((h[:, None] == h) & (h >= 0)) + theta[3] * np.eye(len(part))
        total += dist.mvn_logpdf(np.array([r[which] for r in part]), v)
    return total


def search(rows, start, which, held=None):
    """A plain search: one coordinate after the other on a logarithmic scale, finer and finer."""
    theta = np.maximum(np.array(start, float), 1e-7)
    best, step = dense(rows, theta, which), 0.5
    while step > 2e-5:
        moved = False
        for k in range(4):
            for sign in (1, -1):
                if k != held:
                    t = theta.copy()
                    t[k] *= np.exp(sign * step)
                    if t[k] > 1e-9 and (x := dense(rows, t, which)) > best + 1e-12:
                        theta, best, moved = t, x, True
        step = step if moved else step / 2
    return theta, best


def test_values_gradients_and_information(data):
    df, rows = data
    evaluate = likelihood.evaluator(df, ["y", "z"], EFFECTS)
    at, theta = np.array([0, 1, 0]), np.array([[0.4, 0.3, 0.2, 1.0], [0.1, 0.05, 0.2, 0.9], [1.0, 1e-6, 0.5, 0.7]])
    value, grad, info = evaluate(at, theta)
    other = likelihood.evaluator(df.withColumn("rel", F.lit(None).cast("array<struct<iid:long,rel:double>>")), ["y", "z"], ("F", "A", "E"))
    for i in range(3):
        assert value[i] == pytest.approx(dense(rows, theta[i], 3 + at[i]))
        for k in range(4):
            d = np.zeros(4)
            d[k] = 1e-5 * theta[i, k]
            assert grad[i, k] == pytest.approx((dense(rows, theta[i] + d, 3 + at[i]) - dense(rows, theta[i] - d, 3 + at[i])) / (2 * d[k]), rel=1e-3, abs=1e-3)
    blocks_value = blocks.log_likelihood(df, ["y"], EFFECTS, theta[:1])
    assert value[0] == pytest.approx(blocks_value[0]) and np.linalg.eigvalsh(info[0]).min() > 0
    assert np.isfinite(other(np.array([0]), np.array([[0.4, 0.3, 1.0]]))[0]).all()


def test_maximum_and_profile_against_a_search(data):
    df, rows = data
    best, value = likelihood.maximum_likelihood(df, ["y", "z"], EFFECTS, np.full((2, 4), 0.5))
    want, top = search(rows, best[0] * [1.3, 0.8, 1.2, 0.9], 3)
    assert value[0] >= top - 1e-7 and best[0] == pytest.approx(want, rel=2e-3)
    ends = likelihood.profile_intervals(df, ["y"], EFFECTS, best[:1])
    for k in (0, 3):
        for side in (0, 1):
            theta = best[0].copy()
            theta[k] = ends[0, k, side]
            if theta[k] > 0:
                _, x = search(rows, theta, 3, held=k)
                assert value[0] - x == pytest.approx(likelihood.DROP, abs=2e-4)
    assert (ends[0, :, 0] <= best[0] + 1e-9).all() and (ends[0, :, 1] >= best[0] - 1e-9).all()


def test_job_with_likelihood_and_homes(spark, data):
    df, _ = data
    df = df.withColumns({"eid": F.monotonically_increasing_id(), "x": F.col("r_z"), "y": F.col("r_y") + 1})
    job = spec.from_dict({"params": {"dependent": {"name": ["y"]}, "random": ["F", "H", "E"], "advanced": {"type_random_est": "ML"}, "fixed": {"vars": [{"name": "x", "type_var": "continuous"}]}}})
    run = model.run(job, df)
    shares = {r.effect: r.share for r in run.shares.collect()}
    assert sum(shares.values()) == pytest.approx(1) and set(shares) == {"F", "H", "E"} and run.estimates.count() == 2


def test_families_of_unlike_counts_are_worked_out_at_once():
    """One call takes families of any counts; before, each kind of family needed a call of its own for every point."""
    rng = np.random.default_rng(4)
    effect, theta = np.array([0, 1, 1], np.int32), np.array([0.4, 0.3, 1.1])
    counts, n = [], []
    for _ in range(5):
        a, b = rng.integers(1, 9, 2)
        counts.append(np.array([[a + b, a, b], [a, a, 0], [b, 0, b]], float))
        n.append(float(a + b))
    counts, n, of = np.stack(counts), np.array(n), np.array([0, 1, 1, 2, 4])  # nobody is of kind 3
    u, rr = rng.normal(size=(5, 3)), rng.uniform(20, 30, 5)
    whole = likelihood._grouped(n, effect, counts, of, u, rr, theta)
    parts = [likelihood._grouped(n[d : d + 1], effect, counts[d : d + 1], np.array([0]), u[f : f + 1], rr[f : f + 1], theta) for f, d in enumerate(of)]
    for x, own in zip(whole, zip(*parts, strict=True), strict=True):
        assert np.allclose(x, sum(own))
