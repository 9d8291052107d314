"""Tail laws: values against known ones, parameters of drawn samples, and p-values past the resamples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varimesh.functions import dist
from varimesh.operators import resample, tails


def test_survival_functions():
    x = np.array([[0.1, 0.7, 2.0, 9.0, 40.0, 300.0]])
    for a in (0.3, 1.0, 4.5, 30.0):
        got = tails._gamma_nlsf(x, np.array([[a]]))[0]
        assert got == pytest.approx([-dist.gamma_logsf(v, a) for v in x[0]], rel=1e-9)
    for a, b in ((1.0, 1.0), (0.8, 3.5), (2.0, 40.0), (5.0, 0.5)):
        p = np.array([[1e-12, 1e-4, 0.03, 0.4, 0.6, 0.97]])
        got = np.exp(-tails._beta_nlcdf(np.log(p), np.array([[a]]), np.array([[b]])))[0]
        assert got == pytest.approx([dist.beta_cdf(v, a, b) for v in p[0]], rel=1e-7)


@pytest.mark.parametrize(("law", "draw", "survival"), [
    ("gamma", lambda r, n: r.gamma(1.7, 2.0, n), lambda x: math.exp(dist.gamma_logsf(x / 2.0, 1.7))),
    ("weibull", lambda r, n: 3.0 * r.weibull(1.4, n), lambda x: math.exp(-((x / 3.0) ** 1.4))),
    ("chi2", lambda r, n: r.chisquare(3, n), lambda x: math.exp(dist.gamma_logsf(x / 2, 1.5))),
    ("beta", lambda r, n: -np.log10(r.beta(0.9, 6.0, n)), lambda x: dist.beta_cdf(10.0**-x, 0.9, 6.0)),
    ("sidak", lambda r, n: -np.log10(r.beta(1.0, 25.0, n)), lambda x: dist.beta_cdf(10.0**-x, 1.0, 25.0)),
])
def test_recovery(spark, law, draw, survival):
    """The law behind resamples, quantiles of a hundred times as many draws, one fit for each key and one across keys; judged at and well past the largest resample."""
    rng = np.random.default_rng(6)
    values = {k: np.sort(draw(rng, 2_000_000))[50::100] for k in ("a", "b")}
    seen = {"a": float(np.quantile(values["a"], 0.5)), "b": float(1.3 * values["b"].max())}
    rows = [(k, 0, seen[k]) for k in values] + [(k, i + 1, float(v)) for k, x in values.items() for i, v in enumerate(x)]
    p = spark.createDataFrame(rows, "y_id string, perm_id long, z double").cache()
    for over in ([], ["y_id"]):
        got = {r.y_id: r.logp for r in tails.tail_p(p, ["y_id"], law=law, over=over, stat=F.col("z")).collect()}
        assert got["a"] == pytest.approx(-math.log10(survival(seen["a"])), abs=0.02)
        assert got["b"] == pytest.approx(-math.log10(survival(seen["b"])), rel=0.12)


def test_what_cannot_be_fitted(spark):
    rows = [("flat", 0, 1.0), ("past", 0, 9.0), ("none", 0, 2.0)] + [(k, i, 1.0) for k in ("flat", "past") for i in range(1, 30)] + [("past", 40, float("nan")), ("past", 41, None)]
    p = spark.createDataFrame(rows, "term string, perm_id long, z double")
    got = {r.term: r.logp for r in tails.tail_p(p, ["term"]).collect()}
    assert set(got) == {"flat", "past", "none"} and got["none"] is None and got["past"] is None
    with pytest.raises(ValueError):
        tails.tail_p(p, ["term"], law="normal")


def test_agrees_with_ranks_inside(spark):
    z = np.random.default_rng(2).normal(size=4000)
    p = spark.createDataFrame([("t", 0, 1.2)] + [("t", i + 1, float(v)) for i, v in enumerate(z)], "term string, perm_id long, z double")
    own = resample.rank_p(p, ["term"]).first().logp
    assert tails.tail_p(p, ["term"]).first().logp == pytest.approx(own, abs=0.02)
