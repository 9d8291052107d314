"""Resamples of array outcomes against the scalar path, and sums by keys that may be null."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varimesh.operators import array_resample, arrays, mixed, resample
from varimesh.plans import model, spec


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(11)
    n = 240
    fid = rng.integers(0, 40, n)
    rows = []
    for k, f in enumerate(fid):
        x = float(rng.normal())
        rows.append((int(f), int(f) * 10 + k % 3, k, 1.0, x, [float(v) for v in rng.normal(size=7) + 0.3 * x + rng.normal(size=7) * (f % 3)]))
    return spark.createDataFrame(rows, "fid long, iid long, eid long, one double, x double, a array<double>").repartition(5).cache()


@pytest.mark.parametrize(("effects", "n_bins", "null", "tile"), [(("F", "S", "E"), 20, True, 1 << 20), (("S", "E"), 0, False, 300), (("F", "E"), 20, True, 1)])
def test_equal_to_the_scalar_path(wide, monkeypatch, effects, n_bins, null, tile):
    monkeypatch.setattr(array_resample, "TILE", tile)
    fit = arrays.fit(wide, ["one", "x"], "a", 7, effects, n_bins)
    boot = array_resample.Bootstrap(wide, fit, "a", 25, seed=4, null=null)
    got = boot.table().toPandas().set_index(["y_id", "term", "perm_id"]).sort_index()
    assert len(got) == 26 * 14
    columns = wide.withColumns({f"y{k}": F.col("a")[k] for k in range(7)})
    top = np.zeros((25, 2))
    for k in range(7):
        want = resample.wild_bootstrap(columns, fit, k, 25, 4, null=null).toPandas().set_index(["term", "perm_id"]).sort_index()
        for term in ("one", "x"):
            own = got.loc[(f"y{k}", term)]
            assert own.beta.to_numpy() == pytest.approx(want.loc[term].beta.to_numpy(), rel=1e-6, abs=1e-9)
            assert own.z.to_numpy() == pytest.approx(want.loc[term].z.to_numpy(), rel=1e-6, abs=1e-9)
            i = ["one", "x"].index(term)
            top[:, i] = np.maximum(top[:, i], np.abs(own.z.to_numpy()[1:]))
    assert boot.largest() == pytest.approx(top)
    ranks = boot.significance().toPandas().set_index(["y_id", "term"])
    for (y, term), r in ranks.iterrows():
        z = np.abs(got.loc[(y, term)].z.to_numpy())
        assert r.observed == pytest.approx(z[0])
        assert r.logp == pytest.approx(-np.log10(((z[1:] > z[0]).sum() + 1) / 26))
        assert r.family_logp == pytest.approx(-np.log10(((top[:, ["one", "x"].index(term)] > z[0]).sum() + 1) / 26))


def test_sums_by_null_keys(spark):
    rows = [("a", "x", [1.0, 2.0]), (None, "x", [10.0, 0.0]), ("a", "x", [100.0, 0.5]), ("b", None, [1000.0, 1.0]), (None, "x", [7.0, 7.0]), (None, None, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "k string, l string, m array<double>")
    for parts in (1, 4):
        got = {(r.k, r.l): list(r.m) for r in arrays.combine(df.repartition(parts), ["k", "l"]).collect()}
        assert got == {("a", "x"): [101.0, 2.5], (None, "x"): [17.0, 7.0], ("b", None): [1000.0, 1.0], (None, None): [3.0, 3.0]}


def test_bounded_slices(wide, monkeypatch):
    want = arrays.fit(wide, ["one", "x"], "a", 7)
    assert want.gls.beta == pytest.approx(mixed.fit(wide.withColumns({f"y{k}": F.col("a")[k] for k in range(7)}), ["one", "x"], [f"y{k}" for k in range(7)]).gls.beta)
    import pyarrow as pa

    monkeypatch.setattr(arrays, "SLICE", 8 * 7 * 3)
    batch = pa.RecordBatch.from_arrays([pa.array([[1.0] * 7] * 10)], ["m"])
    assert [b.num_rows for b in arrays.sliced(iter([batch]), 0)] == [3, 3, 3, 1]


def test_job_with_resamples_of_arrays(wide):
    job = spec.from_dict({"params": {"dependent": {"name": ["a"]}, "random": ["F", "S", "E"], "fixed": {"vars": [{"name": "x", "type_var": "continuous"}]}}})
    job.n_perm, job.perm_kind = 10, "wildbootstrap"
    run = model.run(job, wide)
    assert run.resamples.count() == 11 * 14 and run.significance.count() == 14


def mahalanobis(z, keep):
    """Lengths of the rows of z, the observed one first, with the whole covariance of the others."""
    u, s, _ = np.linalg.svd(np.cov(z[1:].T))
    s = np.maximum(s, s[keep - 1])
    return np.einsum("bi,ij,bj->b", z, (u / s) @ u.T, z)


@pytest.mark.parametrize("keep", [2, 5, 7])
def test_multivariate_against_the_whole_covariance(wide, keep):
    fit = arrays.fit(wide, ["one", "x"], "a", 7)
    boot = array_resample.Bootstrap(wide, fit, "a", 30, seed=1)
    long = boot.table().where("term = 'x'").cache()
    wide_z = long.toPandas().pivot(index="perm_id", columns="y_id", values="z").sort_index().to_numpy()
    want = mahalanobis(wide_z, keep)
    for got in (boot.multivariate("x", keep), resample.multivariate(long, keep=keep)):
        rows = got.orderBy("perm_id").toPandas()
        assert rows.stat.to_numpy() == pytest.approx(want, rel=1e-6)
        assert rows.logp[0] == pytest.approx(-np.log10(((want[1:] >= want[0]).sum() + 1) / 30))


def test_multivariate_of_ten_thousand_outcomes(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 10_000)) + rng.normal(size=(40, 10_000))
    z[0] += 3
    df = spark.createDataFrame([(k, [float(x) for x in z[:, k]]) for k in range(10_000)], "y_id int, m array<double>").select("y_id", F.posexplode("m").alias("perm_id", "z"))
    got = resample.multivariate(df.select("y_id", F.col("perm_id").cast("long").alias("perm_id"), "z"), keep=6).orderBy("perm_id").toPandas().stat.to_numpy()
    centred = z[1:] - z[1:].mean(0)
    _, s, w = np.linalg.svd(centred, full_matrices=False)
    lead, along = s[:6] ** 2 / 38, z @ w[:6].T
    want = (along**2 / lead).sum(1) + ((z * z).sum(1) - (along**2).sum(1)) / lead[-1]
    assert got == pytest.approx(want, rel=1e-6)
