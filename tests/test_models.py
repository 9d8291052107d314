"""Closed forms against dense formulas, effects without closed forms, resamples, and recovery of what generated data was made with."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varimesh.functions import dist, splines
from varimesh.operators import arrays, blocks, gwas, likelihood, linear, mixed, resample
from varimesh.plans import design, model, spec

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def data(spark):
    n = 300
    fid = np.sort(RNG.integers(0, 60, n))
    iid = fid * 10 + RNG.integers(0, 3, n)
    x = RNG.normal(size=n)
    y = 1 + 0.5 * x + RNG.normal(size=60)[fid] * 0.6 + RNG.normal(size=n) * 0.8
    z = -1 + 0.2 * x + RNG.normal(size=n)
    rows = [(int(f), int(i), k, 1.0, float(a), float(b), float(c)) for k, (f, i, a, b, c) in enumerate(zip(fid, iid, x, y, z, strict=True))]
    return spark.createDataFrame(rows, "fid long, iid long, eid long, one double, x double, y double, z double").cache(), (fid, iid, np.stack((np.ones(n), x), 1), np.stack((y, z), 1))


def dense(fid, iid, share):
    return share[0] * (fid[:, None] == fid) + share[1] * (iid[:, None] == iid) + share[2] * np.eye(len(fid))


def test_mixed_against_dense(data):
    df, (fid, iid, x, y) = data
    f = mixed.fit(df, ["one", "x"], ["y", "z"], n_bins=0)
    b = np.linalg.solve(x.T @ x, x.T @ y)
    r = y - x @ b
    s2 = (r * r).sum(0) / (len(y) - 2)
    assert f.ols.beta == pytest.approx(b) and f.ols.sigma2 == pytest.approx(s2)
    same = fid[:, None] == fid
    m = np.stack([same[same].astype(float), (iid[:, None] == iid)[same].astype(float), np.eye(len(fid))[same]], 1)
    for k in range(2):
        d = np.outer(r[:, k], r[:, k])[same] / s2[k]
        best = mixed.nnls_by_subsets(m.T @ m, m.T @ d, d @ d)
        assert f.shares[k] == pytest.approx(best / best.sum(), abs=1e-8)
        w = np.linalg.inv(dense(fid, iid, f.shares[k]))
        c = np.linalg.inv(x.T @ w @ x)
        assert f.gls.beta[:, k] == pytest.approx(c @ x.T @ w @ y[:, k]) and f.gls.covariance(k) == pytest.approx(c * s2[k])


def test_many_bins_as_vectors(data, monkeypatch):
    """Sums of bins as vectors give what they give as expressions."""
    df, _ = data
    want = [mixed.fit(df, ["one", "x"], ["y", "z"], e, n_bins=0) for e in (("F", "S", "E"), ("F", "E"))]
    monkeypatch.setattr(mixed, "MOST", 0)
    for w, e in zip(want, (("F", "S", "E"), ("F", "E")), strict=True):
        got = mixed.fit(df, ["one", "x"], ["y", "z"], e, n_bins=0)
        assert got.gls.beta == pytest.approx(w.gls.beta) and got.gls.cov == pytest.approx(w.gls.cov) and got.bins.tolist() == w.bins.tolist()


def test_blocks_equal_closed_form(data):
    df, _ = data
    f = mixed.fit(df, ["one", "x"], ["y", "z"])
    b = model.fit_blocks(df, ["one", "x"], ["y", "z"], ("F", "S", "E"))
    assert b.shares == pytest.approx(f.shares, abs=1e-8) and b.gls.beta == pytest.approx(f.gls.beta)


@pytest.mark.parametrize("effects", [("F", "E"), ("S", "E"), ("E",)])
def test_fewer_effects(data, effects):
    df, _ = data
    f = mixed.fit(df, ["one", "x"], ["y"], effects)
    assert f.shares.sum() == pytest.approx(1)
    if effects == ("E",):
        assert f.gls.beta == pytest.approx(f.ols.beta)


def test_shared_ids_and_relatedness(spark, data):
    df, _ = data
    df = df.withColumns({"home_id": F.col("fid"), "preg_id": F.lit(None).cast("long"), "mother_id": F.col("iid")})
    b = model.fit_blocks(df, ["one", "x"], ["y"], ("H", "M", "E"))
    f = mixed.fit(df, ["one", "x"], ["y"])
    assert b.shares == pytest.approx(f.shares, abs=1e-8)
    pairs = df.select(F.col("iid").alias("iid_i")).distinct().crossJoin(df.select(F.col("iid").alias("iid_j")).distinct()).where("iid_i < iid_j and floor(iid_i / 10) = floor(iid_j / 10)").withColumn("rel", F.lit(0.0))
    a = model.fit_blocks(blocks.with_relatedness(df, pairs), ["one", "x"], ["y"], ("A", "E"))
    s = model.fit_blocks(df, ["one", "x"], ["y"], ("S", "E"))
    assert a.shares == pytest.approx(s.shares, abs=1e-8)


def test_log_likelihood(data):
    df, (fid, iid, x, y) = data
    f = mixed.fit(df, ["one", "x"], ["y"])
    v = f.shares * f.ols.sigma2[:, None]
    got = blocks.log_likelihood(linear.residuals(df, f.ols, ["fid", "iid"]), ["y"], ("F", "S", "E"), v)
    r = y[:, 0] - x @ f.ols.beta[:, 0]
    assert got[0] == pytest.approx(dist.mvn_logpdf(r, dense(fid, iid, v[0])))
    best, value = likelihood.maximum_likelihood(linear.residuals(df, f.ols, ["fid", "iid"]), ["y"], ("F", "S", "E"), v[:1] + 0.01)
    assert value[0] >= got[0] and value[0] == pytest.approx(dist.mvn_logpdf(r, dense(fid, iid, best[0])))


def test_wild_bootstrap(data):
    df, (fid, iid, x, y) = data
    f = mixed.fit(df, ["one", "x"], ["y"], n_bins=0)
    p = resample.wild_bootstrap(df, f, 0, 400, seed=3).where("term = 'x'").toPandas()
    rest = p[p.perm_id > 0].beta
    assert len(rest) == 400 and abs(rest.mean()) < 3 * rest.std() / 20
    assert p[p.perm_id == 0].beta.iloc[0] == pytest.approx(f.gls.beta[1, 0])
    again = resample.wild_bootstrap(df.repartition(7), f, 0, 400, seed=3).where("term = 'x'").toPandas().set_index("perm_id").beta
    assert again.loc[17] == pytest.approx(p.set_index("perm_id").beta.loc[17])
    # families' scores are those of the dense covariance
    w = np.linalg.inv(dense(fid, iid, f.shares[0]))
    r = y[:, 0] - x @ f.ols.beta[:, 0]
    got = mixed.scores(df, f, 0).orderBy("fid").toPandas()
    total = x.T @ w @ r
    assert got[["s0", "s1"]].sum().to_numpy() == pytest.approx(total, abs=1e-6)


def test_ranks_mediation_multivariate_and_tails(spark, data):
    df, _ = data
    f = mixed.fit(df, ["one", "x"], ["y", "z"])
    p = resample.wild_bootstrap(df, f, 0, 200).withColumn("y_id", F.lit("y")).unionByName(resample.wild_bootstrap(df, f, 1, 200).withColumn("y_id", F.lit("z"))).where("term = 'x'").cache()
    r = resample.rank_p(p, ["y_id"]).toPandas()
    assert r.set_index("y_id").logp["y"] == pytest.approx(-np.log10(1 / 201))
    assert (resample.family_wise_p(p, [], ["y_id"]).toPandas().logp >= 0).all()
    assert resample.tail_p(p, ["y_id"]).count() == 2
    m = resample.multivariate(p, ["y", "z"]).toPandas()
    assert len(m) == 201 and (m.stat > 0).all()
    reduced = mixed.fit(df, ["x"], ["y"])
    s = resample.mediation(resample.wild_bootstrap(df, f, 0, 200, null=False), resample.wild_bootstrap(df, reduced, 0, 200, null=False), "x")
    assert s["se"] > 0 and s["normal"][0] < s["estimate"] < s["normal"][1]


def test_enhancement(spark):
    stats = spark.createDataFrame([("m", i, v) for i, v in enumerate([0.0, 2.0, 2.0, 0.0, 1.0])], "map_id string, pos int, value double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "a int, b int")
    got = {r["pos"]: r["tfce"] for r in resample.enhance(stats, edges, steps=4).collect()}
    heights = np.arange(1, 5) * 0.5
    assert got[1] == pytest.approx((np.sqrt(2) * heights**2 * 0.5).sum()) and got[4] == pytest.approx((heights[:2] ** 2 * 0.5).sum()) and got[0] == 0


def test_sandwich_and_rank(data):
    df, (fid, _, x, y) = data
    f = linear.ols(linear.gram(df, ["one", "x"], ["y"]))
    r = y[:, 0] - x @ f.beta[:, 0]
    s = np.array([(x * r[:, None])[fid == k].sum(0) for k in np.unique(fid)])
    b = np.linalg.inv(x.T @ x)
    assert blocks.sandwich(df, f, 0) == pytest.approx(b @ s.T @ s @ b)
    more = df.withColumn("twice", 2 * F.col("x"))
    assert len(linear.independent_columns(linear.gram(more, ["one", "x", "twice"], []).xx)) == 2
    assert linear.nearest_spd(np.array([[1.0, 2.0], [2.0, 1.0]]))[1]


def test_distributions():
    assert dist.norm_ppf([0.975])[0] == pytest.approx(1.959963985)
    assert dist.signed_log10p([-1.959963985])[0] == pytest.approx(np.log10(0.05), abs=1e-8)
    assert 350 < dist.signed_log10p([41.0])[0] < 380
    assert dist.chi2_log10sf([3.841458821], [1])[0] == pytest.approx(np.log10(0.05))
    assert dist.f_sf([4.0], [2], [10])[0] == pytest.approx(1.8**-5)
    assert dist.t_sf2([2.228138852], [10])[0] == pytest.approx(0.05)
    x = np.random.default_rng(0).gamma(2.5, 1.5, 20000)
    assert dist.gamma_fit(x) == pytest.approx((2.5, 1.5), rel=0.05)


def test_splines(spark):
    b = splines.basis((0.0, 10.0), [0, 2.5, 5, 7.5, 10], method="raw")
    full = splines.natural_cubic(np.array([0, 2.5, 5, 7.5, 10]), np.array([0, 2.5, 5, 7.5, 10]))
    assert full == pytest.approx(np.eye(5))
    assert splines.natural_cubic(np.linspace(-3, 13, 9), np.array([0, 2.5, 5, 7.5, 10])).sum(1) == pytest.approx(np.ones(9))
    df = spark.createDataFrame([(0.05,), (10.0,), (12.0,), (-1.0,)], "v double")
    got, names = splines.add_basis(df, "v", b)
    row = got.collect()
    assert row[0][names[0]] == pytest.approx((b.values[0, 0] + b.values[1, 0]) / 2)
    slope = (b.values[-1] - b.values[-2]) / (b.grid[-1] - b.grid[-2])
    assert row[2][names[3]] == pytest.approx(b.values[-1, 3] + 2 * slope[3])
    for kind in ("ns", "bs", "nsk"):
        assert np.isfinite(splines.basis((0.0, 1.0), [0.25, 0.5, 0.75], kind).values).all()
    curve = b.curve(np.ones(4), np.eye(4))
    assert len(curve) == 101 and curve[0][2] >= 0


def test_gwas_against_dense(spark, data):
    """Main effects and interactions against dense generalised least squares; small tiles, a missing dosage, a constant variant, all three laws."""
    df, (fid, iid, x, y) = data
    f = mixed.fit(df, ["one", "x"], ["y", "z"])
    subjects = np.unique(iid)
    g = RNG.integers(0, 3, (6, len(subjects))).astype(float)
    g[5] = 1
    rows = [(f"rs{k}", "1" if k < 4 else "X", k, int(i), None if (k, j) == (2, 3) else float(g[k, j])) for k in range(6) for j, i in enumerate(subjects)]
    long = spark.createDataFrame(rows, "snp_id string, chr string, bp long, iid long, dosage double")
    g[2, 3] = np.delete(g[2], 3).mean()
    got = gwas.gwas(long, df, f, rows_in_tile=60, variants_in_tile=2).toPandas().set_index(["snp_id", "y_id"])
    place = np.searchsorted(subjects, iid)
    share = f.shares[f.bins == f.bins[0]].mean(0)
    w = np.linalg.inv(dense(fid, iid, share))
    for k in range(5):
        a = np.concatenate((x, g[k][place][:, None]), 1).astype(float)
        inv = np.linalg.inv(a.T @ w @ a)
        beta = inv @ a.T @ w @ y[:, 0]
        assert got.loc[(f"rs{k}", "y")].beta == pytest.approx(beta[2])
        rest = y[:, 0] - a @ beta
        assert got.loc[(f"rs{k}", "y")].se == pytest.approx(np.sqrt(inv[2, 2] * rest @ rest / (len(x) - 3)))
    assert np.isnan(got.loc[("rs5", "y")].beta) and got.loc[("rs5", "y")].err_flag and not got.loc[("rs0", "z")].err_flag
    # the same from arrays in another order, with subjects that are not analysed and must not count for the mean
    order = RNG.permutation(len(subjects))
    short = [(f"rs{k}", "1" if k < 4 else "X", k, [None if (k, int(j)) == (2, 3) else int(g[k, j]) for j in order] + [2, 2, 0]) for k in range(6)]
    named = spark.createDataFrame([(int(subjects[j]), at) for at, j in enumerate(order)] + [(-1, len(order)), (-2, len(order) + 1)], "iid long, place long")
    for element in ("tinyint", "double"):
        variants = spark.createDataFrame(short, "snp_id string, chr string, bp long, dosages array<int>").withColumn("dosages", F.col("dosages").cast(f"array<{element}>"))
        other = gwas.gwas(variants, df, f, rows_in_tile=60, variants_in_tile=2, places=named).toPandas().set_index(["snp_id", "y_id"])
        assert len(other) == 12
        for key, row in got.iterrows():
            assert [other.loc[key, c] for c in ("beta", "se", "t", "logp")] == pytest.approx([row[c] for c in ("beta", "se", "t", "logp")], nan_ok=True)
            assert other.loc[key].err_flag == row.err_flag and other.loc[key].bp == row.bp
    nobody = gwas.gwas(long.unionByName(spark.createDataFrame([("rs2", "1", 2, -7, 2.0), ("rs2", "1", 2, -8, 2.0), ("rs9", None, None, -7, 1.0)], long.schema)), df, f).toPandas().set_index(["snp_id", "y_id"])
    assert nobody.loc[("rs2", "y")].beta == pytest.approx(got.loc[("rs2", "y")].beta) and nobody.loc[("rs9", "y")].err_flag
    both = gwas.gather([gwas.gwas(long, df, f, gwas.with_main(["x"], "one"), "t")])
    assert both.where("chr = 23").count() == 8
    a = np.concatenate((x, g[1][place][:, None] * x[:, [1, 0]]), 1)
    row = both.where("snp_id = 'rs1' and y_id = 'y'").orderBy("basis_id").collect()
    assert [r["beta"] for r in row] == pytest.approx(np.linalg.solve(a.T @ w @ a, a.T @ w @ y[:, 0])[2:])
    chi = gwas.gwas(long, df, f, test="chi").toPandas().set_index(["snp_id", "y_id"])
    assert chi.loc[("rs1", "y")].logp == pytest.approx(got.loc[("rs1", "y")].logp, rel=1e-6)


def test_array_outcomes_as_columns(spark, data):
    """A model of an array column is that of its places as columns, for each set of effects, bins or none; families lie across batches and tasks."""
    df, _ = data
    wide = df.withColumn("a", F.array("y", "z", F.col("y") + 2 * F.col("z"))).withColumn("y3", F.col("y") + 2 * F.col("z")).repartition(5)
    for effects, n_bins in ((("F", "S", "E"), 20), (("S", "E"), 0), (("F", "E"), 20)):
        want = mixed.fit(wide, ["one", "x"], ["y", "z", "y3"], effects, n_bins)
        got = arrays.fit(wide, ["one", "x"], "a", 3, effects, n_bins)
        assert got.shares == pytest.approx(want.shares) and got.bins.tolist() == want.bins.tolist()
        assert got.gls.beta == pytest.approx(want.gls.beta) and got.gls.cov == pytest.approx(want.gls.cov)
    job = spec.from_dict({"params": {"dependent": {"name": ["a"]}, "random": ["F", "S", "E"], "fixed": {"vars": [{"name": "x", "type_var": "continuous"}]}}})
    run = model.run(job, wide.withColumn("eid", F.monotonically_increasing_id()))
    assert run.estimates.count() == 6 and run.constant == []


def test_design_names_and_order(spark):
    rows = [("a", 1.0, 5.0, "u"), ("a", 2.0, 6.0, "v"), ("b", 3.0, None, "v"), ("b", 4.0, 8.0, "v"), ("c", 5.0, 9.0, "u"), ("c", 6.0, 11.0, "v")]
    df = spark.createDataFrame([(i, i, k, *r) for k, (i, *r) in enumerate(rows)], "fid string, iid string, eid int, age double, w double, site string")
    job = spec.from_json('{"params": {"fixed": {"vars": [{"name": "age", "transform": "delta"}, {"name": "w", "transform": "center"}, {"name": "site", "type_var": "categorical"}], "interaction": [["w", "site"]]}, "dependent": {"name": ["w"]}}}')
    d = design.build(df, job, drop_dependent=False)
    assert d.columns == ["w_center", "age_baseline", "age_delta", "site_u", "w_center__site_u", "Intercept"]
    assert d.df.count() == 5 and {r["variable"]: r["n_missing"] for r in d.missing.collect()}["w"] == 1
    with pytest.raises(ValueError):
        spec.Spec([spec.Variable("a"), spec.Variable("a")])


def test_recovery(spark):
    base = spark.range(6000).select((F.col("id") / 12).cast("long").alias("fid"), (F.col("id") / 4).cast("long").alias("iid"), F.col("id").alias("eid"), F.lit(1.0).alias("one"), F.rand(3).alias("x"))
    made = model.synthesize(base, ["one", "x"], np.array([[1.0], [2.0]]), (0.3, 0.2, 0.5), seed=1)
    f = mixed.fit(made, ["one", "x"], ["y0"])
    assert f.shares[0] == pytest.approx([0.3, 0.2, 0.5], abs=0.06) and f.gls.beta[1, 0] == pytest.approx(2.0, abs=0.15)


def test_unstructured(data):
    """The same covariance at every visit pair comes back as the plain model's weighting."""
    df, (fid, iid, x, y) = data
    df = df.withColumn("visit", F.col("eid") % 2)
    o = linear.ols(linear.gram(df, ["one", "x"], ["y"]))
    cells = mixed.visit_moments(linear.residuals(df, o, ["fid", "iid", "visit"]), "y")
    visits, cov, total = blocks.unstructured(cells, float(o.sigma2[0]))
    r, v = y[:, 0] - x @ o.beta[:, 0], np.arange(len(fid)) % 2
    same = (iid[:, None] == iid) & (v[:, None] == 0) & (v == 1)
    assert visits == [0, 1] and total[0, 1] == pytest.approx(np.outer(r, r)[same].mean() / o.sigma2[0])
    f = blocks.gls_unstructured(df, ["one", "x"], "y", visits, cov, float(o.sigma2[0]), o.n)
    assert np.isfinite(f.beta).all() and f.cov[1, 1] > 0


def test_visit_sums(spark):
    """Pair sums by brute force, with null ids and visits; rows are dealt to as many tasks as asked for, and the visits of a group meet without a join of all groups."""
    rng = np.random.default_rng(6)
    pick = lambda n: None if rng.random() < 0.1 else int(rng.integers(0, n))
    rows = [(pick(5), pick(7), pick(3), float(rng.normal())) for _ in range(300)]
    got = mixed.visit_moments(spark.createDataFrame(rows, "fid long, iid long, visit int, r_y double"), "y", parts=9)
    want = {}
    for f, i, a, r in rows:
        for g, j, b, s in rows:
            if None not in (f, g, a, b) and f == g and a <= b:
                sums = want.setdefault((a, b), [0, 0, 0.0, 0.0])
                mine = i is not None and i == j
                for k, x in enumerate((1, mine, r * s, mine * r * s)):
                    sums[k] += x
    assert {(r["v1"], r["v2"]): list(r)[2:] for r in got.select("v1", "v2", "family_pairs", "subject_pairs", "family_sum", "subject_sum").collect()} == {k: pytest.approx(v) for k, v in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(fid" in plan and ", 9), REPARTITION_BY_NUM" in plan and plan.split("AdaptiveSparkPlan")[1].count("SortMergeJoin") <= 1


def test_slices_are_small():
    """A full Arrow batch of wide vectors is worked on in parts of a few MB, with no row lost."""
    import pyarrow as pa

    from varimesh.operators import arrays

    rows = np.arange(10_000 * 131, dtype=float).reshape(10_000, 131)
    parts = list(arrays.sliced(iter([pa.RecordBatch.from_arrays([arrays.lists(rows)], ["m"])]), 0))
    assert (np.concatenate([arrays._matrix(b.column(0), b.num_rows) for b in parts]) == rows).all()
    assert max(b.num_rows for b in parts) * 131 * 8 <= 4 << 20


def test_profile_interval(data):
    df, _ = data
    o = linear.ols(linear.gram(df, ["one", "x"], ["y"]))
    res = linear.residuals(df, o, ["fid", "iid"])
    best, _ = likelihood.maximum_likelihood(res, ["y"], ("F", "E"), np.array([[0.3, 0.7]]))
    ends = likelihood.profile_intervals(res, ["y"], ("F", "E"), best)[0]
    assert (ends[:, 0] < best[0]).all() and (ends[:, 1] > best[0]).all()


def test_pareto_tail_where_it_knows_nothing(spark):
    """No spread, one value beyond the cut, and past the end of a bounded tail: the rank's p-value; else the law's."""
    def rows(key, observed, values):
        return [(key, 0, observed), *((key, k + 1, float(np.sqrt(v))) for k, v in enumerate(values))]

    flat = [1.0] * 10 + [4.0] * 10
    bounded = [float(v) for v in np.linspace(1, 2, 40)]
    heavy = [float(v) for v in np.random.default_rng(1).pareto(3, 400) + 1]
    made = rows("flat", 3.0, flat) + rows("one", 9.0, [1.0] * 19 + [2.0]) + rows("end", 100.0, bounded) + rows("law", 4.0, heavy)
    p = spark.createDataFrame(made, "term string, perm_id long, z double")
    got = {r.term: r.logp for r in resample.tail_p(p, ["term"], quantile=0.5, law="pareto").collect()}
    own = {r.term: r.logp for r in resample.rank_p(p, ["term"]).collect()}
    assert all(got[k] == pytest.approx(own[k]) for k in ("flat", "one", "end"))
    assert got["law"] > own["law"] and got["law"] == pytest.approx(-np.log10(16.0**-3), abs=1.2)


def test_gram_matrices_of_folds_and_of_some_columns(spark):
    """One pass for all folds, and none for a smaller model."""
    rng = np.random.default_rng(8)
    rows = [(int(k % 3), 1.0, *map(float, rng.normal(size=3))) for k in range(60)]
    df = spark.createDataFrame(rows, "fold int, c double, x double, y double, z double")
    by = linear.grams(df, "fold", ["c", "x"], ["y", "z"])
    assert sorted(by) == [0, 1, 2]
    for i, g in by.items():
        own = linear.gram(df.where(f"fold = {i}"), ["c", "x"], ["y", "z"])
        assert np.allclose(g.xx, own.xx) and np.allclose(g.xy, own.xy) and np.allclose(g.yy, own.yy) and g.n == own.n
    some, own = linear.part(linear.gram(df, ["c", "x"], ["y", "z"]), ["x"]), linear.gram(df, ["x"], ["y", "z"])
    assert some.xs == own.xs and np.allclose(some.xx, own.xx) and np.allclose(some.xy, own.xy) and np.allclose(some.yy, own.yy) and some.n == own.n


def test_gwas_reads_dosages_where_it_cuts_them(spark, data):
    """Dosages that tasks read, and arrays of whole numbers over 2, against rows for each subject; with families, subjects and interactions. A slice holds four dosages a byte."""
    df, (_, iid, _, _) = data
    subjects, rng = np.unique(iid), np.random.default_rng(8)
    g = rng.integers(-1, 3, (7, len(subjects))).astype(np.int8)
    named = spark.createDataFrame([(int(s), 2 * k) for k, s in enumerate(subjects)], "iid long, place long")
    keys = spark.createDataFrame([(f"rs{k}", "1", k) for k in range(7)], "snp_id string, chr string, bp long")
    wide = np.full((7, 2 * len(subjects)), 2, np.int8)
    wide[:, ::2] = g
    for effects, basis in ((("F", "S", "E"), None), (("F", "E"), gwas.with_main(["x"], "one")), (("E",), None)):
        f = mixed.fit(df, ["one", "x"], ["y", "z"], effects)
        for times in (1, 3):  # thrice a dosage is over 2
            rows = [(f"rs{k}", "1", k, int(s), None if g[k, j] < 0 else float(g[k, j] * times)) for k in range(7) for j, s in enumerate(subjects)]
            long = spark.createDataFrame(rows, "snp_id string, chr string, bp long, iid long, dosage double")
            want = {(r["snp_id"], r["y_id"], r["basis_id"]): r for r in gwas.gwas(long, df, f, basis, rows_in_tile=60, variants_in_tile=3).collect()}
            if times == 1:
                other = gwas.gwas(keys, df, f, basis, rows_in_tile=60, variants_in_tile=3, places=named, read=lambda bp: wide[bp]).collect()
            else:
                arrays_ = keys.join(spark.createDataFrame([(k, [None if v < 0 else int(v) * 3 for v in wide[k]]) for k in range(7)], "bp long, dosages array<tinyint>"), "bp")
                other = gwas.gwas(arrays_, df, f, basis, rows_in_tile=60, variants_in_tile=3, places=named).collect()
            assert len(other) == len(want) == 14 * (1 if basis is None else 2)
            for r in other:
                w = want[r["snp_id"], r["y_id"], r["basis_id"]]
                assert [r[c] for c in ("beta", "se", "wald_logp")] == pytest.approx([w[c] for c in ("beta", "se", "wald_logp")], rel=1e-8)
    slots = gwas._slots(df.select(F.col("iid").alias("subject"), "fid").withColumn("block", F.lit(0)))
    assert {len(r["body"]) for r in gwas._from_arrays(keys, named, slots, 1, lambda bp: wide[bp]).collect()} == {-(-len(subjects) // 4)}
