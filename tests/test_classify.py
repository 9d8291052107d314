"""Kernel classification on held-out families against a dense kernel machine, and components against a singular value decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varimesh.plans import classify, model


@pytest.fixture(scope="module")
def rings(spark):
    """Twelve outcomes of two hidden numbers; the label is how far out they lie, which no plane tells."""
    rng = np.random.default_rng(5)
    hidden = rng.normal(size=(700, 2))
    mix = rng.normal(size=(2, 12))
    x = hidden @ mix + 0.05 * rng.normal(size=(700, 12)) + 3
    label = ((hidden**2).sum(1) > 1.4).astype(int)
    rows = [(int(k // 5), [float(v) for v in x[k]], int(label[k])) for k in range(700)]
    return spark.createDataFrame(rows, "fid long, y array<double>, label int").repartition(3).cache(), x, label


def area(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_components(rings):
    df, x, _ = rings
    mean, directions, variance = classify.components(df, "y", 12, 3)
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert mean == pytest.approx(x.mean(0)) and variance == pytest.approx(s[:3] ** 2 / 699, rel=1e-4)
    assert np.abs((directions[:, :2] * v[:2].T).sum(0)) == pytest.approx([1, 1], abs=1e-4)


def test_near_a_dense_kernel_machine(rings):
    df, x, label = rings
    got = classify.kernel_auc(df, "y", 12, "label", k_folds=4, n_components=2, features=256).toPandas()
    assert len(got) == 4 and got.auc.min() > 0.9
    scored = classify.kernel_scores(df, "y", 12, "label", k_folds=4, n_components=2, features=256).toPandas()
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    z = (x - x.mean(0)) @ v[:2].T / (s[:2] / np.sqrt(699))
    fold = scored.groupby("fid").fold.first()
    own = np.array([fold[k // 5] for k in range(700)])
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * 2))
    want = np.zeros(700)
    for f in range(4):
        rest = own != f
        want[own == f] = kernel[np.ix_(own == f, rest)] @ np.linalg.solve(kernel[np.ix_(rest, rest)] + np.eye(rest.sum()), 2.0 * label[rest] - 1)
    assert got.auc.mean() == pytest.approx(np.mean([area(want[own == f], label[own == f]) for f in range(4)]), abs=0.02)
    plane = model.cross_validated_auc(df.withColumns({f"x{k}": F.col("y")[k] for k in range(3)}).withColumn("one", F.lit(1.0)), ["one", "x0", "x1", "x2"], "label", 4)
    assert plane.agg(F.avg("auc")).first()[0] < 0.7


def test_missing_labels_and_layout(rings):
    df, _, _ = rings
    part = df.withColumn("label", F.when(F.col("fid") % 3 != 0, F.col("label")))
    a = classify.kernel_scores(part, "y", 12, "label", k_folds=3, n_components=2, features=64).toPandas()
    b = classify.kernel_scores(part.repartition(7), "y", 12, "label", k_folds=3, n_components=2, features=64).toPandas()
    assert len(a) == 700 and a.score.notna().all()
    assert sorted(a.score) == pytest.approx(sorted(b.score), abs=1e-5)
