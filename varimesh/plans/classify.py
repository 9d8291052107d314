"""Prediction of a yes-or-no variable from very many outcomes, with a radial kernel, judged on families left out.

The outcomes, one array column, are first reduced to their leading components by a randomised decomposition: passes over the rows add up matrices of outcomes by components. The kernel is that of
random Fourier features of the components, so a squared-hinge margin is fitted by Newton steps whose sums, features by features for each fold, are all that leaves a task. All folds are fitted in the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varimesh.operators.arrays import _matrix, lists, sliced
from varimesh.operators.storage import saved
from varimesh.operators.tables import auc, folds


def _added(df: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over batches of the matrix that ``of`` makes of each, moved in rows."""
    width = int(np.prod(shape[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = of(batch)
                total = m if total is None else total + m
        if total is not None:
            flat = total.reshape(shape[0], width)
            step = max(1, (1 << 20) // width)
            for at in range(0, shape[0], step):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, min(shape[0], at + step))), lists(flat[at : at + step])], ["i", "m"])

    from varimesh.operators.arrays import combine

    out = np.zeros((shape[0], width))
    for batch in sliced(iter(combine(df.mapInArrow(run, "i long, m array<double>"), ["i"]).toArrow().to_batches()), 1):
        out[batch.column(0).to_numpy()] = _matrix(batch.column(1), batch.num_rows)
    return out.reshape(shape)


def components(df: DataFrame, y: str, width: int, k: int, rounds: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(mean, directions, variances)``: the leading components of an array column; directions are outcomes by components. Two passes and one for each further round."""
    k = min(k, width)
    extra = min(width, k + 10)
    one = df.select(F.col(y).cast("array<double>"))

    def first(batch: pa.RecordBatch) -> np.ndarray:
        m = _matrix(batch.column(0), batch.num_rows)
        return np.concatenate((m.sum(0), [len(m)]))[:, None]

    sums = _added(one, lambda b: sum(first(s) for s in sliced(iter([b]), 0)), (width + 1, 1))[:, 0]
    n, mean = sums[-1], sums[:-1] / max(1.0, sums[-1])
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, extra)))[0]

    def times(q: np.ndarray):
        def of(batch: pa.RecordBatch) -> np.ndarray:
            return sum((m := _matrix(s.column(0), s.num_rows) - mean).T @ (m @ q) for s in sliced(iter([batch]), 0))

        return of

    for _ in range(rounds):
        q = np.linalg.qr(_added(one, times(q), (width, extra)))[0]
    inner = q.T @ _added(one, times(q), (width, extra))
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(value)[::-1][:k]
    return mean, q @ vector[:, order], np.maximum(value[order], 0) / max(1.0, n - 1)


def kernel_scores(df: DataFrame, y: str, width: int, label: str, k_folds: int = 10, n_components: int = 250, features: int = 512, scale: float | None = None, ridge: float = 1.0, rounds: int = 12, seed: int = 0) -> DataFrame:
    """``df`` with ``fold`` and ``score``, each row's by the model of the other folds; folds are of whole families (``fid``).

    ``label`` is 0 or 1; rows where it is null are scored but teach nothing. ``scale`` is the kernel's width, by default the square root of the number of components, which have unit variance. No place of ``y`` may be missing.
    """
    df = saved(df.withColumn("fold", folds("fid", k_folds, seed)))
    mean, directions, variance = components(df, y, width, n_components, seed=seed)
    own = variance > 1e-12 * max(variance.max(initial=0), 1e-300)
    turn = directions[:, own] / np.sqrt(variance[own])
    rng, k = np.random.default_rng(seed), int(own.sum())
    w = rng.normal(size=(k, features)) / (scale or np.sqrt(max(1, k)))
    shift, size = rng.uniform(0, 2 * np.pi, features), features + 1
    reduce = turn @ w

    def featured(m: np.ndarray) -> np.ndarray:
        return np.concatenate((np.sqrt(2 / features) * np.cos((m - mean) @ reduce + shift), np.ones((len(m), 1))), 1)

    taught = df.where(F.col(label).isNotNull()).select("fold", (F.col(label).cast("double") * 2 - 1).alias("s"), F.col(y).cast("array<double>"))
    beta = np.zeros((k_folds, size))

    def step(beta: np.ndarray):
        def of(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((k_folds, size, size + 1))
            for part in sliced(iter([batch]), 2, max(1, -(-features // width))):
                z, fold, s = featured(_matrix(part.column(2), part.num_rows)), part.column(0).to_numpy(), part.column(1).to_numpy()
                inside = (z @ beta.T) * s[:, None] < 1
                for f in range(k_folds):
                    use = z[inside[:, f] & (fold != f)]
                    out[f, :, :size] += use.T @ use
                    out[f, :, size] += use.T @ s[inside[:, f] & (fold != f)]
            return out.reshape(k_folds * size, size + 1)

        return of

    for _ in range(rounds):
        sums = _added(taught, step(beta), (k_folds * size, size + 1)).reshape(k_folds, size, size + 1)
        hold = ridge * np.eye(size)
        hold[-1, -1] = 1e-8
        new = np.stack([np.linalg.solve(s[:, :size] + hold, s[:, size]) for s in sums])
        moved, beta = np.abs(new - beta).max(), new
        if moved < 1e-6:
            break

    names = [c for c in df.columns]
    place, at = names.index(y), names.index("fold")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, place, max(1, -(-features // width))):
            z = featured(_matrix(batch.column(place), batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.einsum("ij,ij->i", z, beta[batch.column(at).to_numpy()]))], [*names, "score"])

    return df.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", score double")


def kernel_auc(df: DataFrame, y: str, width: int, label: str, **options) -> DataFrame:
    """``(fold, auc)`` of :func:`kernel_scores` on the families left out."""
    scored = saved(kernel_scores(df, y, width, label, **options).select("fold", "score", label))
    return auc(scored.where(F.col(label).isNotNull()), "score", label, ["fold"])
