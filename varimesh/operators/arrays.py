"""Mixed models of very many outcomes, held in one array column, such as all voxels of an image.

The same sums as in :mod:`.mixed`, as vectors: a row's outcomes are one vector, and every batch of rows is a few matrix products. Sums over subjects and families
are combined within each task first and then by key, so a family of any size costs each task one vector. All bins of outcomes are weighted in one pass.
Only matrices of outcomes by columns reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Fit, Gram, gram_arrays, nearest_spd, ols
from .mixed import EFFECTS, MixedFit, Moments, bins, components, three, with_groups
from .storage import saved


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(float) if rows else np.zeros((0, 0))


#: Bytes of vectors, as doubles, that a task works on at a time.
SLICE = 4 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: int, times: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose lists in ``column``, ``times`` over, are at most ``SLICE`` bytes of doubles, or one row."""
    for batch in batches:
        if batch.num_rows:
            width = pa.compute.max(batch.column(column).value_lengths()).as_py() or 1
            rows = max(1, SLICE // (8 * width * times))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)


def codes(batch: pa.RecordBatch, keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its keys' combination, in order of appearance, and where each first appears. A null is a key like any other."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        d = batch.column(k).dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, at = np.unique(code, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[at], first[order]


def combine(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the vectors ``m`` by ``keys``, nulls among them: within each batch, then over ranges of sorted keys that a task reads through, holding one vector."""
    kind = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", m array<double>"
    names = [*keys, "m"]

    def groups(batch: pa.RecordBatch) -> tuple[pa.Table, np.ndarray]:
        """The batch's different keys in order of appearance, and the sum of each."""
        code, first = codes(batch, list(range(len(keys))))
        m = _matrix(batch.column(len(keys)), batch.num_rows)
        order = np.argsort(code, kind="stable")
        sums = np.add.reduceat(m[order], np.searchsorted(code[order], np.arange(len(first))), axis=0) if len(first) < len(m) else m
        return pa.Table.from_batches([batch]).select(keys).take(pa.array(first)), sums

    def out(rows: pa.Table, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(sums):
            whole = rows.append_column("m", lists(sums))
            yield from whole.combine_chunks().to_batches()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(keys)):
            yield from out(*groups(batch))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key may go on in the next batch
        for batch in sliced(batches, len(keys)):
            rows, sums = groups(batch)
            if held is not None:
                if held[0].equals(rows.slice(0, 1)):
                    sums[0] += held[1]
                else:
                    yield from out(held[0], held[1][None, :])
            yield from out(rows.slice(0, rows.num_rows - 1), sums[:-1])
            held = rows.slice(rows.num_rows - 1), sums[-1]
        if held is not None:
            yield from out(held[0], held[1][None, :])

    return df.select(*names).mapInArrow(partial, kind).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(final, kind)


def lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def total(df: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors ``m`` of the vector that ``of`` makes of a batch of them (rows by places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in sliced(batches, 0):
            new = of(_matrix(batch.column(0), batch.num_rows))
            sums = new if sums is None else sums + new
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["i", "x"])

    rows = df.select("m").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def vectors(df: DataFrame, keys: list[str], xs: list[str], y: str, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``keys`` and ``m``, what ``of`` makes of the rows' X and Y."""
    kind = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", m array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(keys) + len(xs)):
            n = batch.num_rows
            x = np.stack([batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in range(len(xs))], 1).astype(float)
            m = of(x, _matrix(batch.column(len(keys) + len(xs)), n))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists(m)], [*keys, "m"])

    return df.select(*keys, *[F.col(f"`{x}`").cast("double") for x in xs], y).mapInArrow(run, kind)


def subject_sums(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """``(fid, iid, m)``: of each subject the number of rows and the sums of X and Y, in one vector."""
    return saved(combine(vectors(df, ["fid", "iid"], xs, y, lambda x, m: np.concatenate((np.ones((len(x), 1)), x, m), 1)), ["fid", "iid"]))


def pair_moments(df: DataFrame, subjects: DataFrame, o: Fit, y: str) -> Moments:
    """The normal equations of the moments for all outcomes; residual sums of subjects follow from their sums, squares need the rows."""
    p, v, beta = len(o.terms), len(o.ys), o.beta

    def of_subject(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 2):
            u = _matrix(batch.column(1), batch.num_rows)
            n, s = u[:, :1], u[:, 1 + p :] - u[:, 1 : 1 + p] @ beta
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.concatenate((n, n * n, s, s * s), 1))], ["fid", "m"])

    kind = f"fid {subjects.schema['fid'].dataType.simpleString()}, m array<double>"
    families = combine(subjects.select("fid", "m").mapInArrow(of_subject, kind), ["fid"])
    a = total(families, lambda m: np.concatenate(([np.sum(m[:, 0] ** 2), m[:, 1].sum(), m[:, 0].sum()], (m[:, 2 : 2 + v] ** 2).sum(0), m[:, 2 + v :].sum(0))))
    squares = combine(vectors(df, ["fid"], o.terms, y, lambda x, m: (m - x @ beta) ** 2), ["fid"])
    q = total(squares, lambda m: np.concatenate((m.sum(0), (m * m).sum(0))))
    n2, ns2, n = a[:3]
    md = np.stack((a[3 : 3 + v], a[3 + v :], q[:v]), 1)
    return Moments(np.array([[n2, ns2, n], [ns2, ns2, n], [n, n, n]]), md / o.sigma2[:, None], q[v:] / o.sigma2**2)


def gls(subjects: DataFrame, g: Gram, shares: np.ndarray, sigma2: np.ndarray, n_bins: int = 20) -> tuple[Fit, np.ndarray]:
    """Generalised least squares for all outcomes; every bin's weights are applied in the same two passes over the subjects' sums."""
    p, v = len(g.xs), len(g.ys)
    cell = bins(shares, n_bins)
    names, at = np.unique(cell, return_inverse=True)
    mean = np.stack([shares[at == b].mean(axis=0) for b in range(len(names))])
    mean[mean[:, 2] <= 0, 2] += 1e-6  # no error share: the covariance is singular, so a little of it stands in
    f, s, e = mean.T
    owners = [np.flatnonzero(at == b) for b in range(len(names))]

    def within(u: np.ndarray) -> np.ndarray:
        """The subjects' own part of what is taken from Z'Z / e, for X by X of each bin and X by Y of each outcome."""
        n, x, y = u[:, :1], u[:, 1 : 1 + p], u[:, 1 + p :]
        c = s / (e * (e + s * n))
        xx = np.einsum("ib,ij,ik->bjk", c, x, x)
        return np.concatenate((xx.ravel(), (x.T @ (c[:, at] * y)).ravel()))

    def of_family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 2):
            u = _matrix(batch.column(1), batch.num_rows)
            d = e + s * u[:, :1]
            m = np.concatenate((u[:, :1] / d, (u[:, 1 : 1 + p, None] / d[:, None, :]).reshape(len(u), -1), u[:, 1 + p :] / d[:, at]), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(m)], ["fid", "m"])

    b = len(names)

    def between(m: np.ndarray) -> np.ndarray:
        q, x, y = m[:, :b], m[:, b : b + p * b].reshape(len(m), p, b), m[:, b + p * b :]
        k = f / (1 + f * q)
        xx = np.einsum("ib,ijb,ikb->bjk", k, x, x)
        xy = np.empty((p, v))
        for c, own in enumerate(owners):  # one product for each bin; a copy of X for every outcome would be p times the outcomes
            xy[:, own] = (k[:, c, None] * x[:, :, c]).T @ y[:, own]
        return np.concatenate((xx.ravel(), xy.ravel()))

    kind = f"fid {subjects.schema['fid'].dataType.simpleString()}, m array<double>"
    taken = total(subjects, within) + total(combine(subjects.select("fid", "m").mapInArrow(of_family, kind), ["fid"]), between)
    xx, xy = taken[: b * p * p].reshape(b, p, p), taken[b * p * p :].reshape(p, v)
    beta, cov = np.zeros((p, v)), np.zeros((v, p, p))
    for k, own in enumerate(owners):
        inv = np.linalg.pinv(g.xx / e[k] - xx[k], hermitian=True)
        cov[own], _ = nearest_spd(inv)
        beta[:, own] = inv @ (g.xy[:, own] / e[k] - xy[:, own])
    return Fit(g.xs, g.ys, beta, cov, sigma2, g.n), cell


def fit(df: DataFrame, xs: list[str], y: str, width: int, effects: tuple[str, ...] = EFFECTS, n_bins: int = 20, nonnegative: bool = True) -> MixedFit:
    """The whole model of :func:`.mixed.fit` for outcomes in the array column ``y`` of ``width`` places, called ``y0, y1, ...``. No place may be missing."""
    effects = (*[e for e in effects if e != "E"], "E")
    df = with_groups(df, effects)
    g = gram_arrays(df, xs, y, width)
    o = ols(g)
    subjects = subject_sums(df, xs, y)
    shares = components(pair_moments(df, subjects, o, y), effects, nonnegative)
    w, cell = gls(subjects, g, three(shares, effects), o.sigma2, n_bins)
    return MixedFit(o, w, shares, cell, effects)
