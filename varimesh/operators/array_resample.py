"""The wild bootstrap of very many outcomes in one array column.

The outcomes are cut into tiles. Of each tile the families' scores, one vector of terms by outcomes, are sums over subjects and then families; a task that holds a part of
a tile's families multiplies their weights, resamples by families, with these vectors and keeps the product. A tile is so narrow that the product of all resamples fits
a task whatever their number. What leaves a tile is how often each outcome's statistic was exceeded, and the largest statistic of each
resample; values of resamples by outcomes are never stored unless they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _matrix, codes, combine, lists, sliced
from .mixed import MixedFit, three, with_groups
from .resample import length_table, lengths, weights
from .storage import saved

#: Numbers in a tile's sums, over all resamples and terms.
TILE = 1 << 20


@dataclass
class Model:
    """What a tile needs of the fit: shares by outcome, covariance by bin."""

    beta: np.ndarray
    ols: np.ndarray
    se: np.ndarray
    share: np.ndarray
    cov: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, fit: MixedFit) -> Model:
        names, first, at = np.unique(fit.bins, return_index=True, return_inverse=True)
        shares = three(fit.shares, fit.effects)
        mean = np.stack([shares[at == b].mean(axis=0) for b in range(len(names))]) + np.array([0, 0, 1e-12])
        cov = fit.gls.cov if fit.gls.cov.ndim == 3 else np.broadcast_to(fit.gls.cov, (len(at), *fit.gls.cov.shape))
        se = np.sqrt(np.stack([np.diag(cov[k]) for k in first])[at] * fit.gls.sigma2[:, None]).T
        return cls(fit.gls.beta, fit.ols.beta, se, mean[at], cov[first], at)


def family_scores(df: DataFrame, fit: MixedFit, y: str, width: int) -> DataFrame:
    """``(tile, fid, m)``: X'V⁻¹r of each family for ``width`` outcomes at a time, terms by outcomes; the last tile is filled up with zeros.

    Families and subjects of any size pass as sums of batches; a null family is one family.
    """
    xs, p, model = fit.gls.terms, len(fit.gls.terms), Model.of(fit)
    v, t = len(model.at), width
    n_tiles = -(-v // t)
    pad = lambda m: np.pad(m, ((0, 0), (0, n_tiles * t - v)))
    ols, (f, s, e) = pad(model.ols), pad(model.share.T)
    e[v:] = 1.0
    filled = F.concat(F.col(y).cast("array<double>"), F.array_repeat(F.lit(0.0), n_tiles * t - v)) if n_tiles * t > v else F.col(y).cast("array<double>")
    rows = with_groups(df, fit.effects).select("fid", "iid", *[F.col(f"`{x}`").cast("double").alias(f"x{i}") for i, x in enumerate(xs)], filled.alias("y"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_tiles - 1)), lambda k: F.struct(k.alias("tile"), F.slice("y", k * t + 1, t).alias("y")))
    rows = rows.withColumn("cut", F.explode(cut)).select("cut.tile", "fid", "iid", *[f"x{i}" for i in range(p)], F.col("cut.y").alias("y"))
    kind = lambda keys: ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", m array<double>"

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3 + p, p + 2):
            tile, first = codes(batch, [0])
            x = np.stack([batch.column(3 + i).to_numpy() for i in range(p)], 1)
            r = _matrix(batch.column(3 + p), batch.num_rows)
            for k, i in enumerate(first):
                own, at = tile == k, batch.column(0)[int(i)].as_py() * t
                r[own] -= x[own] @ ols[:, at : at + t]
            m = np.concatenate((np.ones((len(x), 1)), x, r, (x[:, :, None] * r[:, None, :]).reshape(len(x), -1)), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(m)], ["tile", "fid", "iid", "m"])

    def of_subjects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            u = _matrix(batch.column(2), batch.num_rows)
            at = batch.column(0).to_numpy()[:, None] * t + np.arange(t)
            n, x, r, xr = u[:, :1], u[:, 1 : 1 + p], u[:, 1 + p : 1 + p + t], u[:, 1 + p + t :].reshape(len(u), p, t)
            d = e[at] + s[at] * n
            a = (xr - (s[at] / d)[:, None, :] * x[:, :, None] * r[:, None, :]) / e[at][:, None, :]
            m = np.concatenate((n / d, r / d, (x[:, :, None] / d[:, None, :]).reshape(len(u), -1), a.reshape(len(u), -1)), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists(m)], ["tile", "fid", "m"])

    def of_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            u = _matrix(batch.column(2), batch.num_rows)
            at = batch.column(0).to_numpy()[:, None] * t + np.arange(t)
            q, r, w, a = u[:, :t], u[:, t : 2 * t], u[:, 2 * t : 2 * t + p * t].reshape(-1, p, t), u[:, 2 * t + p * t :].reshape(-1, p, t)
            score = a - (f[at] / (1 + f[at] * q) * r)[:, None, :] * w
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists(score.reshape(len(u), -1))], ["tile", "fid", "m"])

    subjects = combine(rows.mapInArrow(of_rows, kind(["tile", "fid", "iid"])), ["tile", "fid", "iid"])
    families = combine(subjects.select("tile", "fid", "m").mapInArrow(of_subjects, kind(["tile", "fid"])), ["tile", "fid"])
    return families.mapInArrow(of_families, kind(["tile", "fid"]))


def resampled_sums(scores: DataFrame, perms: int, terms: int, n_tiles: int, seed: int = 0, kind: str = "normal") -> DataFrame:
    """``(tile, m)``: of every tile the weighted sums of the families' scores, resamples by terms by outcomes.

    Tiles go to tasks of their own; where tiles are fewer than tasks, each is dealt to several by family and added up afterwards.
    """
    spark = scores.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    every = np.arange(1, perms + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), lists(sums.reshape(1, -1))], ["tile", "m"])

        for batch in sliced(batches, 2):
            tile, key, m = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), _matrix(batch.column(2), batch.num_rows)
            step = max(1, (1 << 20) // perms)
            for own in np.unique(tile):
                if own != place:
                    if place is not None:
                        yield out()
                    place, sums = int(own), np.zeros((perms, m.shape[1]))
                at = np.flatnonzero(tile == own)
                for k in range(0, len(at), step):
                    rows = at[k : k + step]
                    sums += weights(key[rows], every, seed, kind).T @ m[rows]
        if place is not None:
            yield out()

    salt = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(1, -(-parts // n_tiles)))).cast("int")
    dealt = scores.select("tile", F.xxhash64("fid").alias("key"), "m").repartition(parts, "tile", salt).sortWithinPartitions("tile")
    return combine(dealt.mapInArrow(run, "tile int, m array<double>"), ["tile"])


class Bootstrap:
    """Resamples of all outcomes; resample 0 is the observed fit. Standard errors stay at the observed fit, and weights are those of :func:`.resample.wild_bootstrap`."""

    def __init__(self, df: DataFrame, fit: MixedFit, y: str, perms: int, seed: int = 0, kind: str = "normal", null: bool = True):
        self.fit, self.perms, self.null, self.model = fit, perms, null, Model.of(fit)
        p, v = len(fit.gls.terms), len(self.model.at)
        self.width = max(1, min(v, TILE // (perms * p)))
        scores = family_scores(df, fit, y, self.width)
        self.sums = saved(resampled_sums(scores, perms, p, -(-v // self.width), seed, kind))

    def _statistics(self):
        """A function from a tile and its sums to the outcomes' places and their resampled effects and statistics, resamples by terms by outcomes."""
        model, perms, p, t, null = self.model, self.perms, len(self.fit.gls.terms), self.width, self.null
        v = len(model.at)

        def of(tile: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.arange(tile * t, min(v, tile * t + t))
            s = m.reshape(perms, p, t)[:, :, : len(at)]
            d = np.einsum("vij,bjv->biv", model.cov[model.at[at]], s, optimize=True)
            beta = d if null else d + model.beta[:, at]
            with np.errstate(divide="ignore", invalid="ignore"):
                return at, beta, beta / model.se[:, at]

        return of

    def table(self) -> DataFrame:
        """``(perm_id, y_id, term, beta, se, z)`` of every resample and outcome, for what needs whole maps; its size is their product."""
        of, terms, se, model, perms = self._statistics(), np.array(self.fit.gls.terms, object), self.model.se, self.model, self.perms
        names = np.array(self.fit.gls.ys, object)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 1):
                for tile, m in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), batch.num_rows), strict=True):
                    at, beta, z = of(tile, m)
                    seen = model.beta[:, at]
                    beta, z = np.concatenate((seen[None], beta)), np.concatenate(((seen / se[:, at])[None], z))
                    for b in range(perms + 1):
                        shape = beta[b].shape
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(beta[b].size, b)), pa.array(np.tile(names[at], len(terms)), pa.string()), pa.array(np.repeat(terms, shape[1]), pa.string()),
                            pa.array(beta[b].ravel()), pa.array(se[:, at].ravel()), pa.array(z[b].ravel()),
                        ], ["perm_id", "y_id", "term", "beta", "se", "z"])

        return self.sums.mapInArrow(run, "perm_id long, y_id string, term string, beta double, se double, z double")

    def largest(self) -> np.ndarray:
        """For each resample and term the largest absolute statistic over all outcomes: a running maximum in each task, so one row of numbers for a task is moved."""
        of, size = self._statistics(), self.perms * len(self.fit.gls.terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = None
            for batch in sliced(batches, 1):
                for tile, m in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), batch.num_rows), strict=True):
                    own = np.fmax.reduce(np.abs(of(tile, m)[2]), axis=2).ravel()
                    top = own if top is None else np.fmax(top, own)
            if top is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(top)], ["i", "x"])

        out = np.full(size, np.nan)
        for r in self.sums.mapInArrow(run, "i long, x double").where("not isnan(x)").groupBy("i").agg(F.max("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        return out.reshape(self.perms, -1)

    def significance(self, most: np.ndarray | None = None) -> DataFrame:
        """``(y_id, term, observed, logp, family_logp)``: -log10 of the rank of each absolute statistic among its resamples, and among the largest of all outcomes (:meth:`largest`).

        On ties the observed one comes first. A term without spread has null results.
        """
        of, terms, names, model, perms = self._statistics(), np.array(self.fit.gls.terms, object), np.array(self.fit.gls.ys, object), self.model, self.perms
        tops = np.sort(self.largest() if most is None else most, axis=0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 1):
                for tile, m in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), batch.num_rows), strict=True):
                    at, _, z = of(tile, m)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        seen = np.abs(model.beta[:, at] / model.se[:, at])
                    above = (np.abs(z) > seen).sum(0)
                    whole = np.stack([perms - np.searchsorted(tops[:, i], seen[i], side="right") for i in range(len(terms))])
                    number = lambda x: pa.array(x.ravel(), mask=~np.isfinite(seen).ravel())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.tile(names[at], len(terms)), pa.string()), pa.array(np.repeat(terms, len(at)), pa.string()), number(seen),
                        number(-np.log10((above + 1) / (perms + 1))), number(-np.log10((whole + 1) / (perms + 1))),
                    ], ["y_id", "term", "observed", "logp", "family_logp"])

        return self.sums.mapInArrow(run, "y_id string, term string, observed double, logp double, family_logp double")

    def multivariate(self, term: str, keep: int | None = None) -> DataFrame:
        """``(perm_id, stat, logp)`` of one term over all outcomes: see :func:`.resample.multivariate`. Tasks add up products of resamples over their tiles."""
        of, i, perms, model = self._statistics(), self.fit.gls.terms.index(term), self.perms, self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h = None
            for batch in sliced(batches, 1):
                for tile, m in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), batch.num_rows), strict=True):
                    at, _, z = of(tile, m)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        z = np.nan_to_num(np.concatenate(((model.beta[i, at] / model.se[i, at])[None], z[:, i])), posinf=0, neginf=0)
                    h = z @ z.T if h is None else h + z @ z.T
            if h is not None:
                step = max(1, TILE // (perms + 1))
                for k in range(0, perms + 1, step):
                    own = h[k : k + step]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(own))), lists(own)], ["i", "m"])

        h = np.zeros((perms + 1, perms + 1))
        for batch in sliced(iter(combine(self.sums.mapInArrow(run, "i long, m array<double>"), ["i"]).toArrow().to_batches()), 1):
            h[batch.column(0).to_numpy()] = _matrix(batch.column(1), batch.num_rows)
        return length_table(self.sums.sparkSession, lengths(h, keep, len(model.at)))
