"""Association of each variant with outcomes, fixed effects and family covariance taken out.

Genotypes and subjects meet in tiles: families are dealt to blocks, variants to parts, and a tile holds one block's rows and one part's dosages as a matrix. A variant's array of
dosages is cut into the blocks' slices where it is read, four to a byte if they are 0, 1 and 2, and no row is made for a subject and a variant. A tile gives,
for each of its variants, sums of products with V⁻¹X, V⁻¹r and itself, where V is the covariance of the fitted mixed model, one for each bin of outcomes. The sums of
all blocks are added up by variant, and the estimates follow from them. So neither subjects nor variants ever pass through the driver or one task; a
family must fit a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varimesh.functions.dist import chi2_log10sf, signed_log10p, t_sf2

from .arrays import SLICE, combine, lists, sliced
from .linear import gram
from .mixed import MixedFit, three, with_groups
from .storage import saved

KEYS = ["snp_id", "chr", "bp"]
#: Bytes of one matrix of dosages by rows.
HELD = 16 << 20
KIND = "snp_id string, chr string, bp long, y_id string, basis_id int, beta double, se double, t double, logp double, wald double, wald_logp double, err_flag boolean"


class Groups:
    """Families and the subjects in them as codes, worked out once for any number of columns."""

    def __init__(self, fid: np.ndarray, iid: np.ndarray):
        _, fam = np.unique(fid, return_inverse=True)
        pairs, self.sub = np.unique(np.stack((fam, np.unique(iid, return_inverse=True)[1]), 1), axis=0, return_inverse=True)
        self.sub, self.fam = self.sub.ravel(), pairs[:, 0]
        self.n, self.order = np.bincount(self.sub), np.argsort(self.sub, kind="stable")
        self.starts = np.concatenate(([0], np.cumsum(self.n)[:-1]))
        self.firsts = np.flatnonzero(np.diff(self.fam, prepend=-1))  # subjects are sorted by family

    def apply_inverse(self, z: np.ndarray, share: np.ndarray) -> np.ndarray:
        """V⁻¹z for the F, S, E covariance, by group sums."""
        f, s, e = share
        d = (e + s * self.n)[:, None]
        sums = np.add.reduceat(z[self.order], self.starts, axis=0)
        q = np.add.reduceat(self.n / d[:, 0], self.firsts)
        w = np.add.reduceat(sums / d, self.firsts, axis=0) * (f / (1 + f * q))[:, None]
        return (z - (s / d * sums)[self.sub]) / e - (w[self.fam] / d)[self.sub]

    def sorted(self) -> Groups:
        """The same groups for rows in the order ``order``."""
        out = object.__new__(Groups)
        out.sub, out.fam, out.n, out.order, out.starts, out.firsts = self.sub[self.order], self.fam, self.n, np.arange(len(self.order)), self.starts, self.firsts
        return out

    def taken(self, g: np.ndarray, base: np.ndarray, share: np.ndarray) -> np.ndarray | float:
        """What group effects take from T'T / e in T'V⁻¹T, for each row ``g`` of values in the groups' order, whose T is its products with the columns of ``base``; 0 without such effects."""
        f, s, e = share
        if not f and not s:
            return 0.0
        d = e + s * self.n
        sums = np.stack([np.add.reduceat(g * u if (u != 1).any() else g, self.starts, axis=1) if len(self.n) < g.shape[1] else g * u for u in base.T], 1)
        out = np.einsum("mis,mjs->mij", sums * (s / (d * e)), sums, optimize=True) if s else 0.0
        if f:
            inner = np.add.reduceat(sums / d, self.firsts, axis=2) if len(self.firsts) < len(self.n) else sums / d
            out = out + np.einsum("mis,mjs->mij", inner * (f / (1 + f * np.add.reduceat(self.n / d, self.firsts))), inner, optimize=True)
        return out


#: The four codes in each byte, in order.
CODES = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8)


def _unpacked(b: pa.Table, at: np.ndarray, bits: int, slot: np.ndarray) -> np.ndarray:
    """The dosages of the rows ``at`` of a tile, variants by subjects' rows; a missing one is the variant's mean."""
    some = b.take(pa.array(at))
    data, mean = b"".join(some.column("body").to_pylist()), some.column("mean").to_numpy()[:, None]
    if bits == 2:
        g = CODES.view("<u4")[:, 0].take(np.frombuffer(data, np.uint8)).view(np.uint8).reshape(len(at), -1)
    else:
        g = np.frombuffer(data, "<f8").reshape(len(at), -1)
    if (slot < 0).any() or not g.shape[1]:  # rows of no known subject
        g = np.concatenate((g, np.full((len(at), 1), 3 if bits == 2 else np.nan, g.dtype)), 1)
    if len(slot) > g.shape[1] or (slot != np.arange(len(slot))).any():
        g = g.take(slot, axis=1)
    else:
        g = g[:, : len(slot)]
    out = g.astype(float)
    np.copyto(out, mean, where=g == 3 if bits == 2 else ~(g >= 0))
    return out


def apply_inverse(z: np.ndarray, fid: np.ndarray, iid: np.ndarray, share: np.ndarray) -> np.ndarray:
    """V⁻¹z for the F, S, E covariance; subjects lie in families."""
    return Groups(fid, iid).apply_inverse(z, share)


def _slots(rows: DataFrame) -> DataFrame:
    """``(subject, block, slot)``: each analysed subject's place within its block, families together."""
    named = rows.where("subject is not null").groupBy("subject", "block").agg(F.min("fid").alias("_fid"))
    w = Window.partitionBy("block").orderBy("_fid", "subject")  # a block has a bounded number of rows, or one family's
    return saved(named.select("subject", "block", (F.row_number().over(w) - 1).cast("int").alias("slot")))


def _packed(codes: np.ndarray) -> np.ndarray:
    """Four codes of two bits in each byte."""
    x = np.ascontiguousarray(codes).view("<u4")
    return (x | x >> 6 | x >> 12 | x >> 18).astype(np.uint8)


def _from_arrays(variants: DataFrame, places: DataFrame, slots: DataFrame, blocks: int, read: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """``(snp_id, chr, bp, block, mean, bits, body)``: each block's slice of a variant's dosages in the order of its slots, and the mean over the analysed subjects.

    Dosages of 0, 1 and 2 take two bits each, other whole numbers and fractions 64. The places of all analysed subjects go to every task: as many numbers as one variant's row has.
    """
    known = places.select("place", F.col("iid").alias("subject")).join(slots, "subject").select("place", "block", "slot").toArrow()
    place, block, slot = (known.column(k).to_numpy() for k in ("place", "block", "slot"))
    sizes = np.zeros(blocks, np.int64)
    for r in slots.groupBy("block").agg((F.max("slot") + 1).alias("n")).collect():
        sizes[r["block"]] = r["n"]
    ends = np.cumsum(-(-sizes // 4) * 4)  # blocks begin at whole bytes
    starts = ends - -(-sizes // 4) * 4
    order = np.full(int(ends[-1]), -1, np.int32)  # the place of each slot of all blocks; none for what fills a byte
    order[starts[block] + slot] = place
    small = read is not None or variants.schema["dosages"].dataType.elementType.typeName() == "byte"
    given = variants.sparkSession.sparkContext.broadcast((order, starts, ends))

    def bodies(data: np.ndarray, bits: int, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The blocks' slices of each row, cut where they lie."""
        cuts = np.append(starts, ends[-1]) * bits // 8
        offsets = (np.arange(len(data))[:, None] * cuts[-1] + cuts[:-1]).ravel()
        return pa.Array.from_buffers(pa.binary(), len(offsets), [None, pa.py_buffer(np.append(offsets, len(data) * cuts[-1]).astype("<i4").tobytes()), pa.py_buffer(np.ascontiguousarray(data))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, starts, ends = given.value
        few = max(1, SLICE // max(1, len(order)))
        for batch in sliced(batches, 3) if read is None else (b.slice(at, few) for b in batches for at in range(0, b.num_rows, few)):
            rows, column = batch.num_rows, batch.column(3)
            if read is not None:
                g = read(column.to_numpy(zero_copy_only=False))
            else:
                g = column.flatten().cast(pa.int8() if small else pa.float64()).fill_null(-1 if small else np.nan).to_numpy(zero_copy_only=False).reshape(rows, -1)
            none = -1 if small else np.nan
            if len(order) and g.shape[1]:
                own = np.take(g, order, axis=1, mode="clip")
                own[:, order < 0] = none
            else:
                own = np.full((rows, len(order)), none, g.dtype)
            if small and (not own.size or own.max() <= 2):
                codes = np.minimum(own.view(np.uint8), 3)  # below 0: missing
                one, two, missing = (np.count_nonzero(codes == k, axis=1) for k in (1, 2, 3))
                mean, bits, data = (one + 2.0 * two) / np.maximum(1, own.shape[1] - missing), 2, _packed(codes)
            else:
                data = own.astype("<f8")
                data[~(data >= 0)] = np.nan
                seen = np.isfinite(data)
                mean, bits = np.where(seen, data, 0).sum(1) / np.maximum(1, seen.sum(1)), 64
            blocks = len(starts)
            at = pa.array(np.repeat(np.arange(rows), blocks))
            columns = [batch.column(c).take(at) for c in range(3)] + [pa.array(np.tile(np.arange(blocks, dtype=np.int32), rows)), pa.array(np.repeat(mean, blocks)), pa.array(np.full(rows * blocks, bits, np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, bodies(data, bits, starts, ends)], [*KEYS, "block", "mean", "bits", "body"])

    return variants.select(F.col("snp_id").cast("string"), F.col("chr").cast("string"), F.col("bp").cast("long"), "dosages" if read is None else F.col("bp").cast("long").alias("number")).mapInArrow(run, "snp_id string, chr string, bp long, block int, mean double, bits int, body binary")


def _from_cells(dosages: DataFrame, slots: DataFrame, blocks: int) -> DataFrame:
    """The same from a table with a row for each subject and variant: its rows are grouped by variant and block. A variant nobody analysed has keeps its name."""
    cells = dosages.select(F.col("snp_id").cast("string"), F.col("chr").cast("string"), F.col("bp").cast("long"), F.col("iid").alias("subject"), F.col("dosage").cast("double").alias("dosage"))
    own = saved(cells.join(slots, "subject").where("dosage is not null").select(*KEYS, "block", "slot", "dosage"))
    none = F.lit(None).cast("array<struct<slot:int,dosage:double>>")
    means = own.groupBy(*KEYS).agg(F.avg("dosage").alias("mean")).unionByName(cells.select(*KEYS).distinct().withColumn("mean", F.lit(None).cast("double")))
    means = means.groupBy(*KEYS).agg(F.coalesce(F.max("mean"), F.lit(0.0)).alias("mean")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cells", none)
    lists = own.groupBy(*KEYS, "block").agg(F.collect_list(F.struct("slot", "dosage")).alias("cells")).withColumn("mean", F.lit(None).cast("double"))
    sizes = slots.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("size"))
    rows = means.unionByName(lists).groupBy(*KEYS, "block").agg(F.max("mean").alias("mean"), F.first("cells", ignorenulls=True).alias("cells")).join(F.broadcast(sizes), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for size, cells in zip(batch.column(5).to_pylist(), batch.column(6), strict=True):
                body = np.full(-(-(size or 0) // 4) * 4, np.nan)
                if cells.is_valid:
                    body[cells.values.field("slot").to_numpy()] = cells.values.field("dosage").to_numpy()
                bodies.append(body.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.full(batch.num_rows, 64, np.int32)), pa.array(bodies, pa.binary())], [*KEYS, "block", "mean", "bits", "body"])

    return rows.select(*KEYS, "block", "mean", "size", "cells").mapInArrow(run, "snp_id string, chr string, bp long, block int, mean double, bits int, body binary")


def gwas(dosages: DataFrame, design: DataFrame, fit: MixedFit, basis: list[str] | None = None, test: str = "z", rows_in_tile: int | None = None, variants_in_tile: int = 2000, places: DataFrame | None = None, read: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(snp_id, chr, bp, y_id, basis_id, beta, se, t, logp, wald, wald_logp, err_flag)``.

    ``dosages`` has ``snp_id, chr, bp`` and arrays ``dosages``, with ``places`` (``iid, place``) saying where a subject's value stands, or else a row ``iid, dosage`` for each
    subject. With ``read``, which gives the dosages of variants ``bp`` as a matrix of bytes (below 0: missing), the table has no arrays and tasks read what they cut. A missing dosage counts as the variant's mean over the analysed subjects. Tiles have ``rows_in_tile`` rows, by default 2,000 to 16,000 as there are more. ``design`` has ``fid, iid``, the terms and outcomes of ``fit``
    and the columns of ``basis``, each of which multiplies the variant (without any: its main effect). ``test``: p-values of single effects from the normal (``z``),
    Student's t (``t``) or the chi-squared law of the square (``chi``). A variant that is constant, or explained by X, has null results and ``err_flag`` set.
    """
    if test not in ("z", "t", "chi"):
        raise ValueError(f"unknown test {test}")
    xs, ys, bs = fit.gls.terms, fit.gls.ys, basis or []
    p, v, q = len(xs), len(ys), max(1, len(bs))
    c = lambda name: F.col(f"`{name}`").cast("double")
    rows = with_groups(design.withColumn("_subject", F.col("iid")), fit.effects)
    rows = rows.select(F.col("_subject").alias("subject"), "fid", "iid", *[c(x).alias(f"x{i}") for i, x in enumerate(xs)], *[c(y).alias(f"y{i}") for i, y in enumerate(ys)], *[c(b).alias(f"b{i}") for i, b in enumerate(bs)])
    g = gram(rows, [f"x{i}" for i in range(p)], [f"y{i}" for i in range(v)])
    blocks = max(1, -(-g.n // (rows_in_tile or min(max(g.n // 64, 2000), 16000))))
    rows = saved(rows.withColumn("block", F.pmod(F.xxhash64("fid"), F.lit(blocks)).cast("int")))
    slots = _slots(rows)
    if read is not None or "dosages" in dosages.columns:
        if places is None:
            raise ValueError("arrays of dosages need the places of subjects in them")
        right = _from_arrays(dosages, places, slots, blocks, read)
        n_variants = dosages.count()
    else:
        right = saved(_from_cells(dosages, slots, blocks))
        n_variants = -(-right.count() // blocks)
    parts = max(1, -(-n_variants // variants_in_tile))
    right = right.withColumn("part", F.pmod(F.xxhash64(*KEYS), F.lit(parts)).cast("int"))
    left = rows.join(slots.drop("block"), "subject", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tasks = min(blocks * parts, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * parts // 8))
    left, right = left.repartition(tasks, "block", "part"), right.repartition(tasks, "block", "part")

    share = three(fit.shares, fit.effects)
    bins = [np.flatnonzero(fit.bins == b) for b in np.unique(fit.bins)]
    weights = [m if m[2] > 0 else m + np.array([0, 0, 1e-6]) for m in (share[own].mean(axis=0) for own in bins)]
    beta = fit.gls.beta

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        get = lambda k: a.column(k).to_numpy()
        stack = lambda k, n: np.stack([get(f"{k}{i}") for i in range(n)], 1)
        if not a.num_rows or not b.num_rows:
            return pa.table({"snp_id": pa.array([], pa.string()), "chr": pa.array([], pa.string()), "bp": pa.array([], pa.int64()), "m": pa.array([], pa.list_(pa.float64()))})
        groups = Groups(get("fid"), get("iid"))
        order = groups.order  # rows of a subject, and of a family, side by side
        x, y = stack("x", p)[order], stack("y", v)[order]
        base = (stack("b", len(bs)) if bs else np.ones((len(x), 1)))[order]
        slot, res = a.column("slot").fill_null(-1).to_numpy()[order], y - x @ beta
        groups = groups.sorted()
        # what a variant's row is multiplied with: products of the basis with X and r, weighted for each bin and not, and of the basis with itself for the squares
        by = lambda w: (base[:, :, None] * w[:, None, :]).reshape(len(x), -1)
        sides = [by(groups.apply_inverse(w, s)) for s, ids in zip(weights, bins, strict=True) for w in (x, res[:, ids])] + [by(x), by(res)]
        ends, side = np.cumsum([0] + [w.shape[1] for w in sides]), np.concatenate(sides, 1)
        squares = by(base)
        step = max(1, min(HELD // (8 * len(x) * q), 1 + HELD // (64 * len(x))))
        made = np.empty((b.num_rows, (len(bins) + 1) * q * (q + p) + 2 * q * v))
        bits = b.column("bits").to_numpy()
        for width in np.unique(bits):
            own = np.flatnonzero(bits == width)
            for first in range(0, len(own), step):  # so many variants that their matrix stays small
                at = own[first : first + step]
                full = _unpacked(b, at, int(width), slot)
                linear, tt = full @ side, (full * full @ squares).reshape(-1, q, q)
                parts, k = [], 0
                for s in weights:
                    twt = tt / s[2] - groups.taken(full, base, s)
                    parts += [twt.reshape(len(at), -1), linear[:, ends[k] : ends[k + 2]]]
                    k += 2
                made[at] = np.concatenate([*parts, tt.reshape(len(at), -1), linear[:, ends[k] :]], 1)
        return pa.table({k: b.column(k) for k in KEYS} | {"m": lists(made)})

    sums = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(tile, "snp_id string, chr string, bp long, m array<double>")
    sums = combine(sums, KEYS)
    x_res, rss = g.xy - g.xx @ beta, g.yy - 2 * (beta * g.xy).sum(0) + np.einsum("iv,ij,jv->v", beta, g.xx, beta)
    df, cov, xx, n_rows = g.n - p - q, fit.gls.cov if fit.gls.cov.ndim == 3 else np.stack([fit.gls.cov] * v), g.xx, g.n

    def estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            flat, at = batch.column(3).flatten().to_numpy().reshape(k, -1), 0

            def take(*shape: int) -> np.ndarray:
                nonlocal at
                n = int(np.prod(shape))
                at += n
                return flat[:, at - n : at].reshape(k, *shape)  # noqa: B023

            by_bin = [(take(q, q), take(q, p), take(q, len(own))) for own in bins]
            tt, tx, tres = take(q, q), take(q, p), take(q, v)
            found = {name: np.full((k, v, q), np.nan) for name in ("beta", "se")}
            wald, bad = np.full((k, v), np.nan), np.ones((k, v), bool)
            for own, (twt, twx, twr) in zip(bins, by_bin, strict=True):
                m = np.einsum("ij,kqj->kiq", cov[own[0]], twx)
                a = twt - np.einsum("kqi,kir->kqr", twx, m)
                low = np.linalg.eigvalsh((a + a.transpose(0, 2, 1)) / 2)[:, 0]
                good = low > 1e-8 * np.maximum(1.0, np.trace(twt, axis1=1, axis2=2))
                inv = np.linalg.pinv(a, hermitian=True)
                b = inv @ twr
                left_tt = tt - np.einsum("kqi,kir->kqr", tx, m) - np.einsum("kiq,kri->kqr", m, tx) + np.einsum("kiq,ij,kjr->kqr", m, xx, m)
                left_res = tres[:, :, own] - np.einsum("kiq,iv->kqv", m, x_res[:, own])
                sse = rss[own] - 2 * (b * left_res).sum(1) + np.einsum("kqv,kqr,krv->kv", b, left_tt, b)
                mse = np.maximum(sse, 0) / df
                se = np.sqrt(np.maximum(np.einsum("kqq->kq", inv)[:, :, None] * mse[:, None, :], 0))
                found["beta"][:, own], found["se"][:, own] = b.transpose(0, 2, 1), se.transpose(0, 2, 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    wald[:, own] = np.einsum("kqv,kqr,krv->kv", b, a, b) / mse
                bad[:, own] = ~good[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                z = found["beta"] / found["se"]
            clean = np.nan_to_num(z).ravel()
            logp = np.abs(signed_log10p(clean)) if test == "z" else -chi2_log10sf(clean**2, 1) if test == "chi" else -np.log10(np.maximum(t_sf2(np.abs(clean), df), 1e-320))
            wp = np.repeat(-chi2_log10sf(np.nan_to_num(wald).ravel(), q), q)
            null = np.repeat(bad.ravel(), q)
            number = lambda x: pa.array(np.asarray(x, float).ravel(), mask=null)  # noqa: B023, E731
            columns = [batch.column(i).take(pa.array(np.repeat(np.arange(k), v * q))) for i in range(3)]
            columns += [pa.array(np.tile(np.repeat(np.array(ys, object), q), k), pa.string()), pa.array(np.tile(np.arange(q, dtype=np.int32), k * v))]
            columns += [number(x) for x in (found["beta"], found["se"], z, logp, np.repeat(wald.ravel(), q), wp)] + [pa.array(null)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in KIND.split(", ")])

    return sums.mapInArrow(estimates, KIND)


def with_main(basis: list[str], one: str = "Intercept") -> list[str]:
    """Basis columns with that of ones, for the main effect."""
    return [*basis, one]


def typed(kind: str, basis: list[str] | None = None, main: bool = True, one: str = "Intercept") -> list[str] | None:
    """The basis columns of the four named kinds: ``cross`` and ``long`` test the variant's own effect, ``cross_interact`` and ``long_interact`` its products with ``basis``, its own effect first with ``main``."""
    if kind not in ("cross", "cross_interact", "long", "long_interact"):
        raise ValueError(f"unknown kind of association {kind}")
    if kind in ("cross", "long"):
        return None
    if not basis:
        raise ValueError(f"{kind} needs basis columns")
    return [one, *basis] if main else list(basis)


def sex_basis(design: DataFrame, sex: str) -> tuple[DataFrame, list[str]]:
    """A 0/1 column for each sex, for a variant's effect within each."""
    levels = sorted(r[0] for r in design.select(sex).where(F.col(sex).isNotNull()).distinct().limit(10).collect())
    return design.withColumns({f"{sex}_{k}": (F.col(sex) == F.lit(k)).cast("double") for k in levels}), [f"{sex}_{k}" for k in levels]


def gather(parts: list[DataFrame]) -> DataFrame:
    """Parts as one table with numeric chromosomes (X 23, Y 24, XY 25, MT 26)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    named = F.create_map(*[x for k, v in {"X": 23, "Y": 24, "XY": 25, "MT": 26}.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("chr", F.coalesce(F.expr("try_cast(chr as int)"), named[F.upper("chr")]))


def split(variants: DataFrame, how: str = "snp", chunk: int = 1000) -> DataFrame:
    """Variants dealt for parallel work, by chromosome or in chunks."""
    if how == "chromosome":
        return variants.repartition("chr")
    n = variants.count()
    return variants.repartition(max(1, -(-n // chunk)))
