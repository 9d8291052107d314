"""Permutation tests where only some rows may be exchanged, and variances may differ between groups of rows.

Rows lie in blocks. Rows are exchanged within their block, or blocks of like size as wholes, or signs are flipped, of rows or of whole blocks. A permutation is an order by hashes of seed, permutation and key, so it
does not depend on partitions; a block's order is worked out in ranges of hashes, so a block that holds all rows is no one task's. Where all permutations are no more than were asked for, each is taken once.

The tested columns' effect is judged on residuals of the other columns, which are permuted and fitted anew. Of each permutation and variance group only sums of products are kept, from which
comes the G statistic: with one variance group it is F, and for one column it is the square of t.
"""

from __future__ import annotations

from itertools import permutations, product
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linear import gram, inverse
from .storage import saved

#: A number of permutations past which they are not counted.
MANY = 10**18
#: Rows of a block that one range of hashes holds, about.
RANGE = 50_000


def _placed(rows: DataFrame, keys: list[str], key: str, sizes: DataFrame, name: str) -> DataFrame:
    """``rows`` with their place in the order of ``key`` (a long) within ``keys``; ``sizes`` has the number of rows for each."""
    df = rows.join(sizes, [k for k in keys if k in sizes.columns])
    ranges = F.ceil(F.col("_size") / RANGE).cast("long")
    share = F.col(key).cast("double") / float(1 << 64) + 0.5
    df = df.withColumn("_range", F.least(F.floor(share * ranges), ranges - 1).cast("long"))
    counts = df.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for every 50,000 rows
    counts = counts.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(key, "_row"))
    df = df.withColumn("_place", place).join(counts, [*keys, "_range"])
    return df.withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_range", "_place", "_before", "_size")


def number_of_permutations(sizes: list[int], how: str) -> int:
    """How many different orders there are of rows within blocks of these sizes, or of whole blocks of like size."""
    counts = sizes if how == "within" else np.unique(sizes, return_counts=True)[1].tolist()
    out = 1
    for c in counts:
        out *= factorial(c) if c < 25 else MANY
        if out >= MANY:
            return MANY
    return out


def sources(rows: DataFrame, perms: int, how: str = "within", seed: int = 0, signs: bool = False, exhaustive: bool = True) -> tuple[DataFrame, int]:
    """``(perm_id, row, source, sign)`` for permutations 1, 2, ... and their number: in each, ``row`` takes the residual of ``source`` times ``sign``.

    ``rows`` has ``row``, which names each row once, and ``block``; a null block is one block. ``how`` is ``within``, ``whole`` or ``none`` (signs alone). With ``exhaustive`` and few enough permutations, without signs, all of
    them are listed, the unchanged order not among them.
    """
    if how not in ("within", "whole", "none") or (how == "none" and not signs):
        raise ValueError(f"nothing to exchange by {how}")
    spark = rows.sparkSession
    base = rows.select(F.col("row").alias("_row"), F.coalesce(F.xxhash64(F.col("block").cast("string")), F.lit(0)).alias("_block"))
    sizes = saved(base.groupBy("_block").agg(F.count(F.lit(1)).alias("_size")))
    base = saved(_placed(base.withColumn("_k", F.xxhash64("_row")), ["_block"], "_k", sizes, "_at").select("_row", "_block", "_at"))
    if exhaustive and not signs and how != "none":
        few = sizes.limit(perms + 21).collect()  # that many blocks have more permutations, unless each has one row
        if len(few) <= perms + 20 and (total := number_of_permutations([r["_size"] for r in few], how)) <= perms + 1:
            return _listed(spark, base, few, how), total - 1
    every = F.explode(F.expr(f"sequence(1L, {int(perms)}L)"))
    if how == "within":
        drawn = base.withColumn("perm_id", every).withColumn("_k", F.xxhash64(F.lit(seed), "perm_id", "_row"))
        drawn = _placed(drawn, ["perm_id", "_block"], "_k", sizes, "_to").select("perm_id", "_block", F.col("_to").alias("_at"), F.col("_row").alias("source"))
        out = drawn.join(base, ["_block", "_at"]).select("perm_id", F.col("_row").alias("row"), "source", "_block")
    elif how == "whole":
        w = Window.partitionBy("perm_id", "_size")
        blocks = sizes.withColumn("perm_id", every)
        blocks = blocks.withColumn("_i", F.row_number().over(w.orderBy(F.xxhash64("_block"), "_block"))).withColumn("_j", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "perm_id", "_block"), "_block")))
        moved = blocks.select("perm_id", "_size", F.col("_block").alias("_to"), F.col("_i").alias("_r")).join(blocks.select("perm_id", "_size", F.col("_block").alias("_from"), F.col("_j").alias("_r")), ["perm_id", "_size", "_r"])
        out = base.withColumnsRenamed({"_block": "_to", "_row": "row"}).join(moved, "_to").join(base.select(F.col("_block").alias("_from"), "_at", F.col("_row").alias("source")), ["_from", "_at"])
        out = out.select("perm_id", "row", "source", F.col("_to").alias("_block"))
    else:
        out = base.withColumn("perm_id", every).select("perm_id", F.col("_row").alias("row"), F.col("_row").alias("source"), "_block")
    unit = F.col("_block") if how == "whole" else F.xxhash64("row")
    sign = F.when(F.xxhash64(F.lit(seed + 1), "perm_id", unit) % 2 == 0, 1.0).otherwise(-1.0) if signs else F.lit(1.0)
    return out.select("perm_id", "row", "source", sign.alias("sign")), perms


def _listed(spark, base: DataFrame, blocks: list, how: str) -> DataFrame:
    """Every order but the unchanged one; all of them together are few."""
    rows: dict[int, list] = {}
    for r in base.collect():
        rows.setdefault(r["_block"], []).append((r["_at"], r["_row"]))
    rows = {b: [x for _, x in sorted(v)] for b, v in rows.items()}
    if how == "within":
        choices = [[list(zip(v, p, strict=True)) for p in permutations(v)] for v in rows.values()]
    else:
        of_size: dict[int, list] = {}
        for b, v in sorted(rows.items()):
            of_size.setdefault(len(v), []).append(v)
        choices = [[[pair for to, source in zip(v, p, strict=True) for pair in zip(to, source, strict=True)] for p in permutations(v)] for v in of_size.values()]
    out = [(k, a, b, 1.0) for k, picked in enumerate(product(*choices)) if k for part in picked for a, b in part]
    kind = base.schema["_row"].dataType.simpleString()
    return spark.createDataFrame(out, f"perm_id long, row {kind}, source {kind}, sign double")


def g_statistic(my: np.ndarray, yy: np.ndarray, mm: np.ndarray, n: np.ndarray, tested: list[int]) -> np.ndarray:
    """G of each permutation: ``my`` (permutations, groups, columns) and ``yy`` (permutations, groups) are sums of products of a variance group's rows, ``mm`` and ``n`` those of the model."""
    inv = inverse(mm.sum(0))
    beta = my.sum(1) @ inv.T
    rss = yy - 2 * np.einsum("bgp,bp->bg", my, beta) + np.einsum("bp,gpq,bq->bg", beta, mm, beta)
    free = n - np.einsum("pq,gqp->g", inv, mm)  # the sum of the residual-forming matrix's diagonal
    with np.errstate(divide="ignore", invalid="ignore"):
        w = free / np.maximum(rss, 1e-300)
        s = len(tested)
        total = (w * n).sum(1, keepdims=True)
        spread = 1 + 2 * (s - 1) / (s * (s + 2)) * ((1 - w * n / total) ** 2 / free).sum(1)
        out = np.full(len(my), np.nan)
        for b in range(len(my)):
            c = np.linalg.pinv(np.einsum("g,gpq->pq", w[b], mm), hermitian=True)[np.ix_(tested, tested)]
            t = beta[b, tested]
            out[b] = t @ np.linalg.pinv(c, hermitian=True) @ t / (spread[b] * s)
    return out


def permutation_test(df: DataFrame, xs: list[str], y: str, tested: list[str], perms: int = 1000, how: str = "within", seed: int = 0, signs: bool = False, exhaustive: bool = True) -> DataFrame:
    """``(perm_id, statistic, logp)``, permutation 0 being the data: the effect of ``tested`` among ``xs`` on ``y``.

    ``df`` has ``row``, ``block`` and, where variances differ, ``variance_group``. ``logp`` is -log10 of the share of all orders, the unchanged one included, that reach the observed statistic.
    """
    rest = [x for x in xs if x not in tested]
    if unknown := [x for x in tested if x not in xs]:
        raise ValueError(f"{', '.join(unknown)} is not in the model")
    c = lambda name: F.col(f"`{name}`").cast("double")
    group = F.col("variance_group").cast("string") if "variance_group" in df.columns else F.lit("")
    rows = saved(df.select("row", "block", F.coalesce(group, F.lit("")).alias("g"), *[c(x).alias(f"x{i}") for i, x in enumerate(xs)], c(y).alias("y")))
    at = [xs.index(x) for x in rest]
    if rest:
        fit = gram(rows, [f"x{i}" for i in at], ["y"])
        gamma = inverse(fit.xx) @ fit.xy[:, 0]
        fitted = sum((F.lit(float(b)) * F.col(f"x{i}") for b, i in zip(gamma, at, strict=True)), F.lit(0.0))
    else:
        fitted = F.lit(0.0)
    rows = saved(rows.withColumn("r", F.col("y") - fitted).drop("y"))
    moves, n_perms = sources(rows, perms, how, seed, signs, exhaustive)
    unchanged = rows.select(F.lit(0).cast("long").alias("perm_id"), "row", F.col("row").alias("source"), F.lit(1.0).alias("sign"))
    given = unchanged.unionByName(moves).join(rows.select(F.col("row").alias("source"), "r"), "source").select("perm_id", "row", (F.col("r") * F.col("sign")).alias("r"))
    p = len(xs)
    sums = given.join(rows.drop("r", "block"), "row").groupBy("perm_id", "g").agg(F.sum(F.col("r") ** 2).alias("yy"), *[F.sum(F.col(f"x{i}") * F.col("r")).alias(f"m{i}") for i in range(p)])
    model = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i in range(p) for j in range(p)]).orderBy("g").collect()
    if not model:
        return df.sparkSession.createDataFrame([], "perm_id long, statistic double, logp double")
    place = {r["g"]: k for k, r in enumerate(model)}
    my, yy = np.zeros((n_perms + 1, len(model), p)), np.zeros((n_perms + 1, len(model)))
    for r in sums.toLocalIterator():  # a row for each permutation and variance group
        my[r["perm_id"], place[r["g"]]], yy[r["perm_id"], place[r["g"]]] = r[3:], r["yy"]
    mm = np.array([r[2:] for r in model], float).reshape(len(model), p, p)
    g = g_statistic(my, yy, mm, np.array([r["n"] for r in model], float), [xs.index(x) for x in tested])
    reached = float((g >= g[0] * (1 - 1e-10)).sum())
    return df.sparkSession.createDataFrame([(k, float(x), float(-np.log10(reached / len(g)))) for k, x in enumerate(g)], "perm_id long, statistic double, logp double")
