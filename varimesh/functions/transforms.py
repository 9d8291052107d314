"""Column transforms of a design: centring, scaling, ranks, winsorising, differences from a baseline, dummy coding, interactions.

Constants such as means, levels and percentiles come from one small aggregate and enter the plan as literals, so a transform adds no
shuffle of its own; ranks alone need an order.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dist import norm_ppf_col

MISSING = ("n/a", "NaN", "NaT", "<undefined>", " ", "NA")


def blank_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing-value words and nan as null."""
    out = {}
    for name, kind in df.dtypes:
        if columns is None or name in columns:
            if kind == "string":
                out[name] = F.when(~F.col(name).isin(*MISSING), F.col(name))
            elif kind in ("double", "float"):
                out[name] = F.when(~F.isnan(name), F.col(name))
    return df.withColumns(out)


def _constants(df: DataFrame, columns: dict[str, Column]) -> dict:
    return df.agg(*[c.alias(k) for k, c in columns.items()]).first().asDict() if columns else {}


def scale(df: DataFrame, columns: list[str], how: str) -> DataFrame:
    """``center``, ``std``, ``logn``, ``log10`` or ``ranknorm`` of each column, as ``<column>_<how>``. Nulls are left out and stay null.

    Logarithms of numbers that are not positive are null.
    """
    if how in ("logn", "log10"):
        f = F.ln if how == "logn" else F.log10
        return df.withColumns({f"{c}_{how}": F.when(F.col(c) > 0, f(c)) for c in columns})
    if how == "ranknorm":
        for c in columns:
            df = rank_normal(df, c)
        return df
    if how not in ("center", "std"):
        raise ValueError(f"unknown transform {how}")
    k = _constants(df, {f"m_{c}": F.avg(c) for c in columns} | {f"s_{c}": F.stddev_samp(c) for c in columns})
    moved = {c: F.col(c) - F.lit(k[f"m_{c}"]) for c in columns}
    return df.withColumns({f"{c}_{how}": moved[c] / F.lit(k[f"s_{c}"]) if how == "std" else moved[c] for c in columns})


def tied_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average ranks of the values that are not null, from counts of distinct values.

    Only distinct values are ordered, each with its count; a running total over ranges of them gives the ranks, and a join brings
    them back. So no task sorts all rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange(column).withColumn("part", F.spark_partition_id())
    from varimesh.operators.storage import saved

    ranged = saved(ranged)
    before = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = before.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum("n").over(Window.partitionBy("part").orderBy(column))
    ranks = ranged.join(F.broadcast(before.select("part", "before")), "part").select(F.col(column).alias("_v"), (F.col("before") + own - (F.col("n") - 1) / 2).alias(out))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def rank_normal(df: DataFrame, column: str) -> DataFrame:
    """``<column>_ranknorm``: the normal quantile of rank / (n + 1)."""
    n = df.agg(F.count(column)).first()[0]
    ranked = tied_rank(df, column, "_rank")
    return ranked.withColumn(f"{column}_ranknorm", norm_ppf_col(F.col("_rank") / F.lit(float(n + 1)))).drop("_rank")


def hazen(df: DataFrame, column: str, percents: list[float]) -> list[float]:
    """Percentiles with midpoint positions (k - 0.5) / n, linear between them.

    Exact, from two neighbouring order statistics each: the running counts over distinct values find them without sorting all rows in a task.
    """
    from varimesh.operators.storage import saved

    counts = df.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ranged = saved(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.sum("c").alias("total"))
    n = before.agg(F.sum("total")).first()[0]
    if not n:
        return [None] * len(percents)
    at = []
    for p in percents:
        x = min(max(p / 100 * n + 0.5, 1.0), float(n))
        at.append((int(x), min(int(x) + 1, n), x - int(x)))
    wanted = sorted({k for lo, hi, _ in at for k in (lo, hi)})
    before = before.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a value with c copies covers the ranks from last - c + 1 to last
    last = F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    ranks = ranged.join(F.broadcast(before.select("part", "before")), "part").select("v", "c", last.alias("last"))
    got = ranks.agg(*[F.max(F.when((F.col("last") - F.col("c") < k) & (F.col("last") >= k), F.col("v"))).alias(f"k{k}") for k in wanted]).first()
    return [got[f"k{lo}"] + w * (got[f"k{hi}"] - got[f"k{lo}"]) for lo, hi, w in at]


def winsorize(df: DataFrame, column: str, low: float = 0, high: float = 100) -> DataFrame:
    """``<column>_winsorized``: values beyond the two percentiles are set to them."""
    lo, hi = hazen(df, column, sorted([low, high]))
    return df.withColumn(f"{column}_winsorized", F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.lit(lo)), F.lit(hi))))


def quadratic(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({f"{column}_main": F.col(column), f"{column}_quadratic": F.col(column) * F.col(column)})


def delta(df: DataFrame, column: str, subject: str = "iid", order: str = "eid") -> DataFrame:
    """``<column>_baseline``, each subject's value at the smallest ``order``, and ``<column>_delta``, the difference from it.

    ``order`` may also be an age column. The baseline is a grouped minimum joined back.
    """
    base = df.groupBy(subject).agg(F.min_by(column, order).alias(f"{column}_baseline"))
    return df.join(base, subject).withColumn(f"{column}_delta", F.col(column) - F.col(f"{column}_baseline"))


def baseline_square(column: str) -> Column:
    """Twice the square of a baseline that :func:`delta` made."""
    return F.col(f"{column}_baseline") ** 2 * 2


def levels(df: DataFrame, column: str, reference: str = "mode", most: int = 10_000) -> tuple[list, object]:
    """Sorted levels and the one left out: ``mode`` (ties: first in order), ``first``, ``last``, ``none`` or a level; an unknown level means the mode."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} levels")
    count = {r[column]: r["count"] for r in rows}
    names = sorted(count)
    mode = min(names, key=lambda v: (-count[v], names.index(v))) if names else None
    left_out = {"mode": mode, "first": names[0] if names else None, "last": names[-1] if names else None, "none": None}
    return names, left_out[reference] if reference in left_out else (reference if reference in count else mode)


def dummies(df: DataFrame, column: str, reference: str = "mode") -> tuple[DataFrame, list[str]]:
    """A 0/1 column ``<column>_<level>`` for each level but the reference."""
    names, left_out = levels(df, column, reference)
    made = {f"{column}_{v}": (F.col(column) == F.lit(v)).cast("double") for v in names if v != left_out}
    return df.withColumns(made), list(made)


def interaction(df: DataFrame, parts: list[list[str]]) -> tuple[DataFrame, list[str]]:
    """Products over all combinations of the parts' columns, named ``a__b``."""
    names: list[list[str]] = [[]]
    for columns in parts:
        names = [[*n, c] for n in names for c in columns]
    made = {"__".join(n): reduce(lambda a, b: a * b, [F.col(c).cast("double") for c in n]) for n in names}
    return df.withColumns(made), list(made)


def lower_order(terms: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The interactions with all their lower orders of two or more, each set once."""
    seen: dict[frozenset, tuple[str, ...]] = {}
    for t in terms:
        for k in range(2, len(t) + 1):
            for c in combinations(t, k):
                seen.setdefault(frozenset(c), c)
    return sorted(seen.values(), key=len)


def impute_mean(g: Column) -> Column:
    """An array of dosages with nulls replaced by the mean of the others."""
    known = F.filter(g, lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.transform(g, lambda x: F.coalesce(x.cast("double"), mean))
