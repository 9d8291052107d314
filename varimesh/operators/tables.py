"""Joins and filters that line design, outcomes and side tables up, with an account of what was dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["iid", "eid"]


def join_all(parts: list[DataFrame], ids: list[str]) -> DataFrame:
    """Inner join of tables on the ids that both sides have."""
    return reduce(lambda a, b: a.join(b, [i for i in ids if i in a.columns and i in b.columns]), parts)


def align(x: DataFrame, y: DataFrame, keys: list[str] = KEYS, order: list[str] | None = None) -> DataFrame:
    """Design and outcomes on their keys; of rows with one key the first by ``order`` (all columns, if none is given) counts."""
    return first_of(x, keys, order).join(first_of(y, keys, order), keys)


def first_of(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key, the smallest by ``order``: a grouped minimum of structs, which combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    first = [*[c for c in (order or []) if c in rest], *[c for c in rest if c not in (order or [])]]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in first])).alias("_b"))
    return best.select(*keys, *[F.col("_b").getField(c).alias(c) for c in rest])


def dropped(x: DataFrame, y: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``(side, keys)``: keys of one side that the other lacks."""
    a, b = x.select(*keys).distinct(), y.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("design")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("outcome")))


def fill_families(df: DataFrame, families: DataFrame, subject: str = "iid") -> DataFrame:
    """Family numbers by left join; subjects without one get the numbers after the largest, in the order of their ids."""
    out = df.join(families, subject, "left")
    lone = out.where("fid is null").select(subject).distinct()
    top = out.agg(F.coalesce(F.max("fid"), F.lit(0)).alias("top")).first()["top"]
    # numbered within ranges of ids, then moved on by what came before: no task numbers them all
    ranged = lone.repartitionByRange(subject).withColumn("part", F.spark_partition_id())
    from .storage import saved

    ranged = saved(ranged)
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    new = ranged.join(F.broadcast(counts.select("part", "before")), "part")
    new = new.select(subject, (F.row_number().over(Window.partitionBy("part").orderBy(subject)) + F.col("before") + F.lit(top)).alias("_new"))
    return out.join(new, subject, "left").withColumn("fid", F.coalesce("fid", "_new")).drop("_new")


def keep_pairs(df: DataFrame, pairs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.join(pairs, keys, "left_semi")


def keep_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=columns)


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(variable, n_missing)`` in one pass."""
    counts = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("n_missing")) for c in columns])).alias("r")).select("r.*")


def finite(column: str) -> Column:
    """Whether all numbers of an array column are there and finite."""
    inf = float("inf")
    return F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (v != inf) & (v != -inf))


def audit(df: DataFrame, filters: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass every filter, and ``(reason, n)`` of those that fail each; null counts as failing."""
    ok = {k: F.coalesce(c, F.lit(False)) for k, c in filters.items()}
    counts = df.agg(*[F.count(F.when(~c, 1)).alias(k) for k, c in ok.items()])
    table = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(k).alias("n")) for k in ok])).alias("r")).select("r.*")
    return df.where(reduce(lambda a, b: a & b, ok.values())), table


def quality(df: DataFrame, qc: DataFrame, variable: str, keys: list[str]) -> DataFrame:
    """Rows whose key passed quality control (the text '1')."""
    return df.join(qc.where(F.col(variable).cast("string") == "1").select(*keys), keys, "left_semi")


def varying(df: DataFrame, column: str) -> DataFrame:
    """``(pos, in_mask)``: places of an array column whose values differ."""
    long = df.select(F.posexplode(column).alias("pos", "v"))
    return long.groupBy("pos").agg(F.coalesce(F.stddev_samp("v") > 0, F.lit(False)).alias("in_mask"))


def check_inputs(df: DataFrame, xs: list[str], ys: list[str]) -> list[str]:
    """Raise where X or Y has missing or infinite values; return the outcomes that do not vary."""
    bad = lambda c: F.count(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), 1))
    row = df.agg(*[bad(c).alias(f"b_{c}") for c in (*xs, *ys)], *[F.stddev_samp(c).alias(f"s_{c}") for c in ys]).first()
    if wrong := [c for c in (*xs, *ys) if row[f"b_{c}"]]:
        raise ValueError(f"missing or infinite values in {', '.join(wrong)}")
    return [y for y in ys if not row[f"s_{y}"]]


def region_means(values: DataFrame, atlas: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(key, roi, mean, total, n)`` of places that belong to a region with at least the threshold."""
    both = values.join(atlas.where(F.col("weight") >= threshold), "pos")
    return both.groupBy("key", "roi").agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def propagate(stats: DataFrame, atlas: DataFrame) -> DataFrame:
    """Region statistics on the places of the atlas: weights times values, summed."""
    return atlas.join(stats, "roi").groupBy("pos").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def map_names(df: DataFrame, column: str, names: dict[str, str]) -> Column:
    """The mapped name of the longest key that stands in the column as a whole token."""
    out = F.lit(None).cast("string")
    for key in sorted(names, key=lambda k: (len(k), k)):
        out = F.when(F.col(column).rlike(rf"(^|__){key}(?=_|$)"), F.lit(names[key])).otherwise(out)
    return out


def region_key(column: Column) -> Column:
    """A region's name without its suffix of a mean, from what follows the last ``parc__`` on."""
    return F.substring_index(F.regexp_replace(column, "(_wmean|_mean)$", ""), "parc__", -1)


def significant(stats: DataFrame, logp: str, p: float) -> DataFrame:
    """Rows whose p-value is at most ``p``."""
    return stats.where(F.abs(logp) >= -F.log10(F.lit(p)))


def clean_scores(df: DataFrame, column: str, least: float = 0.0) -> DataFrame:
    """Input of a plot along the genome: the sizes of finite values, from ``least`` on."""
    size = F.abs(column)
    return df.withColumn(column, size).where(F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) < float("inf")) & (F.col(column) >= least))


def mask_by_probability(values: DataFrame, atlas: DataFrame, threshold: float, above: bool = True) -> DataFrame:
    """Values at places whose tissue probability in ``atlas`` (``pos``, ``probability``) is at least, or else under, the threshold."""
    keep = F.col("probability") >= threshold if above else F.col("probability") < threshold
    return values.join(atlas.where(keep).select("pos"), "pos", "left_semi")


def visits(df: DataFrame, pattern: str, column: str = "eid") -> DataFrame:
    """Rows whose visit matches a pattern."""
    return df.where(F.col(column).rlike(pattern))


def recode(column: Column, cases: list[tuple[Column, object]], other: object = None) -> Column:
    """The value of the first case that holds; a column as ``other`` stands for itself."""
    out = other if isinstance(other, Column) else F.lit(other)
    for when, value in reversed(cases):
        out = F.when(when, F.lit(value)).otherwise(out)
    return F.when(column.isNotNull(), out)


def in_family_order(df: DataFrame, age: str) -> DataFrame:
    """``place``: a row's place in its family, subjects with more rows first, a subject's rows by ``age``. Only families are ordered, each by itself."""
    df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("fid", "iid")))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("fid").orderBy(F.desc("_n"), "iid", age))).drop("_n")


def running(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """The running total of ``value`` in the order of a column: within ranges, each moved on by the total of those before it."""
    from .storage import saved

    ranged = saved(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").agg(F.sum(value).alias("_before"))  # a row for each range
    before = before.withColumn("_before", F.coalesce(F.sum("_before").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn(out, own).join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def cost_fractions(df: DataFrame, order: str, cost: str, parts: int) -> DataFrame:
    """``part``: which of ``parts`` stretches of equal cost a row falls in, along the order."""
    total = df.agg(F.sum(cost)).first()[0] or 0
    share = F.floor(parts * F.col("_run") / F.lit(float(total or 1)))
    return running(df, order, cost, "_run").withColumn("part", F.least(share, F.lit(parts - 1)).cast("long")).drop("_run")


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """``(bucket, n, total)``: counts of cells of a width, and their running total."""
    cells = df.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("total", F.sum("n").over(Window.orderBy("bucket")))


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the curve by rank sums over distinct scores; ties count one half. Scores are ordered in ranges with running counts, so no task sorts them all."""
    from .storage import saved

    by = by or []
    per = df.groupBy(*by, score).agg(F.sum(label).alias("pos"), (F.count(F.lit(1)) - F.sum(label)).alias("neg"))
    ranged = saved(per.repartitionByRange(*by, score).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy(*by, "part").agg(F.sum("neg").alias("before"))  # a row for each range
    before = before.withColumn("before", F.sum("before").over(Window.partitionBy(*by).orderBy("part")) - F.col("before"))
    own = F.sum("neg").over(Window.partitionBy(*by, "part").orderBy(score)) - F.col("neg")
    per = ranged.withColumn("own", own).join(F.broadcast(before), [*by, "part"])
    below = F.col("before") + F.col("own")
    return per.groupBy(*by).agg((F.sum(F.col("pos") * (below + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def correlation(df: DataFrame, score: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Pearson's correlation of scores with a measured value."""
    return df.groupBy(*(by or [])).agg(F.corr(score, value).alias("correlation"))


def cohen_d(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Difference of the mean scores of the two classes over their pooled standard deviation."""
    of = lambda f, k: f(F.when(F.col(label) == k, F.col(score)))
    n1, n0 = of(F.count, 1), of(F.count, 0)
    pooled = F.sqrt(((n1 - 1) * of(F.var_samp, 1) + (n0 - 1) * of(F.var_samp, 0)) / (n1 + n0 - 2))
    return df.groupBy(*(by or [])).agg(((of(F.avg, 1) - of(F.avg, 0)) / pooled).alias("cohen_d"))


def folds(column: str, k: int, seed: int = 0) -> Column:
    """The fold of a family, from its hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(k)).cast("int")


def qq(df: DataFrame, logp: str, step: float = 0.01) -> DataFrame:
    """Observed quantiles of -log10 p on a grid: ``(bucket, n, above)``; counts of grid cells, then a running total over them."""
    cells = df.where(F.col(logp).isNotNull() & ~F.isnan(logp)).groupBy(F.floor(F.abs(logp) / step).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("bucket"))))


def genome_positions(df: DataFrame) -> DataFrame:
    """``x``: position along all chromosomes laid end to end."""
    ends = df.groupBy("chr").agg(F.max("bp").alias("len"))
    ends = ends.withColumn("start", F.coalesce(F.sum("len").over(Window.orderBy(F.col("chr").cast("int"), "chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.join(F.broadcast(ends.select("chr", "start")), "chr").withColumn("x", F.col("start") + F.col("bp")).drop("start")
