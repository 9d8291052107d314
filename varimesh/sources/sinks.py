"""Result sinks: parquet, csv, strict JSON by outcome or by term, full-width maps, and job specs."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    if kind == "parquet":
        w.parquet(path)
    elif kind in ("csv", "tsv"):
        w.csv(path, header=True, sep="," if kind == "csv" else "\t")
    elif kind == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown output {kind}")


def strict(x: Column) -> Column:
    """A number as JSON text; those JSON lacks are the words "NaN", "Inf" and "-Inf"."""
    inf = F.lit(float("inf"))
    word = F.when(F.isnan(x), '"NaN"').when(x == inf, '"Inf"').when(x == -inf, '"-Inf"')
    return F.when(x.isNull(), "null").otherwise(F.coalesce(word, x.cast("string")))


def by_key(stats: DataFrame, key: str, other: str, values: tuple[str, ...] = ("beta", "se", "z", "logp")) -> DataFrame:
    """``(key, json)``: for each outcome (or term) one JSON list over the terms (or outcomes), in their order."""
    parts = [F.concat(F.lit(f'"{v}":'), strict(F.col(v))) for v in values]
    item = F.concat(F.lit('{"'), F.lit(other), F.lit('":"'), F.col(other), F.lit('",'), F.concat_ws(",", *parts), F.lit("}"))
    rows = stats.select(key, F.struct(F.col(other).alias("o"), item.alias("j")).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["j"])
    return rows.groupBy(key).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("json"))


def unmask(stats: DataFrame, mask: DataFrame, columns: list[str], fill: float | None = None) -> DataFrame:
    """Statistics ``(y_id, ...)`` on all places ``(y_id, pos, in_mask)``; places outside have ``fill`` (null where none is given)."""
    out = mask.select("y_id", "pos").join(stats, "y_id", "left")
    return out if fill is None else out.fillna(fill, subset=columns)


def strict_json(value) -> str:
    """JSON of nested Python values with words for numbers that JSON lacks."""

    def clean(x):
        if isinstance(x, float) and not math.isfinite(x):
            return "NaN" if math.isnan(x) else ("Inf" if x > 0 else "-Inf")
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(value), allow_nan=False)


def ordered_terms(stats: DataFrame, of_interest: list[str]) -> DataFrame:
    """Rows with the terms of interest first."""
    return stats.orderBy(F.desc(F.col("term").isin(of_interest)), "y_id", "term")


def hemisphere_ranges(stats: DataFrame, name: str = "roi", value: str = "value", left: str = "lh", right: str = "rh") -> DataFrame:
    """``(region, side, low, high, n)`` of region statistics whose names end in a side, as ``..._lh`` and ``..._rh``; others have no side."""
    side = F.regexp_extract(name, f"_({left}|{right})$", 1)
    rows = stats.select(F.regexp_replace(name, f"_({left}|{right})$", "").alias("region"), F.nullif(side, F.lit("")).alias("side"), F.col(value).alias("v"))
    return rows.groupBy("region", "side").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))


def upper_triangle(df: DataFrame, keys: list[str], column: str, labels: list[str]) -> DataFrame:
    """``(keys, a, b, value)`` of correlation vectors that hold the upper triangle row by row."""
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    long = df.select(*keys, F.posexplode(column).alias("_p", "value")).withColumn("_n", F.get(names, F.col("_p")))
    return long.select(*keys, "_n.a", "_n.b", "value")


def by_term(stats: DataFrame, shares: DataFrame | None = None, wald: DataFrame | None = None, variance: DataFrame | None = None) -> DataFrame:
    """``(kind, key, json)``: JSON lists over the outcomes, one for each fixed effect, random effect (``y_id, effect, share``), Wald test (``y_id, contrast, statistic, df, logp``) and the total variance (``y_id, sigma2``)."""
    parts = [by_key(stats, "term", "y_id").select(F.lit("fixed").alias("kind"), F.col("term").alias("key"), "json")]
    if shares is not None:
        parts.append(by_key(shares, "effect", "y_id", ("share",)).select(F.lit("random").alias("kind"), F.col("effect").alias("key"), "json"))
    if wald is not None:
        parts.append(by_key(wald, "contrast", "y_id", ("statistic", "df", "logp")).select(F.lit("wald").alias("kind"), F.col("contrast").cast("string").alias("key"), "json"))
    if variance is not None:
        whole = variance.withColumn("_all", F.lit("sigma2"))
        parts.append(by_key(whole, "_all", "y_id", ("sigma2",)).select(F.lit("variance").alias("kind"), F.col("_all").alias("key"), "json"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_run(result, path: str, settings: dict | None = None) -> None:
    """Everything of a fitted job under one folder: estimates, shares, design, ids, JSON by outcome and by term, mapping and summary."""
    spark = result.estimates.sparkSession
    write_table(result.estimates, f"{path}/estimates")
    write_table(result.shares, f"{path}/shares")
    design = result.design.df
    ids = [c for c in ("iid", "eid", "fid") if c in design.columns]
    write_table(design.select(*ids, *result.design.columns).withColumnsRenamed({"iid": "participant_id", "eid": "session_id"}), f"{path}/design")
    write_table(design.select(*ids), f"{path}/ids")
    write_table(by_key(result.estimates, "y_id", "term"), f"{path}/by_outcome")
    fit = result.fit.gls
    variance = spark.createDataFrame([(y, float(x)) for y, x in zip(fit.ys, fit.sigma2, strict=True)], "y_id string, sigma2 double")
    write_table(by_term(result.estimates, result.shares, None, variance), f"{path}/by_term", partition_by=["kind"])
    n = design.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("iid").alias("subjects"), F.countDistinct("fid").alias("families")).first().asDict()
    texts = [("summary", strict_json({**n, "settings": settings or {}, "dropped_columns": result.design.dropped, "constant": result.constant})), ("mapping", strict_json(result.design.mapping))]
    for name, text in texts:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    tables = [("estimates", "statistics of every outcome and term"), ("shares", "variance shares"), ("design", "design matrix"), ("ids", "analysed rows"), ("by_outcome", "statistics as JSON by outcome"), ("by_term", "statistics, shares and total variance as JSON by term"), ("summary", "counts and settings"), ("mapping", "columns of each variable")]
    for name, df, what in (("resamples", result.resamples, "resamples"), ("significance", result.significance, "ranks among resamples"), ("dropped", result.dropped, "keys without a partner")):
        if df is not None:
            write_table(df, f"{path}/{name}")
            tables.append((name, what))
    tracker = [{"name": name, "path": f"{path}/{name}", "holds": what} for name, what in tables]
    spark.createDataFrame([(strict_json(tracker),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/files")
