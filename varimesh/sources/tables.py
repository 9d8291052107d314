"""Tabular sources: parquet, csv and tsv files spread over folders, with inferred or required columns."""

from __future__ import annotations

import json
import re
import tomllib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITY = ("parquet", "csv", "tsv", "txt")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = True) -> DataFrame:
    """A table by its extension, parquet where there is none; only ``columns`` are read, and a missing one is an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        df = spark.read.csv(path, header=header, inferSchema=True, sep="," if kind == "csv" else "\t", nanValue="NaN")
    else:
        df = spark.read.parquet(path if kind == "parquet" else f"{path}.parquet")
    if columns:
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        df = df.select(*columns)
    return df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def discover(spark: SparkSession, roots: list[str]) -> dict[str, str]:
    """Base name to path for all tables under the roots; of one name the better format wins, then the earlier root. Listed by Spark's own file systems."""
    found: dict[str, tuple[int, int, str]] = {}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for k, root in enumerate(roots):
        p = path(root)
        for status in p.getFileSystem(conf).listStatus(p):
            name, _, kind = status.getPath().getName().rpartition(".")
            if kind in PRIORITY:
                key = (PRIORITY.index(kind), k, status.getPath().toString())
                found[name] = min(found.get(name, key), key)
    return {n: key[2] for n, key in found.items()}


def locate(spark: SparkSession, files: dict[str, str], variables: list[str]) -> dict[str, list[str]]:
    """Path to the variables it provides; the first file in name order wins, an unknown variable is an error. Only schemas are read."""
    left, out = list(variables), {}
    for name in sorted(files):
        if not left:
            break
        has = set(read_table(spark, files[name]).columns)
        if own := [v for v in left if v in has]:
            out[files[name]] = own
            left = [v for v in left if v not in has]
    if left:
        raise ValueError(f"no file has {', '.join(left)}")
    return out


def load_variables(spark: SparkSession, roots: list[str], variables: list[str], ids: tuple[str, ...] = ("participant_id", "session_id"), rename: dict[str, str] | None = None) -> DataFrame:
    """Inner join of the files that hold the variables, on the ids that both sides have; a table without visits joins on the subject alone."""
    parts = []
    for path, own in locate(spark, discover(spark, roots), variables).items():
        df = read_table(spark, path)
        parts.append(df.select(*[i for i in ids if i in df.columns], *own))
    parts.sort(key=lambda d: -len([i for i in ids if i in d.columns]))
    out = reduce(lambda a, b: a.join(b, [i for i in ids if i in a.columns and i in b.columns]), parts)
    return out.withColumnsRenamed(rename or {})


def read_two_headers(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, dict[str, str]]:
    """A text table whose second line describes its columns: the rows, and the description of each column. A column of which every value is a number becomes one."""
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False, nullValue="NA")
    names = raw.columns
    head = spark.read.text(path).limit(2).collect()
    labels = next(iter(spark.read.csv(spark.sparkContext.parallelize([head[1]["value"]], 1), sep=sep).collect()), None) if len(head) > 1 else None
    if labels is None:
        return raw, {}
    labels = dict(zip(names, labels, strict=False))
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.lit(labels.get(c))) for c in names])
    rows = raw.where(~same)
    numbers = rows.agg(*[(F.count(f"`{c}`") == F.count(F.expr(f"try_cast(`{c}` as double)"))).alias(c) for c in names]).first()
    return rows.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) if numbers[c] else F.col(f"`{c}`") for c in names]), labels


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One unnamed column of ids."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def numeric_only(df: DataFrame, keep: list[str]) -> DataFrame:
    """The ids and all numeric columns."""
    number = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return df.select(*keep, *[c for c, t in df.dtypes if c not in keep and (t in number or t.startswith("decimal"))])


def hemispheres(left: DataFrame, right: DataFrame, keys: list[str], column: str, size: int) -> DataFrame:
    """Two surface arrays cut to ``size`` vertices and laid end to end."""
    both = left.select(*keys, F.col(column).alias("_l")).join(right.select(*keys, F.col(column).alias("_r")), keys)
    return both.select(*keys, F.concat(F.slice("_l", 1, size), F.slice("_r", 1, size)).alias(column))


def vertices(order: int) -> int:
    """Vertices of an icosahedron subdivided ``order`` times."""
    return 10 * 4**order + 2


def read_json(text: str) -> dict:
    return json.loads(text)


def read_toml(text: str) -> dict:
    return tomllib.loads(text)


def read_config(text: str) -> dict[str, str]:
    """``key: value`` lines; blank lines and lines that begin with # or % are left out."""
    out = {}
    for line in text.splitlines():
        if line.strip() and line.strip()[0] not in "#%" and ":" in line:
            k, _, v = line.partition(":")
            out[k.strip()] = v.strip()
    return out


def contrasts(df: DataFrame, terms: list[str], kind: str = "Type", value: str = "hypValue") -> list[tuple[str, list[list[float]], list[float]]]:
    """Sets of contrast rows by their type, matched to terms by name: rows of type ``u...`` stand alone, those of one ``m...`` belong together."""
    rows = [r.asDict() for r in df.collect()]
    sets: dict[str, list[dict]] = {}
    for k, r in enumerate(rows):
        sets.setdefault(r[kind] if str(r[kind]).startswith("m") else f"{r[kind]}#{k}", []).append(r)
    line = lambda r: [float(r.get(t) or 0) for t in terms]
    return [(re.sub(r"#\d+$", "", str(n)), [line(r) for r in own], [float(r.get(value) or 0) for r in own]) for n, own in sets.items()]
