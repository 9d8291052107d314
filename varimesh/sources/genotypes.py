"""PLINK files and relatedness matrices.

A ``.bed`` file holds one block of two-bit codes for each variant, a relatedness file one triangle of numbers. Both are read by byte ranges: a partition is a
range of variants, or of lines of the triangle, and its task reads those bytes only. Stores are those that pyarrow can open (mounted file systems, hdfs, s3 and
others); a path without a scheme is in Spark's default store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Copies of the first allele for the codes 00, 01, 10 and 11; -1 is missing (fixed values).
DOSAGE = np.array([2, -1, 1, 0], np.int8)
MAGIC = bytes([108, 27, 1])
_table = DOSAGE[(np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3]
#: Bytes of a file that a partition covers, and that its task holds at a time.
RANGE, HELD = 64 << 20, 4 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the store that Spark finds it in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + out[5:] if out.startswith("file:/") and not out.startswith("file://") else out


def _opened(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(row, c)``: the words of each line and its number from 0. File parts are counted and their counts added up, so no task sorts all lines."""
    lines = spark.read.text(path).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("_o"), F.split(F.trim("value"), r"\s+").alias("c"))
    counts = {r["part"]: r["count"] for r in lines.groupBy("part").count().collect()}
    before, at = {}, 0
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    starts = F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n))]) if before else F.lit(None)
    return lines.select((F.col("_o").bitwiseAND(F.lit((1 << 33) - 1)) + starts[F.col("part")]).alias("row"), "c")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """``(row, fid, iid)`` in file order."""
    return _numbered(spark, path).select("row", F.col("c")[0].alias("fid"), F.col("c")[1].alias("iid"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """``(row, chr, snp_id, bp)`` in file order."""
    return _numbered(spark, path).select("row", F.col("c")[0].alias("chr"), F.col("c")[1].alias("snp_id"), F.col("c")[3].cast("long").alias("bp"))


def _runs(places: list[int]) -> str:
    """Numbers as runs, ``0-9,12``: each run of rising neighbours is one."""
    x = np.array(places, np.int64)
    cuts = np.flatnonzero(np.diff(x, prepend=-2) != 1)
    ends = np.append(cuts[1:], len(x)) - 1
    return ",".join(f"{x[a]}-{x[b]}" for a, b in zip(cuts, ends, strict=True))


def _places(runs: str) -> np.ndarray:
    pairs = [tuple(map(int, r.split("-"))) for r in runs.split(",")] if runs else []
    return np.concatenate([np.arange(a, b + 1) for a, b in pairs]) if pairs else np.zeros(0, np.int64)


class Span(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class BedSource(DataSource):
    """Variants of a ``.bed`` file: ``path``, ``subjects`` (their number in the file), ``keep`` (their places as runs, all without it), ``range`` (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "varimesh_bed"

    def schema(self) -> str:
        return "row long, dosages array<tinyint>"

    def reader(self, schema) -> BedReader:
        return BedReader(self.options)


class BedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.n = options["path"], int(options["subjects"])
        self.keep = options.get("keep")
        self.record, self.range = -(-self.n // 4), int(options.get("range", RANGE))

    def partitions(self) -> list[Span]:
        with _opened(self.path) as f:
            size = f.size()
            if f.read(3) != MAGIC:
                raise ValueError(f"{self.path} is not a variant-major .bed file")
        if not self.record or (size - 3) % self.record:
            raise ValueError(f"{self.path} has {size} bytes, which is not 3 and whole variants of {self.n} subjects")
        variants, step = (size - 3) // self.record, max(1, self.range // self.record)
        return [Span(a, min(variants, a + step)) for a in range(0, variants, step)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        keep = None if self.keep is None else _places(self.keep)
        width, step = self.n if keep is None else len(keep), max(1, HELD // max(self.record, self.n))
        with _opened(self.path) as f:
            f.seek(3 + partition.first * self.record)
            for at in range(partition.first, partition.end, step):
                rows = min(step, partition.end - at)
                raw = np.frombuffer(f.read(rows * self.record), np.uint8)
                g = _table[raw.reshape(rows, self.record)].reshape(rows, -1)[:, : self.n]
                flat = np.ascontiguousarray(g if keep is None else g[:, keep]).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(flat, mask=flat < 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + rows)), lists], ["row", "dosages"])


class TriangleSource(DataSource):
    """A triangle of numbers as ``(a, b, rel)`` with a > b: ``path``, ``n``, ``layout`` (``rows``: lower triangle with its diagonal, floats; ``columns``: without, doubles), ``range``."""

    @classmethod
    def name(cls) -> str:
        return "varimesh_triangle"

    def schema(self) -> str:
        return "a long, b long, rel double"

    def reader(self, schema) -> TriangleReader:
        return TriangleReader(self.options)


class TriangleReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.n, self.by_row = options["path"], int(options["n"]), options["layout"] == "rows"
        self.kind, self.range = np.dtype("<f4" if self.by_row else "<f8"), int(options.get("range", RANGE))

    def before(self, k: int) -> int:
        """Numbers before line k."""
        return k * (k + 1) // 2 if self.by_row else k * (self.n - 1) - k * (k - 1) // 2

    def partitions(self) -> list[Span]:
        with _opened(self.path) as f:
            if f.size() != self.before(self.n) * self.kind.itemsize:
                raise ValueError(f"{self.path} has {f.size()} bytes, which is no triangle of {self.n} subjects")
        out, first = [], 0
        for k in range(1, self.n + 1):
            if k == self.n or (self.before(k + 1) - self.before(first)) * self.kind.itemsize > self.range:
                out.append(Span(first, k))
                first = k
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as f:
            f.seek(self.before(partition.first) * self.kind.itemsize)
            for k in range(partition.first, partition.end):
                x = np.frombuffer(f.read((self.before(k + 1) - self.before(k)) * self.kind.itemsize), self.kind).astype(float)
                a, b, x = (np.full(k, k), np.arange(k), x[:k]) if self.by_row else (np.arange(k + 1, self.n), np.full(self.n - 1 - k, k), x)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(x)], ["a", "b", "rel"])


def read_bed(spark: SparkSession, path: str, n: int, subjects: list[int] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """``(row, dosages)`` for each variant, of ``subjects`` (places in the .fam file) only where given. A task reads one range of variants.

    A file that does not begin as a variant-major .bed file, or whose length is not that of whole variants, raises.
    """
    spark.dataSource.register(BedSource)
    r = spark.read.format("varimesh_bed").option("path", qualified(spark, path)).option("subjects", n).option("range", range_bytes)
    return (r if subjects is None else r.option("keep", _runs(subjects))).load()


def genotypes(spark: SparkSession, stem: str, iids: list[str] | None = None, snps: DataFrame | None = None) -> DataFrame:
    """``(snp_id, chr, bp, dosages)`` from ``<stem>.bed``, ``.bim`` and ``.fam``; subjects in the order of ``iids``, variants in ``snps`` (``snp_id``)."""
    fam = read_fam(spark, f"{stem}.fam").collect()
    where = {r["iid"]: r["row"] for r in fam}
    if iids is not None and (missing := [i for i in iids if i not in where]):
        raise ValueError(f"{len(missing)} subjects have no genotype, such as {missing[0]}")
    bim = read_bim(spark, f"{stem}.bim")
    if snps is not None:
        bim = bim.join(snps, "snp_id", "left_semi")
    bed = read_bed(spark, f"{stem}.bed", len(fam), None if iids is None else [where[i] for i in iids])
    return bed.join(bim, "row").select("snp_id", "chr", "bp", "dosages")


def check(spark: SparkSession, stem: str, iids: DataFrame | None = None, snps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a genotype file holds of what is asked for, before anything of it is read: ``(iid, row, in_file)`` and ``(snp_id, chr, bp, row, in_file)``.

    Without ``iids`` (``iid``) or ``snps`` (``snp_id``) all that the file lists is asked for. Asked twice counts once.
    """
    fam, bim = read_fam(spark, f"{stem}.fam").select("iid", "row"), read_bim(spark, f"{stem}.bim")
    subjects = fam if iids is None else iids.select(F.col("iid").cast("string")).distinct().join(fam, "iid", "left")
    variants = bim if snps is None else snps.select("snp_id").distinct().join(bim, "snp_id", "left")
    flag = F.col("row").isNotNull().alias("in_file")
    return subjects.select("iid", "row", flag), variants.select("snp_id", "chr", "bp", "row", flag)


def long_dosages(variants: DataFrame, subjects: DataFrame) -> DataFrame:
    """``(snp_id, chr, bp, iid, dosage)`` from dosage arrays; ``subjects`` has each ``iid`` with its ``place`` in them."""
    long = variants.select("snp_id", "chr", "bp", F.posexplode("dosages").alias("place", "dosage"))
    return long.join(subjects.select("iid", "place"), "place").select("snp_id", "chr", "bp", "iid", "dosage")


def standardise(df: DataFrame, how: str = "none", impute: bool = True, round_off: bool = False) -> DataFrame:
    """Dosages as doubles: mean-imputed, rounded to at most 2, then ``center``, ``empirical`` (standard deviation) or ``gcta`` (allele frequency) scaled.

    Array expressions only. A variant without any spread, or without any value, becomes zeros where it would be divided by zero.
    """
    from varimesh.functions.transforms import impute_mean

    g = impute_mean(F.col("dosages")) if impute else F.transform("dosages", lambda x: x.cast("double"))
    df = df.withColumn("g", g)
    if round_off:
        df = df.withColumn("g", F.transform("g", lambda x: F.least(F.round(x), F.lit(2.0))))
    known = F.filter("g", lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    df = df.withColumn("_m", mean)
    square = F.aggregate(F.filter("g", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + (x - F.col("_m")) ** 2)
    if how == "empirical":
        df = df.withColumn("_s", F.sqrt(square / (F.size(known) - 1)))
    elif how == "gcta":
        df = df.withColumn("_s", F.sqrt(F.col("_m") * (1 - F.col("_m") / 2)))
    else:
        df = df.withColumn("_s", F.lit(1.0))
    if how != "none":
        df = df.withColumn("g", F.transform("g", lambda x: F.when(F.col("_s") > 0, (x - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))))
    return df.drop("dosages", "_m", "_s").withColumnRenamed("g", "dosages")


def relatedness(df: DataFrame, block: int = 1024, variants_in_part: int = 256) -> DataFrame:
    """``(i, j, rel)``, i <= j: mean product of dosages, scaled by allele frequency with missing ones as the mean, over variants.

    Subjects are cut into blocks. A task takes pairs of blocks, one after the other, reads both blocks' dosages (a byte each) a part of the variants at a time, and adds up their
    products: it holds two parts and one product of a block by a block, whatever the number of subjects and variants. Pairs that are fewer than tasks are dealt by parts
    of variants too and added up after.
    """
    from varimesh.operators.arrays import combine
    from varimesh.operators.storage import saved

    spark = df.sparkSession
    n = df.select(F.max(F.size("dosages"))).first()[0] or 0
    block = max(1, min(block, n))
    blocks = max(1, -(-n // block))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    salts = max(1, tasks // (blocks * (blocks + 1) // 2))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every block's dosages of some variants, with the variants' means and scales; parts are numbered by task."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, variants_in_part):
                lists = batch.column(0).slice(at, variants_in_part)
                g = lists.flatten().cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                known = g >= 0
                mean = np.where(known, g, 0).sum(1) / np.maximum(1, known.sum(1))
                scale = np.sqrt(mean * (1 - mean / 2))
                params = np.stack((mean, scale)).tobytes()
                g = np.pad(g, ((0, 0), (0, blocks * block - n)), constant_values=-1)  # blocks of one width
                part += 1
                for k in range(blocks):
                    body = np.ascontiguousarray(g[:, k * block : (k + 1) * block]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int64()), pa.array([len(g)], pa.int32()), pa.array([params]), pa.array([body])], ["k", "part", "m", "params", "body"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total, count, left = None, None, 0, None

        def scaled(row) -> np.ndarray:
            mean, scale = np.frombuffer(row["params"]).reshape(2, -1)
            g = np.frombuffer(row["body"], np.int8).reshape(row["m"], -1).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where((g < 0) | (scale[:, None] <= 0), 0.0, (g - mean[:, None]) / scale[:, None])

        def out():
            flat = np.concatenate((total.ravel(), [count]))
            ends = pa.array([0, len(flat)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat))], ["i", "j", "m"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                now = row["i"], row["j"], row["salt"]
                if now != place:
                    if place is not None:
                        yield out()
                    place, total, count, left = now, 0.0, 0, None
                if left is None and row["i"] != row["j"]:
                    left = row
                    continue
                a, b = scaled(left or row), scaled(row)
                total, count, left = total + a.T @ b, count + row["m"], None
        if place is not None:
            yield out()

    slices = saved(df.select("dosages").mapInArrow(cut, "k int, part long, m int, params binary, body binary"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda l: F.struct(F.least("k", l).alias("i"), F.greatest("k", l).alias("j"))))
    dealt = slices.withColumn("pair", pair).select("pair.i", "pair.j", F.pmod(F.xxhash64("part"), F.lit(salts)).cast("int").alias("salt"), "part", "k", "m", "params", "body")
    dealt = dealt.repartition(tasks, "i", "j", "salt").sortWithinPartitions("i", "j", "salt", "part", "k").drop("part", "k")
    sums = combine(dealt.mapInArrow(products, "i int, j int, m array<double>"), ["i", "j"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, m in zip(*(batch.column(k).to_pylist() for k in (0, 1)), (x.values.to_numpy() for x in batch.column(2)), strict=True):
                rel = m[:-1].reshape(block, block) / m[-1]
                a, b = np.indices(rel.shape)
                a, b = a.ravel() + i * block, b.ravel() + j * block
                keep = (a <= b) & (b < n)
                for at in range(0, len(a), 1 << 16):
                    own = keep[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)][own]) for x in (a.astype(np.int32), b.astype(np.int32), rel.ravel())], ["i", "j", "rel"])

    return sums.mapInArrow(spelled, "i int, j int, rel double")


def _triangle(spark: SparkSession, path: str, layout: str, ids: DataFrame, range_bytes: int) -> DataFrame:
    """Pairs ``(iid_i, iid_j, rel)`` of a triangle; ``ids`` has ``row, iid``."""
    spark.dataSource.register(TriangleSource)
    options = {"path": qualified(spark, path), "n": ids.count(), "layout": layout, "range": range_bytes}
    pairs = spark.read.format("varimesh_triangle").options(**options).load()
    for side in ("a", "b"):
        pairs = pairs.join(ids.select(F.col("row").alias(side), F.col("iid").alias("iid_i" if side == "a" else "iid_j")), side)
    return pairs.select("iid_i", "iid_j", "rel")


def read_grm_dat(spark: SparkSession, path: str, ids: list[str] | DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Lower triangle without its diagonal as doubles, column by column: pairs ``(iid_i, iid_j, rel)``. ``ids``: in order, or a table ``(row, iid)``."""
    if not isinstance(ids, DataFrame):
        ids = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "row long, iid string")
    return _triangle(spark, path, "columns", ids, range_bytes)


def read_grm_gcta(spark: SparkSession, stem: str, range_bytes: int = RANGE) -> DataFrame:
    """``<stem>.grm.bin`` (lower triangle with its diagonal as floats, row by row) and ``<stem>.grm.id``: pairs off the diagonal."""
    ids = _numbered(spark, f"{stem}.grm.id").select("row", F.col("c")[1].alias("iid"))
    return _triangle(spark, f"{stem}.grm.bin", "rows", ids, range_bytes)
