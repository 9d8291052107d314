"""Intermediate tables in the store that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared store that ``spark.checkpoint.dir`` names. Only a local session, as in tests, may do without and gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="varimesh-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/varimesh-{uuid.uuid4().hex}"


def saved(df: DataFrame, partitions: int | None = None, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared store and read it again: this cuts the lineage and survives a lost executor.

    ``few`` is for tables of small rows, which would otherwise be hundreds of tiny files: a quarter of the shuffle partitions, so their number still
    grows with what the session is set up for.
    """
    path = shared_dir(df.sparkSession)
    if few:
        spark = df.sparkSession
        partitions = max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`saved` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("varimesh-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
