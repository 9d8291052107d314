"""Sufficient statistics of a growing table as a stream. An extension of ours: sums of products only ever add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def product_sums(stream: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """One row of running sums, by streaming aggregation; its state is as large as the number of columns squared."""
    c = [F.col(x).cast("double") for x in [*xs, *ys]]
    names = [*xs, *ys]
    sums = [F.sum(c[i] * c[j]).alias(f"{names[i]}*{names[j]}") for i in range(len(c)) for j in range(i, len(c))]
    return stream.groupBy().agg(F.count(F.lit(1)).alias("n"), *sums)


def consume(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Take all there is, and return the table of results so far."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
