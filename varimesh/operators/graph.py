"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_saved, saved


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph, as ``(node, component)`` with the smallest node as component.

    Alternates the large-star and small-star steps (Kiveris et al., 2014). A node's smallest neighbour
    is a grouped minimum joined back, so a hub's edges never meet in one task: the minimum combines on the map side and
    the join's hot key can be split. Isolated nodes have no edge and so no row; null ends are ignored.
    """

    def summary(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    now = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), few=True
    )
    mark = summary(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now points from a node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = saved(small, few=True)
        before, mark = mark, summary(new)
        drop_saved(now)
        now = new
        if mark == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
