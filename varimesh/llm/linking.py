"""Pairs of rows worth comparing, from keys that near rows share. DataFrame functions only.

Rows come as ``(id, fp, keys)``: equal rows may repeat. Two rows meet where they share a key. A key that up to ``CROWD`` rows have gives all its
pairs. A key with more would give its square; there the rows meet again under each two of their crowded keys that follow one another in order,
as near rows share most of their keys, and in the crowd itself each row meets its neighbours in two orders of fingerprints and the first and the last row. So
these pairs stay in proportion to rows, whatever the crowd, and no task holds one.

They need not be all. Once they are settled, :func:`unlinked` gives the exact rest: of a crowd all pairs of rows that the links so far leave in different groups. A group that
holds most of a crowd is not compared with itself, so near copies cost little; a crowd of rows that are all unlike costs its square in comparisons, in cells of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, in_slots, saved

#: Rows with a key in common up to which all are compared with each other.
CROWD = 32
#: Rows that one task orders.
PART = 4000
#: Rows of a crowd that one task holds at a time to compare others with.
CELL = 2000
#: Crowded leading bits that are sent to every task, at most; more are joined.
FULL = 1 << 18


def near(radius: int) -> Column:
    """Whether ``fp`` and ``fp2`` differ in at most ``radius`` bits."""
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius


def ordered(df: DataFrame) -> DataFrame:
    """``(id, id2)`` with the smaller id first, each pair once."""
    return df.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2")).where("id <> id2").distinct()


def shared_keys(rows: DataFrame) -> DataFrame:
    """``(key, first, last, n)`` of the keys that different rows have; ``n`` counts repeated rows too. Counted on the map side first."""
    own = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    return saved(own.where("first <> last"), few=True)


def with_prints(pairs: DataFrame, prints: DataFrame, radius: int, least: float = 0.0) -> DataFrame:
    """The pairs whose fingerprints, looked up in ``prints`` (``id``, ``fp``, ``size``, each id once), are within the radius, and whose sizes are so alike."""
    both = pairs.join(prints, "id").join(prints.select(*[F.col(c).alias(f"{c}2") for c in prints.columns]), "id2").where(near(radius))
    if least:  # what one has more than the other counts in full against them
        both = both.where(F.least("size", "size2") >= F.floor(F.greatest("size", "size2") * F.lit(least) - F.lit(1e-6)))
    return both.select("id", "id2")


def neighbours(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs of rows that follow one another in a crowd, in two orders of fingerprints, and of each row with the crowd's first and last.

    Rows are ordered in parts, and rows that can't be told apart by leading bits in parts of some ``PART`` rows each.
    """
    found = []
    crowds = bool(rows.where(F.col("n") > PART).take(1))
    parts = F.floor(F.col("n") / PART) + 1
    for by in (F.col("fp"), F.shiftleft("fp", 32)):
        # dealt by the leading bits of the order, so that neighbours stay together
        dealt = rows.withColumn("lead", F.shiftrightunsigned(by, 48))
        # rows of a crowd that agree in those bits, as lines from one template do, are dealt by id into as many parts as they need
        spread = F.lit(0)
        if crowds:
            full = dealt.where(F.col("n") > PART).groupBy("key", "lead").agg(F.count(F.lit(1)).alias("here")).where(F.col("here") > PART)
            full = saved(full, few=True)
            dealt = dealt.join(F.broadcast(full) if full.count() <= FULL else full, ["key", "lead"], "left")
            spread = F.pmod("id", F.coalesce(F.floor(F.col("here") / PART) + 1, F.lit(1)))
        dealt = dealt.withColumns({"part": F.pmod("lead", parts), "spread": spread})
        order = Window.partitionBy("key", "part", "spread").orderBy(by, "fp", "id")
        for k in (1, 2):
            lag = dealt.withColumns({"id2": F.lag("id", k).over(order), "fp2": F.lag("fp", k).over(order)})
            found.append(lag.where("id2 is not null").where(near(radius)).select("id", "id2"))
    found += [rows.select("id", F.col(c).alias("id2")) for c in ("first", "last")]
    return reduce(DataFrame.unionByName, found)


def meetings(rows: DataFrame, keys: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs from the keys of three rows or more, and the rows ``(key, id, fp)`` of crowded keys."""
    keys = keys.where("n > 2")
    thin = in_slots(rows, "key", keys, "left_semi")
    held = saved(thin.join(keys, "key").distinct(), few=True)
    few = held.where(F.col("n") <= CROWD).select("key", "id", "fp")
    pairs = few.join(few.select("key", F.col("id").alias("id2"), F.col("fp").alias("fp2")), "key").where("id < id2").where(near(radius)).select("id", "id2")
    many = held.where(F.col("n") > CROWD)
    return pairs.unionByName(neighbours(many, radius)), many.select("key", "id", "fp")


def candidates(rows: DataFrame, prints: DataFrame, radius: int, least: float = 0.0) -> DataFrame:
    """``(id, id2)``: pairs within ``radius`` bits that share a key, of crowded keys some. ``rows`` has ``id``, ``fp``, ``keys``; ``prints`` each ``id`` with its ``fp`` once.

    With ``least``, ``prints`` has the rows' ``size`` too, and of a pair the smaller must be so many times the larger.
    """
    return with_crowds(rows, prints, radius, least)[0]


def with_crowds(rows: DataFrame, prints: DataFrame, radius: int, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """What :func:`candidates` gives, and the rows ``(key, id)`` of crowded keys, whose other pairs :func:`unlinked` finds."""
    flat = rows.select("id", "fp", F.explode("keys").alias("key"))
    keys = shared_keys(flat)
    pairs, many = meetings(flat, keys, radius)
    found = [keys.where("n = 2").select(F.col("first").alias("id"), F.col("last").alias("id2")), pairs]
    if many.take(1):
        own = many.groupBy("id", "fp").agg(F.sort_array(F.collect_set("key")).alias("k")).where(F.size("k") > 1)  # as many keys as a row has
        two = F.transform(F.sequence(F.lit(0), F.size("k") - 2), lambda i: F.xxhash64(F.get("k", i), F.get("k", i + 1)))
        own = saved(own.select("id", "fp", F.explode(two).alias("key")), few=True)
        keys = shared_keys(own)
        pairs, _ = meetings(own, keys, radius)
        found += [keys.where("n = 2").select(F.col("first").alias("id"), F.col("last").alias("id2")), pairs]
    return saved(with_prints(ordered(reduce(DataFrame.unionByName, found)), prints, radius, least), few=True), many.select("key", "id")


def unlinked(crowds: DataFrame, about: DataFrame, label: DataFrame, condition: Column, least: float = 0.0) -> DataFrame:
    """All pairs of rows of a crowd that ``label`` (``id``, ``group``) leaves in different groups and that meet ``condition``, each once a crowd, with the columns of ``about`` and those ending in 2.

    ``crowds`` has ``key``, ``id``; ``about`` has each ``id`` once, with what ``condition`` names (of the other row with a 2 at the end) and, with ``least``, its ``size``: a pair's smaller size is then so many times the
    larger, but for less than one. Rows outside the group that most rows of the crowd are in meet all rows of like size.
    """
    rows = crowds.distinct().join(label, "id", "left").withColumn("group", F.coalesce("group", "id"))
    shares = rows.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.count(F.lit(1)).alias("groups"))
    mixed = saved(shares.where("groups > 1").select("key", "main"), few=True)
    # sizes of pairs are in one band or in two that follow one another; the six make up for the rounding of small sizes
    band = F.floor(F.log(F.col("size") + 6.0) / F.log(F.lit(1 / least)) + F.lit(1e-9)) if least else F.lit(0).cast("long")
    rows = saved(rows.join(mixed, "key").join(about, "id").withColumn("band", band), few=True)
    cells = rows.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = ["id", "group", *[c for c in about.columns if c != "id"]]
    held = rows.join(cells, ["key", "band"]).withColumn("part", F.pmod("id", F.col("parts")).cast("int"))
    held = held.select("key", "band", "part", (F.col("group") == F.col("main")).alias("of_main"), *[F.col(c).alias(f"{c}2") for c in names])
    passing = rows.where(F.col("group") != F.col("main")).withColumn("band", F.explode(F.array(*[F.col("band") + k for k in ((-1, 0, 1) if least else (0,))])))
    passing = passing.join(cells, ["key", "band"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "band", "part", *names)
    at = ["key", "band", "part"]
    pairs = passing.repartition(tasks, *at).hint("merge").join(held.repartition(tasks, *at), at)
    return pairs.where((F.col("group") != F.col("group2")) & (F.col("of_main") | (F.col("id") < F.col("id2")))).where(condition)


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, group)`` with the groups that ``links`` (``id``, ``id2``) connect made one; rows without a group yet are groups of their own."""
    at = lambda c: label.select(F.col("id").alias(c), F.col("group").alias(f"{c}_group"))
    ends = links.join(at("id"), "id", "left").join(at("id2"), "id2", "left").select(F.coalesce("id_group", "id").alias("a"), F.coalesce("id2_group", "id2").alias("b"))
    whole = saved(components(ends, "a", "b"), few=True)
    old = label.join(whole, F.col("group") == F.col("node"), "left").select("id", F.coalesce("component", "group").alias("group"))
    new = whole.join(label, F.col("node") == F.col("id"), "left_anti").select(F.col("node").alias("id"), F.col("component").alias("group"))
    return saved(old.unionByName(new), few=True)
