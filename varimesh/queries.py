"""The registered queries of the library over the driver's tables, and the same in plain SQL.

Roles: a family is a customer, a subject an order, an observation a line item; outcomes are price, discount and tax. Keys begin
with the operator's id in the survey where there is one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varimesh.functions import dist, splines
from varimesh.functions import transforms as tr
from varimesh.operators import array_resample, arrays, linear, mixed, resample, storage, tables, tails
from varimesh.sources import sinks, tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def in_parts(spark: SparkSession, d: str, rows: int = 500_000) -> int:
    """How many tasks hold at most some ``rows`` line items each; at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-t(spark, d, "lineitem").count() // rows))


def obs(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """Line items with their order and customer as doubles; joined in ``parts`` tasks, if given."""
    items, orders = t(spark, d, "lineitem"), t(spark, d, "orders")
    if parts:
        items, orders = items.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    both = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    c = lambda n: F.col(n).cast("double")
    return both.select(
        F.col("o_custkey").alias("fid"), F.col("l_orderkey").alias("iid"), F.lit(1.0).alias("Intercept"), (c("l_quantity") / 10).alias("x1"), (c("o_totalprice") / 100000).alias("x2"),
        F.col("l_returnflag").alias("flag"), F.col("o_orderpriority").alias("priority"), (c("l_extendedprice") / 10000).alias("y1"), c("l_discount").alias("y2"), c("l_tax").alias("y3"), "l_shipdate",
    )


OBS = """obs AS (SELECT o_custkey AS fid, l_orderkey AS iid, CAST(l_quantity AS DOUBLE) / 10 AS x1, CAST(o_totalprice AS DOUBLE) / 100000 AS x2, l_returnflag AS flag,
  o_orderpriority AS priority, CAST(l_extendedprice AS DOUBLE) / 10000 AS y1, CAST(l_discount AS DOUBLE) AS y2, CAST(l_tax AS DOUBLE) AS y3, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LONG = """long AS (SELECT fid, iid, x1, y_id, y FROM (SELECT fid, iid, x1, UNNEST(['y1', 'y2', 'y3']) AS y_id, UNNEST([y1, y2, y3]) AS y FROM obs))"""
# least squares of y on 1 and x1, and its residuals
OLS = """fit AS (SELECT y_id, count(*) AS n, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, avg(x1) AS mx, regr_sxx(y, x1) AS sxx FROM long GROUP BY y_id),
res AS (SELECT l.*, y - a - b * x1 AS r FROM long l JOIN fit USING (y_id)),
s2 AS (SELECT y_id, sum(r * r) / (count(*) - 2) AS s2 FROM res GROUP BY y_id)"""
# sums over subjects and families, and the normal equations of the moments
MOM = """sub AS (SELECT y_id, fid, iid, count(*)::DOUBLE AS n, sum(r) AS s, sum(r * r) AS q FROM res GROUP BY ALL),
fam AS (SELECT y_id, fid, sum(n) AS n, sum(n * n) AS n2, sum(s) AS s, sum(s * s) AS ss, sum(q) AS q FROM sub GROUP BY ALL),
ne AS (SELECT y_id, sum(n * n) AS a, sum(n2) AS c, sum(n) AS e, sum(s * s) / any_value(s2) AS df, sum(ss) / any_value(s2) AS ds, sum(q) / any_value(s2) AS de, sum(q * q) / any_value(s2) ^ 2 AS dd
  FROM fam JOIN s2 USING (y_id) GROUP BY y_id)"""
NNLS = """cand AS (
  SELECT y_id, 1 AS k, 0.0 AS f, 0.0 AS s, greatest(de / e, 0) AS g FROM ne UNION ALL
  SELECT y_id, 2, 0.0, greatest(ds / c, 0), 0.0 FROM ne UNION ALL
  SELECT y_id, 3, 0.0, greatest((ds - de) / (c - e), 0), greatest(de / e - (ds - de) / (c - e), 0) FROM ne UNION ALL
  SELECT y_id, 4, greatest(df / a, 0), 0.0, 0.0 FROM ne UNION ALL
  SELECT y_id, 5, greatest((df - de) / (a - e), 0), 0.0, greatest(de / e - (df - de) / (a - e), 0) FROM ne UNION ALL
  SELECT y_id, 6, greatest((df - ds) / (a - c), 0), greatest(ds / c - (df - ds) / (a - c), 0), 0.0 FROM ne UNION ALL
  SELECT y_id, 7, greatest((df - ds) / (a - c), 0), greatest((ds - de) / (c - e) - (df - ds) / (a - c), 0), greatest(de / e - (ds - de) / (c - e), 0) FROM ne),
best AS (SELECT y_id, f, s, g FROM (SELECT cand.*, dd - 2 * (f * df + s * ds + g * de) + f * f * a + s * s * c + g * g * e + 2 * f * s * c + 2 * f * g * e + 2 * s * g * e AS cost,
  row_number() OVER (PARTITION BY cand.y_id ORDER BY dd - 2 * (f * df + s * ds + g * de) + f * f * a + s * s * c + g * g * e + 2 * f * s * c + 2 * f * g * e + 2 * s * g * e, k) AS rn
  FROM cand JOIN ne ON cand.y_id = ne.y_id) WHERE rn = 1),
share AS (SELECT y_id, f / (f + s + g) AS f, s / (f + s + g) AS s, g / (f + s + g) AS g FROM best)"""
XS, YS = ["Intercept", "x1"], ["y1", "y2", "y3"]


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- sources and sinks


@query("src01_parquet_scan", "SELECT count(*) AS n, round(sum(CAST(l_quantity AS DOUBLE)), 4) AS quantity FROM lineitem")
def _(spark, d):
    return src.read_table(spark, f"{d}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 4).alias("quantity"))


@query("src02_column_scan", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return src.read_table(spark, f"{d}/orders.parquet", ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("src07_variable_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = t(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return tables.join_all([c, n, t(spark, d, "region").select("r_regionkey", "r_name")], ["n_nationkey", "r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("src13_numeric_columns", "SELECT p_partkey, CAST(p_size AS INT) AS p_size, round(CAST(p_retailprice AS DOUBLE), 2) AS p_retailprice FROM part")
def _(spark, d):
    p = src.numeric_only(t(spark, d, "part"), ["p_partkey"])
    return p.select("p_partkey", F.col("p_size").cast("int").alias("p_size"), F.round(F.col("p_retailprice").cast("double"), 2).alias("p_retailprice"))


@query("src10_hemispheres", "SELECT vec_id, round(CAST(list_sum(embedding[1:8]) + list_sum(embedding[1:8]) AS DOUBLE), 3) AS total, 16 AS width FROM embeddings")
def _(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    both = src.hemispheres(e, e, ["vec_id"], "embedding", 8)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return both.select("vec_id", F.round(total, 3).alias("total"), F.size("embedding").alias("width"))


# ---- transforms


@query("xf01_center", f"WITH {OBS} SELECT fid, iid, round(x1 - avg(x1) OVER (), 6) AS x FROM obs")
def _(spark, d):
    return rounded(tr.scale(obs(spark, d), ["x1"], "center").select("fid", "iid", F.col("x1_center").alias("x")), 6, "x")


@query("xf02_std", f"WITH {OBS} SELECT fid, iid, round((y1 - avg(y1) OVER ()) / stddev_samp(y1) OVER (), 6) AS x FROM obs")
def _(spark, d):
    return rounded(tr.scale(obs(spark, d), ["y1"], "std").select("fid", "iid", F.col("y1_std").alias("x")), 6, "x")


@query("xf03_logs", f"WITH {OBS} SELECT fid, iid, round(ln(y1), 6) AS ln, round(log10(x1), 6) AS lg FROM obs")
def _(spark, d):
    df = tr.scale(tr.scale(obs(spark, d), ["y1"], "logn"), ["x1"], "log10")
    return df.select("fid", "iid", F.round("y1_logn", 6).alias("ln"), F.round("x1_log10", 6).alias("lg"))


RANK = "rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0"


@query("wn01_tied_rank", f"WITH c AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS v FROM customer) SELECT c_custkey, CAST({RANK} AS DOUBLE) AS r FROM c")
def _(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    return tr.tied_rank(c, "v", "r").select("c_custkey", F.col("r").cast("double").alias("r"))


@query("xf05_rank_normal")
def _(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    return tr.rank_normal(c, "v").select("c_custkey", "v_ranknorm")


HAZEN = """h AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM (SELECT CAST(p_retailprice AS DOUBLE) AS v FROM part)),
pos AS (SELECT p, least(greatest(p / 100.0 * any_value(n) + 0.5, 1), any_value(n)) AS x FROM h, (SELECT UNNEST([5.0, 50.0, 95.0]) AS p) GROUP BY p),
pc AS (SELECT p, any_value(lo.v) + (x - floor(x)) * (any_value(hi.v) - any_value(lo.v)) AS q FROM pos JOIN h lo ON lo.k = floor(x) JOIN h hi ON hi.k = least(floor(x) + 1, hi.n) GROUP BY p, x)"""


@query("df05_percentiles", f"WITH {HAZEN} SELECT p, round(q, 6) AS q FROM pc")
def _(spark, d):
    p = t(spark, d, "part").select(F.col("p_retailprice").cast("double").alias("v"))
    return spark.createDataFrame(list(zip([5.0, 50.0, 95.0], tr.hazen(p, "v", [5, 50, 95]), strict=True)), "p double, q double").withColumn("q", F.round("q", 6))


@query("xf06_winsorize", f"WITH {HAZEN} SELECT p_partkey, round(least(greatest(CAST(p_retailprice AS DOUBLE), (SELECT q FROM pc WHERE p = 5)), (SELECT q FROM pc WHERE p = 95)), 6) AS v FROM part")
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    return tr.winsorize(p, "v", 95, 5).select("p_partkey", F.round("v_winsorized", 6).alias("v"))


@query("xf07_quadratic", f"WITH {OBS} SELECT fid, iid, round(x1, 6) AS m, round(x1 * x1, 6) AS q FROM obs")
def _(spark, d):
    return tr.quadratic(obs(spark, d), "x1").select("fid", "iid", F.round("x1_main", 6).alias("m"), F.round("x1_quadratic", 6).alias("q"))


@query("xf08_delta", """WITH b AS (SELECT user_id, min_by(value, struct_pack(ts, event_id)) AS base FROM events GROUP BY 1)
SELECT event_id, round(base, 6) AS baseline, round(value - base, 6) AS delta FROM events JOIN b USING (user_id)""")
def _(spark, d):
    e = t(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return tr.delta(e, "value", "user_id", "at").select("event_id", F.round("value_baseline", 6).alias("baseline"), F.round("value_delta", 6).alias("delta"))


@query("xf09_dummies", """WITH m AS (SELECT c_mktsegment AS v FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, c_mktsegment AS level, CAST(1.0 AS DOUBLE) AS x FROM customer WHERE c_mktsegment <> (SELECT v FROM m)""")
def _(spark, d):
    df, names = tr.dummies(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    long = F.explode(F.array(*[F.struct(F.lit(n.removeprefix("c_mktsegment_")).alias("level"), F.col(f"`{n}`").alias("x")) for n in names]))
    return df.select("c_custkey", long.alias("r")).select("c_custkey", "r.*").where("x = 1")


@query("xf11_interaction", f"WITH {OBS} SELECT fid, iid, round(x1 * x2, 9) AS a, round(x1 * (CASE WHEN flag = 'R' THEN 1 ELSE 0 END), 6) AS b FROM obs")
def _(spark, d):
    df = obs(spark, d).withColumn("flag_R", (F.col("flag") == "R").cast("double"))
    df, names = tr.interaction(df, [["x1"], ["x2", "flag_R"]])
    return df.select("fid", "iid", F.round(names[0], 9).alias("a"), F.round(names[1], 6).alias("b"))


@query("xf13_spline_columns")
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    knots = tr.hazen(p, "v", [0, 25, 50, 75, 100])
    df, names = splines.add_basis(p, "v", splines.basis((knots[0], knots[-1]), knots))
    return df.select("p_partkey", *names)


@query("xf27_recode", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS grade, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer")
def _(spark, d):
    b, m = F.col("c_acctbal"), F.col("c_mktsegment")
    grade = tables.recode(b, [(b < 0, "debt"), (b < 5000, "low")], "high")
    segment = tables.recode(m, [(m == "BUILDING", "none")], m)
    return t(spark, d, "customer").select("c_custkey", grade.alias("grade"), segment.alias("segment"))


@query("xf33_map_names", "SELECT p_partkey, CASE WHEN regexp_matches(replace(lower(p_type), ' ', '_'), '(^|__)(economy)(_|$)') THEN 'eco' WHEN regexp_matches(replace(lower(p_type), ' ', '_'), '(^|__)(small)(_|$)') THEN 'sml' END AS name FROM part")
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.regexp_replace(F.lower("p_type"), " ", "_").alias("k"))
    return p.select("p_partkey", tables.map_names(p, "k", {"economy": "eco", "small": "sml"}).alias("name"))


# ---- filters and joins


@query("flt01_pair_filter", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL")
def _(spark, d):
    pairs = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return tables.keep_pairs(t(spark, d, "lineitem"), pairs, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("flt02_id_filter", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3) GROUP BY 1")
def _(spark, d):
    ids = t(spark, d, "orders").where("o_custkey % 7 = 3").select("o_orderkey")
    return tables.keep_ids(t(spark, d, "lineitem"), "l_orderkey", ids).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("flt03_missing_counts", "SELECT 'a' AS variable, count(*) FILTER (l_returnflag = 'N') AS n_missing FROM lineitem UNION ALL SELECT 'b', count(*) FILTER (l_quantity > 40) FROM lineitem")
def _(spark, d):
    df = t(spark, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("a"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("b"))
    return tables.missing_counts(df, ["a", "b"])


@query("flt04_finite_rows", "SELECT count(*) AS n FROM embeddings WHERE NOT list_contains(list_transform(embedding, lambda v: v > 0.9), true)")
def _(spark, d):
    e = t(spark, d, "embeddings").withColumn("y", F.transform("embedding", lambda v: F.when(v <= 0.9, v)))
    return e.where(tables.finite("y")).agg(F.count(F.lit(1)).alias("n"))


@query("flt07_qc_table", "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderpriority LIKE '1%' GROUP BY 1")
def _(spark, d):
    qc = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).alias("ok"))
    return tables.quality(t(spark, d, "lineitem"), qc, "ok", ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("flt09_audit", f"WITH {OBS} SELECT 'price' AS reason, count(*) FILTER (NOT y1 < 5) AS n FROM obs UNION ALL SELECT 'flag', count(*) FILTER (flag <> 'N') FROM obs UNION ALL SELECT 'kept', count(*) FILTER (y1 < 5 AND flag = 'N') FROM obs")
def _(spark, d):
    kept, report = tables.audit(obs(spark, d), {"price": F.col("y1") < 5, "flag": F.col("flag") == "N"})
    return report.unionByName(kept.agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("kept")))


@query("flt10_varying_mask", "SELECT i - 1 AS pos, stddev_samp(embedding[i]) > 0 AS in_mask FROM embeddings, (SELECT UNNEST(range(1, 65)) AS i) GROUP BY i")
def _(spark, d):
    m = tables.varying(t(spark, d, "embeddings"), "embedding")
    return m.select(F.col("pos").cast("long").alias("pos"), "in_mask")


@query("jn03_fill_families", """WITH f AS (SELECT o_orderkey AS iid, CASE WHEN o_custkey % 5 > 0 THEN o_custkey END AS fid FROM orders)
SELECT iid, CASE WHEN fid IS NOT NULL THEN fid ELSE (SELECT max(fid) FROM f) + row_number() OVER (PARTITION BY fid IS NULL ORDER BY iid) END AS fid FROM f""")
def _(spark, d):
    o = t(spark, d, "orders")
    known = o.where("o_custkey % 5 > 0").select(F.col("o_orderkey").alias("iid"), F.col("o_custkey").alias("fid"))
    return tables.fill_families(o.select(F.col("o_orderkey").alias("iid")), known).select("iid", "fid")


@query("jn04_align_first", """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CAST(q AS DOUBLE) AS q, o_custkey FROM l JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    y = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return tables.first_of(x, ["l_orderkey", "l_linenumber"]).join(tables.first_of(y, ["l_orderkey"]), "l_orderkey")


@query("jn12_dropped_keys", "SELECT 'design' AS side, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    b = t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    sides = tables.dropped(a, b, ["k"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    one = spark.createDataFrame([("design",)], "side string")
    return one.join(sides, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn09_propagate", "SELECT s_suppkey AS pos, round(sum(0.5 * n_nationkey), 6) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    atlas = t(spark, d, "supplier").select(F.col("s_nationkey").alias("roi"), F.col("s_suppkey").alias("pos"), F.lit(0.5).alias("weight"))
    stats = t(spark, d, "nation").select(F.col("n_nationkey").alias("roi"), F.col("n_nationkey").cast("double").alias("value"))
    return rounded(tables.propagate(stats, atlas), 6, "value")


@query("ag36_region_means", "SELECT 1 AS key, n_regionkey AS roi, round(avg(CAST(c_acctbal AS DOUBLE)), 6) AS mean, round(sum(CAST(c_acctbal AS DOUBLE)), 4) AS total, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2")
def _(spark, d):
    values = t(spark, d, "customer").select(F.lit(1).alias("key"), F.col("c_nationkey").alias("pos"), F.col("c_acctbal").cast("double").alias("value"))
    atlas = t(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_regionkey").alias("roi"), F.lit(1.0).alias("weight"))
    return rounded(rounded(tables.region_means(values, atlas), 6, "mean"), 4, "total")


# ---- least squares and mixed models


@query("ag01_gram", f"WITH {OBS} SELECT round(sum(x1), 4) AS sx, round(sum(x1 * x1), 4) AS sxx, round(sum(x1 * y1), 4) AS sxy, round(sum(y1 * y1), 4) AS syy, count(*) AS n FROM obs")
def _(spark, d):
    g = linear.gram(obs(spark, d), XS, ["y1"])
    row = [(round(float(g.xx[0, 1]), 4), round(float(g.xx[1, 1]), 4), round(float(g.xy[1, 0]), 4), round(float(g.yy[0]), 4), g.n)]
    return spark.createDataFrame(row, "sx double, sxx double, sxy double, syy double, n long")


OLS_ROWS = """SELECT y_id, 'x1' AS term, round(b, 6) AS beta, round(sqrt(s2 / sxx), 6) AS se, round(b / sqrt(s2 / sxx), 4) AS z FROM fit JOIN s2 USING (y_id)
UNION ALL SELECT y_id, 'Intercept', round(a, 6), round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 6), round(a / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 4) FROM fit JOIN s2 USING (y_id)"""


@query("ag02_ols", f"WITH {OBS}, {LONG}, {OLS} {OLS_ROWS}")
def _(spark, d):
    table = linear.ols(linear.gram(obs(spark, d), XS, YS)).table(spark).drop("logp")
    return rounded(rounded(table, 6, "beta", "se"), 4, "z")


@query("ag01_array_outcomes", "SELECT i - 1 AS y_id, round(regr_slope(CAST(embedding[i] AS DOUBLE), label), 6) AS beta FROM embeddings, (SELECT UNNEST(range(1, 65)) AS i) GROUP BY i")
def _(spark, d):
    e = t(spark, d, "embeddings").select(F.lit(1.0).alias("one"), F.col("label").cast("double").alias("label"), "embedding")
    fit = linear.ols(linear.gram_arrays(e, ["one", "label"], "embedding", 64))
    return spark.createDataFrame([(k, round(float(b), 6)) for k, b in enumerate(fit.beta[1])], "y_id long, beta double")


@query("ag26_residual_variance", f"WITH {OBS}, {LONG}, {OLS} SELECT y_id, round(sum(r * r) / (count(*) - 2), 6) AS s2, round(abs(sum(r)), 3) AS zero FROM res GROUP BY 1")
def _(spark, d):
    df = obs(spark, d)
    res = linear.residuals(df, linear.ols(linear.gram(df, XS, YS)), ["fid"])
    row = res.agg(*[F.sum(F.col(f"r_{y}") ** 2).alias(f"q{y}") for y in YS], *[F.sum(f"r_{y}").alias(f"s{y}") for y in YS], F.count(F.lit(1)).alias("n"))
    long = F.explode(F.array(*[F.struct(F.lit(y).alias("y_id"), F.round(F.col(f"q{y}") / (F.col("n") - 2), 6).alias("s2"), F.round(F.abs(F.col(f"s{y}")), 3).alias("zero")) for y in YS]))
    return row.select(long.alias("r")).select("r.*")


@query("ag07_family_types", """WITH p AS (SELECT o_custkey AS fid, l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
f AS (SELECT fid, list_sort(list(n)) AS shape FROM p GROUP BY 1) SELECT array_to_string(shape, ',') AS shape, count(*) AS families FROM f GROUP BY 1""")
def _(spark, d):
    shapes = mixed.family_types(obs(spark, d).select("fid", "iid")).select(F.array_join(F.transform("shape", lambda n: n.cast("string")), ",").alias("shape"))
    return shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("families"))


@query("ag08_moments", f"WITH {OBS}, {LONG}, {OLS}, {MOM} SELECT y_id, a, c, e, round(df, 3) AS df, round(ds, 3) AS ds, round(de, 3) AS de FROM ne")
def _(spark, d):
    df = obs(spark, d)
    o = linear.ols(linear.gram(df, XS, YS))
    m = mixed.pair_moments(linear.residuals(df, o, ["fid", "iid"]), YS, o.sigma2)
    rows = [(y, float(m.mm[0, 0]), float(m.mm[1, 1]), float(m.mm[2, 2]), *[round(float(x), 3) for x in m.md[k]]) for k, y in enumerate(YS)]
    return spark.createDataFrame(rows, "y_id string, a double, c double, e double, df double, ds double, de double")


@query("ag10_variance_shares", f"WITH {OBS}, {LONG}, {OLS}, {MOM}, {NNLS} SELECT y_id, 'F' AS effect, round(f, 6) AS share FROM share UNION ALL SELECT y_id, 'S', round(s, 6) FROM share UNION ALL SELECT y_id, 'E', round(g, 6) FROM share")
def _(spark, d):
    return rounded(mixed.fit(obs(spark, d), XS, YS).share_table(spark), 6, "share")


@query("ag24_bins", f"WITH {OBS}, {LONG}, {OLS}, {MOM}, {NNLS} SELECT y_id, CAST(least(floor(f * 20), 19) * 20 + least(floor(s * 20), 19) AS BIGINT) AS bin FROM share")
def _(spark, d):
    f = mixed.fit(obs(spark, d), XS, YS)
    return spark.createDataFrame([(y, int(b)) for y, b in zip(YS, f.bins, strict=True)], "y_id string, bin long")


# with a cell for each outcome, the weights are the outcome's own shares
GLS = """gs AS (SELECT y_id, fid, iid, count(*)::DOUBLE AS n, sum(x1) AS sx, sum(y) AS sy FROM long GROUP BY ALL),
gw AS (SELECT gs.*, f, s, g, g + s * n AS d FROM gs JOIN share USING (y_id)),
gf AS (SELECT y_id, fid, any_value(f) AS f, any_value(g) AS g, sum(n / d) AS q, sum(n / d) AS w1, sum(sx / d) AS wx, sum(sy / d) AS wy,
  sum(s / d * n * n) AS c11, sum(s / d * n * sx) AS c1x, sum(s / d * sx * sx) AS cxx, sum(s / d * n * sy) AS c1y, sum(s / d * sx * sy) AS cxy FROM gw GROUP BY ALL),
gt AS (SELECT y_id, sum(c11 / g + f / (1 + f * q) * w1 * w1) AS t11, sum(c1x / g + f / (1 + f * q) * w1 * wx) AS t1x, sum(cxx / g + f / (1 + f * q) * wx * wx) AS txx,
  sum(c1y / g + f / (1 + f * q) * w1 * wy) AS t1y, sum(cxy / g + f / (1 + f * q) * wx * wy) AS txy, any_value(g) AS g FROM gf GROUP BY y_id),
gr AS (SELECT y_id, count(*)::DOUBLE AS n, sum(x1) AS x, sum(x1 * x1) AS xx, sum(y) AS y, sum(x1 * y) AS xy FROM long GROUP BY y_id),
ga AS (SELECT gr.y_id, n / g - t11 AS a, x / g - t1x AS b, xx / g - txx AS c, y / g - t1y AS u, xy / g - txy AS v FROM gr JOIN gt USING (y_id)),
gb AS (SELECT y_id, (c * u - b * v) / (a * c - b * b) AS b0, (a * v - b * u) / (a * c - b * b) AS b1, sqrt(s2 * c / (a * c - b * b)) AS e0, sqrt(s2 * a / (a * c - b * b)) AS e1 FROM ga JOIN s2 USING (y_id))"""


@query("fit_gls", f"WITH {OBS}, {LONG}, {OLS}, {MOM}, {NNLS}, {GLS} SELECT y_id, 'Intercept' AS term, round(b0, 6) AS beta, round(e0, 6) AS se, round(b0 / e0, 3) AS z FROM gb UNION ALL SELECT y_id, 'x1', round(b1, 6), round(e1, 6), round(b1 / e1, 3) FROM gb")
def _(spark, d):
    """The whole model: ordinary fit, variance shares, weighted fit."""
    table = mixed.fit(obs(spark, d), XS, YS, n_bins=0).gls.table(spark).drop("logp")
    return rounded(rounded(table, 6, "beta", "se"), 3, "z")


# with bins, the weights are the mean shares of the outcomes in a cell of the grid
BINNED = """binned AS (SELECT y_id, avg(f) OVER w AS f, avg(s) OVER w AS s, avg(g) OVER w AS g
  FROM (SELECT *, least(floor(f * 20), 19) * 20 + least(floor(s * 20), 19) AS b FROM share) WINDOW w AS (PARTITION BY b))"""
GLS_BINNED = GLS.replace("JOIN share", "JOIN binned")
GLS_ROWS = "SELECT y_id, 'Intercept' AS term, round(b0, 6) + 0e0 AS beta, round(e0, 6) AS se FROM gb UNION ALL SELECT y_id, 'x1', round(b1, 6) + 0e0, round(e1, 6) FROM gb"
#: Vectors as observations of 64 outcomes: four to a subject, twenty to a family.
LONG_E = """long AS (SELECT vec_id // 20 AS fid, vec_id // 4 AS iid, CAST(label AS DOUBLE) AS x1, i - 1 AS y_id, CAST(embedding[i] AS DOUBLE) AS y
  FROM embeddings, (SELECT UNNEST(range(1, 65)) AS i))"""


@query("ag25_binned_gls", f"WITH {OBS}, {LONG}, {OLS}, {MOM}, {NNLS}, {BINNED}, {GLS_BINNED} {GLS_ROWS}")
def _(spark, d):
    """The whole model with outcomes weighted by bins of their shares."""
    return rounded(mixed.fit(obs(spark, d), XS, YS, n_bins=20).gls.table(spark).select("y_id", "term", "beta", "se"), 6, "beta", "se")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    fid, iid = (F.floor(F.col("vec_id") / n).alias(c) for c, n in (("fid", 20), ("iid", 4)))
    return t(spark, d, "embeddings").select(fid, iid, F.lit(1.0).alias("Intercept"), F.col("label").cast("double").alias("x1"), "embedding")


@query("fit_gls_arrays", f"WITH {LONG_E}, {OLS}, {MOM}, {NNLS}, {BINNED}, {GLS_BINNED} {GLS_ROWS}")
def _(spark, d):
    """The whole model of 64 outcomes in an array column, with bins."""
    table = arrays.fit(vectors(spark, d), XS, "embedding", 64).gls.table(spark)
    return rounded(table.select(F.substring("y_id", 2, 9).cast("long").alias("y_id"), "term", "beta", "se"), 6, "beta", "se")


@query("ag10_array_shares", f"WITH {LONG_E}, {OLS}, {MOM}, {NNLS} SELECT y_id, 'F' AS effect, round(f, 6) AS share FROM share UNION ALL SELECT y_id, 'S', round(s, 6) FROM share UNION ALL SELECT y_id, 'E', round(g, 6) FROM share")
def _(spark, d):
    table = arrays.fit(vectors(spark, d), XS, "embedding", 64).share_table(spark)
    return table.select(F.substring("y_id", 2, 9).cast("long").alias("y_id"), "effect", F.round("share", 6).alias("share"))


@query("ag18_contrast", f"WITH {OBS}, {LONG}, {OLS} SELECT y_id, round(a + 2.5 * b, 6) AS beta, round(sqrt(s2 * (1.0 / n + (2.5 - mx) ^ 2 / sxx)), 6) AS se FROM fit JOIN s2 USING (y_id)")
def _(spark, d):
    table = linear.ols(linear.gram(obs(spark, d), XS, YS)).table(spark, np.array([[1.0, 2.5]]), ["at_2.5"])
    return rounded(table.where("term = 'at_2.5'").select("y_id", "beta", "se"), 6, "beta", "se")


@query("ag19_wald", f"WITH {OBS}, {LONG}, {OLS} SELECT y_id, round(b * b / (s2 / sxx), 3) AS wald, CAST(1 AS BIGINT) AS df FROM fit JOIN s2 USING (y_id)")
def _(spark, d):
    rows = linear.wald(linear.ols(linear.gram(obs(spark, d), XS, YS)), [np.array([[0.0, 1.0]])])
    return spark.createDataFrame([(y, round(w, 3), df) for y, _, w, df, _ in rows], "y_id string, wald double, df long")


@query("ag12_visit_sums", f"""WITH {OBS}, v AS (SELECT fid, iid, CAST(year(l_shipdate) % 3 AS INT) AS visit, y2 - (SELECT avg(y2) FROM obs) AS r FROM obs),
f AS (SELECT fid, visit, count(*)::DOUBLE AS n, sum(r) AS s FROM v GROUP BY ALL), i AS (SELECT fid, iid, visit, count(*)::DOUBLE AS n, sum(r) AS s FROM v GROUP BY ALL),
pf AS (SELECT a.visit AS v1, b.visit AS v2, sum(a.n * b.n) AS family_pairs, round(sum(a.s * b.s), 6) AS family_sum FROM f a JOIN f b ON a.fid = b.fid AND a.visit <= b.visit GROUP BY ALL),
ps AS (SELECT a.visit AS v1, b.visit AS v2, sum(a.n * b.n) AS subject_pairs, round(sum(a.s * b.s), 6) AS subject_sum FROM i a JOIN i b ON a.fid = b.fid AND a.iid = b.iid AND a.visit <= b.visit GROUP BY ALL)
SELECT * FROM pf LEFT JOIN ps USING (v1, v2)""")
def _(spark, d):
    parts = in_parts(spark, d)
    df = storage.saved(obs(spark, d, parts).select("fid", "iid", (F.year("l_shipdate") % 3).alias("visit"), "y2"))
    mean = df.agg(F.avg("y2")).first()[0]
    sums = mixed.visit_moments(df.select("fid", "iid", "visit", (F.col("y2") - mean).alias("r_y2")), "y2", parts=parts)
    return rounded(sums, 6, "family_sum", "subject_sum")


@query("ag29_delta_r2", f"WITH {OBS}, {LONG}, {OLS} SELECT round(sum(v.f) / sum(v.y), 8) AS d FROM (SELECT y_id, var_samp(a + b * x1) AS f, var_samp(y) AS y FROM long JOIN fit USING (y_id) GROUP BY y_id) v")
def _(spark, d):
    df = obs(spark, d)
    g = linear.gram(df, XS, YS)
    full, reduced = linear.ols(g), linear.ols(linear.part(g, XS[:1]))
    return spark.createDataFrame([(round(linear.delta_r2(df, full, reduced), 8),)], "d double")


@query("ag40_counts", f"WITH {OBS} SELECT count(*) AS n, count(DISTINCT iid) AS subjects, count(DISTINCT fid) AS families FROM obs")
def _(spark, d):
    return obs(spark, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("iid").alias("subjects"), F.countDistinct("fid").alias("families"))


@query("ag41_auc", f"""WITH {OBS}, p AS (SELECT x2 AS s, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS l FROM obs), r AS (SELECT l, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM p)
SELECT round((sum(r) FILTER (l = 1) - count(*) FILTER (l = 1) * (count(*) FILTER (l = 1) + 1) / 2.0) / (count(*) FILTER (l = 1) * 1.0 * count(*) FILTER (l = 0)), 8) AS auc FROM r""")
def _(spark, d):
    df = obs(spark, d).select(F.col("x2").alias("s"), (F.col("flag") == "R").cast("long").alias("l"))
    return rounded(tables.auc(df, "s", "l"), 8, "auc")


@query("ag41_effect_sizes", f"""WITH {OBS}, p AS (SELECT x2 AS s, y1, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS l FROM obs)
SELECT round(corr(s, y1), 8) AS correlation, round((avg(s) FILTER (l = 1) - avg(s) FILTER (l = 0)) / sqrt(((count(*) FILTER (l = 1) - 1) * var_samp(s) FILTER (l = 1)
  + (count(*) FILTER (l = 0) - 1) * var_samp(s) FILTER (l = 0)) / (count(*) - 2)), 8) AS cohen_d FROM p""")
def _(spark, d):
    df = obs(spark, d).select(F.lit(1).alias("one"), "x2", "y1", (F.col("flag") == "R").cast("long").alias("l"))
    both = tables.correlation(df, "x2", "y1", ["one"]).join(tables.cohen_d(df, "x2", "l", ["one"]), "one")
    return rounded(both.drop("one"), 8, "correlation", "cohen_d")


@query("ag39_qq", f"WITH {OBS}, c AS (SELECT CAST(floor(abs(y1) / 0.5) AS BIGINT) AS bucket, count(*) AS n FROM obs GROUP BY 1) SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket DESC) AS BIGINT) AS above FROM c")
def _(spark, d):
    return tables.qq(obs(spark, d), "y1", 0.5)


@query("wn14_positions", "WITH e AS (SELECT n_regionkey AS chr, max(n_nationkey) AS len FROM nation GROUP BY 1), s AS (SELECT chr, coalesce(sum(len) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e) SELECT n_nationkey AS bp, CAST(start + n_nationkey AS BIGINT) AS x FROM nation JOIN s ON n_regionkey = chr")
def _(spark, d):
    df = t(spark, d, "nation").select(F.col("n_regionkey").alias("chr"), F.col("n_nationkey").cast("long").alias("bp"))
    return tables.genome_positions(df).select("bp", F.col("x").cast("long").alias("x"))


@query("wn10_cost_fractions", "SELECT p_partkey, CAST(least(floor(4 * (sum(p_size) OVER (ORDER BY p_partkey)) / (sum(p_size) OVER ()::DOUBLE)), 3) AS BIGINT) AS part FROM part")
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("s"))
    return tables.cost_fractions(p, "p_partkey", "s", 4).select("p_partkey", "part")


@query("snk09_json_by_outcome")
def _(spark, d):
    table = linear.ols(linear.gram(obs(spark, d), XS, YS)).table(spark)
    return sinks.by_key(table, "y_id", "term")


@query("snk_unmask", "SELECT n_nationkey AS y_id, n_nationkey * 10 AS pos, CASE WHEN n_regionkey = 1 THEN 1.5 ELSE 0 END AS beta FROM nation")
def _(spark, d):
    n = t(spark, d, "nation")
    mask = n.select(F.col("n_nationkey").alias("y_id"), (F.col("n_nationkey") * 10).alias("pos"), (F.col("n_regionkey") == 1).alias("in_mask"))
    stats = n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("y_id"), F.lit(1.5).alias("beta"))
    return sinks.unmask(stats, mask, ["beta"], 0.0)


@query("df01_signed_logp")
def _(spark, d):
    table = linear.ols(linear.gram(obs(spark, d), XS, YS)).table(spark)
    return table.select("y_id", "term", dist.signed_log10p_col(F.col("z")).alias("logp"))


@query("rs01_wild_bootstrap")
def _(spark, d):
    df = obs(spark, d)
    return resample.wild_bootstrap(df, mixed.fit(df, XS, YS, n_bins=0), 1, 200, seed=7)


PERM = "p AS (SELECT l_linenumber AS term, l_orderkey % 50 AS perm_id, max(CAST(l_quantity AS DOUBLE)) AS z FROM lineitem GROUP BY ALL)"


@query("wn05_rank_p", f"WITH {PERM}, o AS (SELECT term, z AS observed FROM p WHERE perm_id = 0) SELECT term, observed, round(-log10((count(*) FILTER (z > observed) + 1) / (count(*) + 1.0)), 8) AS logp FROM p JOIN o USING (term) WHERE perm_id > 0 GROUP BY ALL")
def _(spark, d):
    p = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("term"), (F.col("l_orderkey") % 50).alias("perm_id")).agg(F.max(F.col("l_quantity").cast("double")).alias("z"))
    return rounded(resample.rank_p(p, ["term"]), 8, "logp")


@query("wn06_family_wise_p", f"WITH {PERM}, o AS (SELECT term, z AS observed FROM p WHERE perm_id = 0), m AS (SELECT perm_id, max(z) AS top FROM p WHERE perm_id > 0 GROUP BY 1) SELECT term, observed, round(-log10((count(*) FILTER (top > observed) + 1) / (count(*) + 1.0)), 8) AS logp FROM o, m GROUP BY ALL")
def _(spark, d):
    p = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("term"), (F.col("l_orderkey") % 50).alias("perm_id")).agg(F.max(F.col("l_quantity").cast("double")).alias("z"))
    return rounded(resample.family_wise_p(p, [], ["term"]), 8, "logp")


@query("api01_job")
def _(spark, d):
    """A whole job from a spec: dummies, a spline and an interaction, three outcomes."""
    from varimesh.plans import model, spec

    job = spec.from_dict({"params": {
        "dependent": {"name": YS}, "random": ["F", "S", "E"],
        "fixed": {"vars": [{"name": "x1", "type_var": "continuous", "transform": "std"}, {"name": "x2", "type_var": "continuous", "transform": "splines", "splines": {}}, {"name": "flag", "type_var": "categorical"}],
                  "interaction": [["x1", "flag"]]},
    }})
    return model.run(job, obs(spark, d).drop("Intercept").withColumn("eid", F.col("iid")), keys=["iid", "eid"]).estimates


@query("api11_synthesize")
def _(spark, d):
    from varimesh.plans import model

    df = obs(spark, d).select("fid", "iid", "Intercept", "x1").withColumn("eid", F.monotonically_increasing_id())
    made = model.synthesize(df, XS, np.array([[1.0], [0.5]]), (0.2, 0.3, 0.5), seed=3)
    return mixed.fit(made, XS, ["y0"]).share_table(spark)


@query("api12_cross_validated_auc")
def _(spark, d):
    from varimesh.plans import model

    df = obs(spark, d).withColumn("label", (F.col("flag") == "R").cast("double"))
    return model.cross_validated_auc(df, ["Intercept", "x1", "x2"], "label")


def small(spark: SparkSession, d: str) -> DataFrame:
    """Customers in nations, fifty to a family at any scale: a model for effects that need a block for each family."""
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.floor(F.col("c_custkey") / 50).alias("fid"), F.col("c_custkey").alias("iid"), F.lit(1.0).alias("Intercept"), (F.length("c_mktsegment") / 10).alias("x1"),
        (F.col("c_acctbal").cast("double") / 1000).alias("y1"), (F.col("c_custkey") % 3).alias("visit"), F.col("n_regionkey").alias("home_id"), F.col("c_nationkey").alias("mother_id"),
    )


@query("ag14_block_effects")
def _(spark, d):
    """Shared homes and mothers within families; mothers lie within homes, so corrections follow level by level."""
    from varimesh.operators import groups

    f = groups.fit(small(spark, d), XS, ["y1"], ("F", "H", "M", "E"))
    return f.share_table(spark).unionByName(f.gls.table(spark).select("y_id", F.col("term").alias("effect"), F.col("beta").alias("share")))


@query("ag16_group_effects", SQL["fit_gls"])
def _(spark, d):
    """Orders as homes: the same model as with orders as subjects, by the form for any nested groups."""
    from varimesh.operators import groups

    df = obs(spark, d).withColumn("home_id", F.col("iid"))
    table = groups.fit(df, XS, YS, ("F", "H", "E"), n_bins=0).gls.table(spark).drop("logp")
    return rounded(rounded(table, 6, "beta", "se"), 3, "z")


@query("ag16_crossed_effects")
def _(spark, d):
    """Line items' suppliers as fathers and their orders as homes, which cross."""
    from varimesh.operators import groups

    both = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = both.select(F.col("o_custkey").alias("fid"), F.col("l_orderkey").alias("home_id"), (F.col("l_suppkey") % 5).alias("father_id"), F.lit(1.0).alias("Intercept"), (F.col("l_quantity").cast("double") / 10).alias("x1"), F.col("l_discount").cast("double").alias("y1"))
    f = groups.fit(storage.saved(df), XS, ["y1"], ("F", "P", "H", "E"))
    return f.share_table(spark).unionByName(f.gls.table(spark).select("y_id", F.col("term").alias("effect"), F.col("beta").alias("share")))


@query("ag22_maximum_likelihood")
def _(spark, d):
    """Variances of family and home of largest likelihood, with intervals from the profile."""
    from varimesh.operators import likelihood

    df = small(spark, d)
    res = linear.residuals(df, linear.ols(linear.gram(df, XS, ["y1"])), ["fid", "iid", "home_id"])
    effects = ("F", "H", "E")
    best, value = likelihood.maximum_likelihood(res, ["y1"], effects, np.array([[1.0, 1.0, 5.0]]))
    ends = likelihood.profile_intervals(res, ["y1"], effects, best)
    rows = [(e, float(b), float(lo), float(hi), float(value[0])) for e, b, (lo, hi) in zip(effects, best[0], ends[0], strict=True)]
    return spark.createDataFrame(rows, "effect string, variance double, low double, high double, log_likelihood double")


@query("ag17_unstructured")
def _(spark, d):
    from varimesh.operators import blocks

    df = small(spark, d)
    o = linear.ols(linear.gram(df, XS, ["y1"]))
    res = linear.residuals(df, o, ["fid", "iid", "visit"])
    visits, cov, _ = blocks.unstructured(mixed.visit_moments(res, "y1"), float(o.sigma2[0]))
    return blocks.gls_unstructured(df, XS, "y1", visits, cov, float(o.sigma2[0]), o.n).table(spark)


@query("ag21_log_likelihood", """WITH c AS (SELECT c_custkey // 50 AS fid, length(c_mktsegment) / 10.0e0 AS x, CAST(c_acctbal AS DOUBLE) / 1000 AS y FROM customer),
m AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, count(*) AS n FROM c), r AS (SELECT fid, y - b0 - b1 * x AS r FROM c, m), s AS (SELECT sum(r * r) / (any_value(n) - 2) AS s2 FROM r, m),
f AS (SELECT fid, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM r GROUP BY fid), t AS (SELECT sum(n * n) AS a, sum(n) AS e, sum(s * s) / any_value(s2) AS da, sum(q) / any_value(s2) AS de FROM f, s),
u AS (SELECT greatest((da - de) / (a - e), 0) AS f0, (da - de) / (a - e) AS f1, de / e AS e1 FROM t),
v AS (SELECT CASE WHEN f1 < 0 THEN 0 ELSE f0 END AS f, CASE WHEN f1 < 0 THEN e1 ELSE greatest(e1 - f0, 0) END AS e FROM u), w AS (SELECT f / (f + e) * s2 AS f, e / (f + e) * s2 AS e FROM v, s)
SELECT 'y1' AS y_id, round(sum(-0.5 * ((q - f * s * s / (e + n * f)) / e + (n - 1) * ln(e) + ln(e + n * f) + n * ln(2 * pi()))), 4) AS log_likelihood FROM f AS g, w""".replace("FROM f AS g, w", "FROM (SELECT n, s, q FROM f) AS g, w"))
def _(spark, d):
    from varimesh.operators import blocks

    df = small(spark, d)
    f = mixed.fit(df, XS, ["y1"], ("F", "E"))
    res = linear.residuals(df, f.ols, ["fid", "iid"])
    value = blocks.log_likelihood(res, ["y1"], ("F", "E"), f.shares * f.ols.sigma2[:, None])
    return spark.createDataFrame([("y1", round(float(value[0]), 4))], "y_id string, log_likelihood double")


@query("ag30_sandwich", f"""WITH {OBS}, s AS (SELECT regr_slope(y2, x1) AS b, regr_intercept(y2, x1) AS a, count(*) AS n, sum(x1) AS sx, sum(x1 * x1) AS sxx FROM obs),
f AS (SELECT fid, sum(y2 - a - b * x1) AS s0, sum(x1 * (y2 - a - b * x1)) AS s1 FROM obs, s GROUP BY fid), m AS (SELECT sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM f)
SELECT round(sqrt((sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (n * sxx - sx * sx) ^ 2), 8) AS se_intercept,
  round(sqrt((sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / (n * sxx - sx * sx) ^ 2), 8) AS se_x1 FROM s, m""")
def _(spark, d):
    from varimesh.operators import blocks

    df = obs(spark, d)
    c = blocks.sandwich(df, linear.ols(linear.gram(df, XS, ["y2"])), 0)
    return spark.createDataFrame([(round(float(np.sqrt(c[0, 0])), 8), round(float(np.sqrt(c[1, 1])), 8))], "se_intercept double, se_x1 double")


@query("ag31_mediation")
def _(spark, d):
    df = storage.saved(obs(spark, d).select("fid", "iid", *XS, "x2", "y1"))  # joined once for all passes of both models
    full, reduced = mixed.fit(df, ["Intercept", "x1", "x2"], ["y1"]), mixed.fit(df, XS, ["y1"])
    m = resample.mediation(resample.wild_bootstrap(df, full, 0, 100, 5, null=False), resample.wild_bootstrap(df, reduced, 0, 100, 5, null=False), "x1")
    return spark.createDataFrame([(m["estimate"], m["se"], m["t"], *m["normal"], *m["percentile"], m["logp"])], "estimate double, se double, t double, lo double, hi double, p_lo double, p_hi double, logp double")


@query("ag32_multivariate")
def _(spark, d):
    df = obs(spark, d)
    f = mixed.fit(df, XS, YS)
    perms = None
    for k, y in enumerate(YS):
        one = resample.wild_bootstrap(df, f, k, 100, 5).where("term = 'x1'").withColumn("y_id", F.lit(y))
        perms = one if perms is None else perms.unionByName(one)
    return resample.multivariate(perms, YS)


@query("rs06_enhancement")
def _(spark, d):
    """Cluster enhancement of the embeddings' mean map, its dimensions laid out as a 4 x 4 x 4 volume."""
    from varimesh.sources.volumes import grid_edges

    long = t(spark, d, "embeddings").select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg((F.avg("v") / F.stddev_samp("v") * F.sqrt(F.count("v"))).alias("value"))
    return resample.enhance(long.select(F.lit("mean").alias("map_id"), F.col("pos").cast("long").alias("pos"), "value"), grid_edges(spark, (4, 4, 4)))


def dosages(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """Suppliers stand for variants and customers for subjects; dosages from arithmetic on their keys, one in 31 missing. A variant's are bytes with a customer's at the place of its key, -1 for a missing one."""
    from varimesh.operators import gwas

    c = t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("iid"), F.col("c_custkey").cast("long").alias("place"))
    n = (c.agg(F.max("place")).first()[0] or 0) + 1
    repeats = 27 * 31 * 40  # the arithmetic looks at the remainders of a customer's key by 27, 31 and 40 alone

    def read(bp: np.ndarray) -> np.ndarray:
        i, bp = np.arange(min(n, repeats)), bp[:, None]
        value = (bp * 7 + i * 13 + bp * i // 8 % 5 + i // 9 * (bp % 4)) % 3
        made = np.where((bp * 3 + i) % 31 != 0, value, -1).astype(np.int8)
        return np.tile(made, (1, -(-n // len(i))))[:, :n]

    s = t(spark, d, "supplier").select(F.concat(F.lit("rs"), "s_suppkey").alias("snp_id"), (F.col("s_nationkey") % 22 + 1).cast("string").alias("chr"), F.col("s_suppkey").cast("long").alias("bp"))
    return gwas.split(s, chunk=25), {"places": c, "read": read}


GENO = """c AS (SELECT c_custkey AS iid, c_custkey // 50 AS fid, length(c_mktsegment) / 10.0e0 AS x, CAST(c_acctbal AS DOUBLE) / 1000 AS y FROM customer),
raw AS (SELECT s_suppkey AS bp, iid, fid, x, y, CASE WHEN (s_suppkey * 3 + iid) % 31 <> 0 THEN CAST((s_suppkey * 7 + iid * 13 + (s_suppkey * iid // 8) % 5 + (iid // 9) * (s_suppkey % 4)) % 3 AS DOUBLE) END AS g0 FROM supplier, c),
geno AS (SELECT bp, iid, fid, x, y, coalesce(g0, avg(g0) OVER (PARTITION BY bp)) AS g FROM raw)"""
# the variant, x and y with 1 and x taken out, by variant
PARTIAL = """m AS (SELECT bp, count(*) AS n, regr_sxx(g, x) AS sxx, regr_sxy(g, x) AS sgx, regr_sxy(y, x) AS syx, var_pop(g) * count(*) AS sgg, var_pop(y) * count(*) AS syy, covar_pop(g, y) * count(*) AS sgy FROM geno GROUP BY bp),
r AS (SELECT bp, n, sgg - sgx * sgx / sxx AS gg, sgy - sgx * syx / sxx AS gy, syy - syx * syx / sxx AS yy FROM m)"""


@query("gw02_gwas_ols", f"""WITH {GENO}, {PARTIAL} SELECT 'rs' || bp AS snp_id, round(gy / gg, 6) + 0e0 AS beta, round(sqrt((yy - gy * gy / gg) / (n - 3) / gg), 6) AS se,
  round(gy / gg / sqrt((yy - gy * gy / gg) / (n - 3) / gg), 4) + 0e0 AS t FROM r""")
def _(spark, d):
    """Each variant with errors alone."""
    from varimesh.operators import gwas

    df = small(spark, d)
    genes, how = dosages(spark, d)
    out = gwas.gwas(genes, df, mixed.fit(df, XS, ["y1"], ("E",)), **how)
    return rounded(rounded(out.select("snp_id", "beta", "se", "t"), 6, "beta", "se"), 4, "t")


@query("gw03_gwas")
def _(spark, d):
    """Each variant with family covariance, as a main effect and in interaction with x1."""
    from varimesh.operators import gwas

    df = small(spark, d)
    genes, how = dosages(spark, d)
    return gwas.gather([gwas.gwas(genes, df, mixed.fit(df, XS, ["y1"], ("F", "E")), gwas.with_main(["x1"]), "t", **how)])


NATIONS = """c AS (SELECT n_nationkey AS iid, n_regionkey AS fid, any_value(length(n_name)) / 10.0e0 AS x, avg(CAST(c_acctbal AS DOUBLE)) / 1000 AS y FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
raw AS (SELECT vec_id AS bp, iid, fid, x, y, CAST(floor(abs(CAST(embedding[iid + 1] AS DOUBLE)) * 1000) AS BIGINT) % 4 AS g1 FROM embeddings, c),
geno AS (SELECT bp, iid, fid, x, y, coalesce(CAST(nullif(g1, 3) AS DOUBLE), avg(CAST(nullif(g1, 3) AS DOUBLE)) OVER (PARTITION BY bp)) AS g FROM raw)"""


@query("gw02_gwas_arrays", f"""WITH {NATIONS}, {PARTIAL} SELECT 'rs' || bp AS snp_id, round(gy / gg, 5) + 0e0 AS beta, round(sqrt((yy - gy * gy / gg) / (n - 3) / gg), 5) AS se FROM r""")
def _(spark, d):
    """Vectors stand for variants, each an array of dosages of 64 subjects, of whom 25, the nations, are analysed."""
    from varimesh.operators import gwas

    n, c = t(spark, d, "nation"), t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.avg(F.col("c_acctbal").cast("double")) / 1000).alias("y1"))
    df = n.join(c, "n_nationkey").select(F.col("n_nationkey").cast("long").alias("iid"), F.col("n_regionkey").alias("fid"), F.lit(1.0).alias("Intercept"), (F.length("n_name") / 10).alias("x1"), "y1")
    value = lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 4
    genes = F.transform("embedding", lambda x: F.when(value(x) != 3, value(x)).cast("tinyint"))
    variants = t(spark, d, "embeddings").select(F.concat(F.lit("rs"), "vec_id").alias("snp_id"), (F.col("vec_id") % 22 + 1).cast("string").alias("chr"), F.col("vec_id").alias("bp"), genes.alias("dosages"))
    places = n.select(F.col("n_nationkey").cast("long").alias("iid"), F.col("n_nationkey").cast("long").alias("place"))
    return rounded(gwas.gwas(variants, df, mixed.fit(df, XS, ["y1"], ("E",)), places=places).select("snp_id", "beta", "se"), 5, "beta", "se")


@query("xf23_genotype_scaling", """WITH g AS (SELECT p_partkey, [CAST(p_size % 3 AS DOUBLE), CAST(p_partkey % 3 AS DOUBLE), 1.0] AS d FROM part)
SELECT p_partkey, round(list_sum(list_transform(d, lambda x: x * x)) , 6) AS q, round(coalesce((d[1] - list_avg(d)) / nullif(list_stddev_samp(d), 0), 0), 6) AS first FROM g""")
def _(spark, d):
    from varimesh.sources import genotypes

    p = t(spark, d, "part").select("p_partkey", F.array((F.col("p_size") % 3).cast("tinyint"), (F.col("p_partkey") % 3).cast("tinyint"), F.lit(1).cast("tinyint")).alias("dosages"))
    square = F.aggregate(F.transform("dosages", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    out = genotypes.standardise(p.withColumn("q", square), "empirical")
    return out.select("p_partkey", F.round("q", 6).alias("q"), F.round(F.col("dosages")[0], 6).alias("first"))


@query("ag33_relatedness", """WITH raw AS (SELECT p_partkey AS k, i, CASE WHEN (p_partkey + i) % 17 <> 0 THEN CAST((p_partkey * (i + 3) + p_partkey // (i + 2)) % 3 AS DOUBLE) END AS g FROM part, (SELECT unnest(range(20)) AS i)),
m AS (SELECT k, avg(g) AS m FROM raw GROUP BY k), z AS (SELECT k, i, CASE WHEN g IS NULL OR m * (1 - m / 2) <= 0 THEN 0 ELSE (g - m) / sqrt(m * (1 - m / 2)) END AS z FROM raw JOIN m USING (k))
SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(avg(a.z * b.z), 8) + 0e0 AS rel FROM z a JOIN z b ON a.k = b.k AND a.i <= b.i GROUP BY ALL""")
def _(spark, d):
    """Parts stand for variants of twenty subjects, cut into blocks of eight."""
    from varimesh.sources import genotypes

    k = F.col("p_partkey")
    value = lambda i: F.when((k + i) % 17 != 0, ((k * (i + 3) + F.floor(k / (i + 2))) % 3).cast("tinyint"))
    p = t(spark, d, "part").select(F.transform(F.sequence(F.lit(0), F.lit(19)), value).alias("dosages"))
    return rounded(genotypes.relatedness(p, 8), 8, "rel")


@query("xf28_delta_by_age", """WITH b AS (SELECT o_custkey, min_by(o_totalprice, struct_pack(o_orderdate, o_orderkey)) AS base FROM orders GROUP BY 1)
SELECT o_orderkey, round(CAST(o_totalprice AS DOUBLE) - CAST(base AS DOUBLE), 2) AS delta FROM orders JOIN b USING (o_custkey)""")
def _(spark, d):
    o = t(spark, d, "orders").withColumns({"price": F.col("o_totalprice").cast("double"), "age": F.struct("o_orderdate", "o_orderkey")})
    return tr.delta(o, "price", "o_custkey", "age").select("o_orderkey", F.round("price_delta", 2).alias("delta"))


@query("wn13_histogram", f"WITH {OBS}, h AS (SELECT CAST(floor(y1 / 0.25) AS BIGINT) AS bucket, count(*) AS n FROM obs GROUP BY 1) SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS total FROM h")
def _(spark, d):
    return tables.histogram(obs(spark, d), "y1", 0.25)


@query("wn12_spline_curve")
def _(spark, d):
    """Effect and slope of a spline of order value along its grid, with standard errors."""
    df = obs(spark, d)
    ends = df.agg(F.min("x2"), F.max("x2")).first()
    b = splines.basis((float(ends[0]), float(ends[1])), tr.hazen(df, "x2", [0, 25, 50, 75, 100]))
    df, names = splines.add_basis(df, "x2", b)
    f = linear.ols(linear.gram(df, [*names, "Intercept"], ["y1"]))
    rows = [(kind, *r) for kind, slope in (("effect", False), ("slope", True)) for r in b.curve(f.beta[:, 0], f.covariance(0), slope)]
    return spark.createDataFrame(rows, "kind string, x double, value double, se double, z double")


@query("snk11_json_by_term")
def _(spark, d):
    return sinks.by_key(linear.ols(linear.gram(obs(spark, d), XS, YS)).table(spark), "term", "y_id")


@query("snk13_region_ranges", "SELECT n_name AS region, CASE WHEN c_custkey % 2 = 0 THEN 'lh' ELSE 'rh' END AS side, round(min(CAST(c_acctbal AS DOUBLE)), 2) AS low, round(max(CAST(c_acctbal AS DOUBLE)), 2) AS high, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    roi = F.concat("n_name", F.when(F.col("c_custkey") % 2 == 0, "_lh").otherwise("_rh"))
    return rounded(sinks.hemisphere_ranges(c.select(roi.alias("roi"), F.col("c_acctbal").cast("double").alias("value"))), 2, "low", "high")


@query("snk09_triangle", "SELECT vec_id, CASE i WHEN 1 THEN 'a' WHEN 2 THEN 'a' ELSE 'b' END AS a, CASE i WHEN 1 THEN 'b' ELSE 'c' END AS b, round(CAST(embedding[i] AS DOUBLE), 5) AS value FROM embeddings, (SELECT UNNEST([1, 2, 3]) AS i)")
def _(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("c"))
    return sinks.upper_triangle(e, ["vec_id"], "c", ["a", "b", "c"]).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("gw10_manhattan_input", f"WITH {OBS} SELECT fid, iid, round(abs(y3), 6) AS logp FROM obs WHERE abs(y3) >= 0.05")
def _(spark, d):
    """Clean-up of plot input: finite values at or above a threshold, by size."""
    return tables.clean_scores(obs(spark, d), "y3", 0.05).select("fid", "iid", F.round("y3", 6).alias("logp"))


@query("xf34_region_key", "SELECT p_partkey, regexp_replace(p_type, ' (TIN|NICKEL)$', '') AS region FROM part")
def _(spark, d):
    """Names of regions as files have them: a parcellation in front, a suffix of a mean behind."""
    p = t(spark, d, "part").select("p_partkey", F.concat(F.lit("smri_parc__"), F.regexp_replace(F.regexp_replace("p_type", " TIN$", "_wmean"), " NICKEL$", "_mean")).alias("k"))
    return p.select("p_partkey", tables.region_key(F.col("k")).alias("region"))


@query("flt12_significant", f"WITH {OBS} SELECT fid, iid, round(y1, 6) AS y1 FROM obs WHERE y1 >= -log10(0.00001)")
def _(spark, d):
    return tables.significant(obs(spark, d), "y1", 1e-5).select("fid", "iid", F.round("y1", 6).alias("y1"))


@query("flt14_mask", "SELECT l_partkey AS pos, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 25) GROUP BY 1")
def _(spark, d):
    atlas = t(spark, d, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") / 50.0).alias("probability"))
    return tables.mask_by_probability(t(spark, d, "lineitem").select(F.col("l_partkey").alias("pos")), atlas, 0.5).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


@query("flt15_visits", "SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(event_type, '^[a-m]') GROUP BY 1")
def _(spark, d):
    return tables.visits(t(spark, d, "events"), "^[a-m]", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("xf28_baseline_square", """WITH b AS (SELECT user_id, min_by(value, struct_pack(ts, event_id)) AS base FROM events GROUP BY 1)
SELECT event_id, round(base * base * 2, 6) AS x FROM events JOIN b USING (user_id)""")
def _(spark, d):
    e = tr.delta(t(spark, d, "events").withColumn("at", F.struct("ts", "event_id")), "value", "user_id", "at")
    return e.select("event_id", F.round(tr.baseline_square("value"), 6).alias("x"))


@query("ag07_type_ids", """WITH p AS (SELECT o_custkey AS fid, l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
f AS (SELECT fid, array_to_string(list_sort(list(n)), ',') AS shape FROM p GROUP BY 1), s AS (SELECT shape, row_number() OVER (ORDER BY min(fid)) AS type_id FROM f GROUP BY 1)
SELECT fid, type_id FROM f JOIN s USING (shape)""")
def _(spark, d):
    return mixed.type_ids(mixed.family_types(obs(spark, d).select("fid", "iid"))).select("fid", F.col("type_id").cast("long").alias("type_id"))


@query("ag20_omnibus", f"""WITH {OBS}, m AS (SELECT count(*) AS n, regr_sxx(x1, x1) AS a, regr_sxy(x1, x2) AS b, regr_sxx(x2, x2) AS c, regr_sxy(y1, x1) AS u, regr_sxy(y1, x2) AS v, regr_sxx(y1, y1) AS s FROM obs),
e AS (SELECT *, (c * u * u - 2 * b * u * v + a * v * v) / (a * c - b * b) AS ss FROM m) SELECT round(ss / ((s - ss) / (n - 3)), 2) AS wald, CAST(2 AS BIGINT) AS df FROM e""")
def _(spark, d):
    """All columns of one variable at once, as of a spline."""
    df = obs(spark, d).withColumnsRenamed({"x1": "x_1", "x2": "x_2"})
    rows = linear.omnibus(linear.ols(linear.gram(df, ["Intercept", "x_1", "x_2"], ["y1"])), ["x"])
    return spark.createDataFrame([(round(w, 2), k) for _, _, w, k, _ in rows], "wald double, df long")


@query("wn04_family_order", f"WITH {OBS}, n AS (SELECT *, count(*) OVER (PARTITION BY fid, iid) AS k FROM obs), o AS (SELECT fid, iid, row_number() OVER (PARTITION BY fid ORDER BY k DESC, iid, l_shipdate) AS place FROM n) SELECT fid, iid, CAST(sum(place) AS BIGINT) AS places FROM o GROUP BY ALL")
def _(spark, d):
    placed = tables.in_family_order(obs(spark, d), "l_shipdate")
    return placed.groupBy("fid", "iid").agg(F.sum("place").cast("long").alias("places"))


SQUARED = """p AS (SELECT term, perm_id, m - 20 + CASE WHEN perm_id = 0 THEN term / 1.5e0 ELSE 0 END AS z
  FROM (SELECT l_linenumber AS term, l_orderkey % 60 AS perm_id, avg(CAST(l_quantity AS DOUBLE)) AS m FROM lineitem GROUP BY ALL)),
q AS (SELECT term, perm_id, z * z AS x FROM p), k AS (SELECT term, avg(x) AS m, var_samp(x) AS v, quantile_cont(x, 0.5) AS cut, count(*) AS n FROM q WHERE perm_id > 0 GROUP BY term),
o AS (SELECT term, x AS observed FROM q WHERE perm_id = 0), rk AS (SELECT q.term, -log10((count(*) FILTER (x > observed) + 1) / (count(*) + 1.0)) AS logp FROM q JOIN o ON q.term = o.term WHERE perm_id > 0 GROUP BY q.term)"""


def perms(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers stand for terms and orders for resamples; the observed one is moved out, the further the higher its term."""
    of = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("term"), (F.col("l_orderkey") % 60).alias("perm_id")).agg(F.avg(F.col("l_quantity").cast("double")).alias("m"))
    return of.select("term", "perm_id", (F.col("m") - 20 + F.when(F.col("perm_id") == 0, F.col("term") / 1.5).otherwise(0.0)).alias("z"))


@query("wn08_extreme_value_tail", f"""WITH {SQUARED}, g AS (SELECT term, m, cut, observed, sqrt(6 * v) / pi() AS s, logp FROM k JOIN o USING (term) JOIN rk USING (term))
SELECT term, round(CASE WHEN observed > cut THEN -log10(1 - exp(-exp(-(observed - (m - s * 0.5772156649015329)) / s))) ELSE logp END, 6) + 0e0 AS logp FROM g""")
def _(spark, d):
    return rounded(resample.tail_p(perms(spark, d), ["term"], quantile=0.5, law="extreme"), 6, "logp")


@query("wn09_pareto_tail", f"""WITH {SQUARED}, e AS (SELECT q.term, avg(x - cut) AS em, var_samp(x - cut) AS ev, count(*) AS above FROM q JOIN k ON q.term = k.term WHERE perm_id > 0 AND x > cut GROUP BY q.term),
g AS (SELECT k.term, cut, observed, n, above, ev, (1 - em * em / ev) / 2 AS c, em * (em * em / ev + 1) / 2 AS s, logp FROM k JOIN o ON k.term = o.term JOIN rk ON k.term = rk.term LEFT JOIN e ON k.term = e.term)
SELECT term, round(CASE WHEN observed > cut AND above > 1 AND ev > 0 AND 1 + c * (observed - cut) / s > 0 THEN -log10(above / n::DOUBLE * (1 + c * (observed - cut) / s) ^ (-1 / c)) ELSE logp END, 6) + 0e0 AS logp FROM g""")
def _(spark, d):
    return rounded(resample.tail_p(perms(spark, d), ["term"], quantile=0.5, law="pareto"), 6, "logp")


@query("rs01_array_bootstrap")
def _(spark, d):
    """Ranks of 64 outcomes' statistics among their resamples, and among the largest of all outcomes."""
    df = vectors(spark, d)
    return array_resample.Bootstrap(df, arrays.fit(df, XS, "embedding", 64), "embedding", 200, 5).significance()


@query("wn07_cross_outcome_tail")
def _(spark, d):
    """One gamma law for each term over the resamples of all 64 outcomes, every outcome judged by it; and the law of the largest of all outcomes."""
    df = vectors(spark, d)
    p = array_resample.Bootstrap(df, arrays.fit(df, XS, "embedding", 64), "embedding", 200, 5).table()
    own = tails.tail_p(p, ["term", "y_id"], over=["y_id"])
    whole = tails.family_tail_p(p, ["term"], ["term", "y_id"]).select("term", "y_id", F.col("logp").alias("family_logp"))
    return own.join(whole, ["term", "y_id"])


@query("wn08_weibull_tail")
def _(spark, d):
    return tails.tail_p(perms(spark, d), ["term"], law="weibull", low=0.5, high=0.95)


@query("ag32_array_multivariate")
def _(spark, d):
    """The joint statistic of 64 outcomes from products of resamples, without their covariance."""
    df = vectors(spark, d)
    return array_resample.Bootstrap(df, arrays.fit(df, XS, "embedding", 64), "embedding", 200, 5).multivariate("x1", 20)


@query("api04_outcomes", """WITH c AS (SELECT c_custkey AS iid, c_nationkey AS eid, CAST(c_acctbal AS DOUBLE) AS v FROM customer),
q AS (SELECT DISTINCT o_custkey AS iid FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT c.*, v IS NOT NULL AS a, q.iid IS NOT NULL AS b, n_nationkey IS NOT NULL AS d FROM c LEFT JOIN q USING (iid) LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) ON n_nationkey = eid)
SELECT 'missing outcome' AS reason, count(*) FILTER (NOT a) AS n, NULL::DOUBLE AS total FROM f UNION ALL SELECT 'subject', count(*) FILTER (NOT b), NULL FROM f UNION ALL SELECT 'event', count(*) FILTER (NOT d), NULL FROM f
UNION ALL SELECT 'kept', count(*), round(sum(v), 2) FROM f WHERE a AND b AND d""")
def _(spark, d):
    """Customers' balances as outcomes, cut to those with finished orders and to three regions' nations, with an account of the rest."""
    from varimesh.sources import outcomes

    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double").alias("v"))
    done = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("iid"))
    near = t(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("eid"))
    got = outcomes.load_outcomes(c, "external", keys=("c_custkey", "c_nationkey"), subjects=done, events=near)
    kept = got.df.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))
    return got.dropped.select("reason", "n", F.lit(None).cast("double").alias("total")).unionByName(kept)


@query("ag34_block_permutations")
def _(spark, d):
    """Customers exchanged within their nations, segments as variance groups: the G statistic of a permutation test."""
    from varimesh.operators import exchange

    c = t(spark, d, "customer").select(F.col("c_custkey").alias("row"), F.col("c_nationkey").alias("block"), F.col("c_mktsegment").alias("variance_group"), F.lit(1.0).alias("Intercept"), (F.col("c_custkey") % 7).cast("double").alias("x1"), (F.col("c_acctbal").cast("double") / 1000).alias("y"))
    return exchange.permutation_test(c, XS, "y", ["x1"], 50, seed=3)


@query("ag42_kernel_classifier")
def _(spark, d):
    """Whether a vector's label is odd, from all its places by a radial kernel, on families left out."""
    from varimesh.plans import classify

    e = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("fid"), "embedding", (F.col("label") % 2).alias("odd"))
    return classify.kernel_auc(e, "embedding", 64, "odd", k_folds=5, n_components=20, features=128, seed=1)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
