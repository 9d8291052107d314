"""Loading outcomes with their checks, two header lines, kinds of association and the files of a run."""

import json

import pytest
from pyspark.sql import functions as F

from varimesh.operators import gwas
from varimesh.plans import model, spec
from varimesh.sources import outcomes, sinks, tables


def test_chain_of_checks(spark):
    rows = [(f"s{k}", f"e{k % 2}", [float(k), 1.0, 5.0], [0.9, 0.8 + 0.01 * k]) for k in range(8)]
    rows[1] = (*rows[1][:2], [1.0, None, 5.0], rows[1][3])
    rows[2] = (*rows[2][:2], [float("inf"), 1.0, 5.0], rows[2][3])
    rows[3] = (*rows[3][:3], [0.1, 0.2])
    df = spark.createDataFrame(rows, "participant_id string, session_id string, y array<double>, corr array<double>")
    qc = spark.createDataFrame([(f"s{k}", f"e{k % 2}", "1" if k != 4 else "0") for k in range(8) if k != 5] + [("s6", "e0", "1")], "participant_id string, session_id string, ok string")
    got = outcomes.load_outcomes(
        df, "voxel", correlation="corr", quality=qc, quality_variable="ok", subjects=spark.createDataFrame([(f"s{k}",) for k in (0, 0, 1, 2, 3, 4, 5, 6)], "iid string"),
        pregnancy=spark.createDataFrame([("s0", "e0", 7), ("s0", "e0", 5)], "iid string, eid string, preg_id int"),
    )
    assert [(r.iid, r.preg_id) for r in got.df.orderBy("iid").collect()] == [("s0", 5), ("s6", None)]
    assert {r.reason: r.n for r in got.dropped.collect()} == {"missing outcome": 2, "registration": 1, "quality": 2, "subject": 1}
    assert {r.pos: r.in_mask for r in got.mask.collect()} == {0: True, 1: False, 2: False}
    assert outcomes.load_outcomes(df.limit(0), "voxel").df.count() == 0


def test_kinds_and_transforms(spark):
    df = spark.createDataFrame([("a", "1", 2.0, "x", 400), ("b", "1", 4.0, "y", 300), ("c", "1", 9.0, "z", 500), ("d", "1", None, "z", 500)], "participant_id string, session_id string, v double, word string, n int")
    two = spark.createDataFrame([("a",), ("b",)], "iid string")
    own = outcomes.load_outcomes(df, "external", subjects=two, transform="center")
    assert own.names == ["v", "n"] and {r.iid: r.v for r in own.df.collect()} == {"a": -1.0, "b": 1.0}
    whole = outcomes.load_outcomes(df, "roi", subjects=two, transform="center", whole_sample=True)
    assert {r.iid: r.v for r in whole.df.collect()} == {"a": -3.0, "b": -1.0}
    arrays = df.select("participant_id", "session_id", F.array(F.lit(1.0), F.lit(2.0)).alias("y"), "n")
    kept = outcomes.load_outcomes(arrays, "corrmat", frames="n")
    assert kept.df.count() == 3 and {r.reason: r.n for r in kept.dropped.collect()} == {"missing outcome": 0, "frames": 1}
    long = df.select("participant_id", "session_id", F.array_repeat(F.lit(1.0), 50).alias("y"))
    assert outcomes.load_outcomes(long, "vertex", order=1).df.select(F.size("y")).first()[0] == 42
    with pytest.raises(ValueError):
        outcomes.load_outcomes(df, "sound")


def test_two_headers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("id\tage\tsite\nSubject\tAge, years\tSite\na\t9.5\tx\nb\tNA\ty\n")
    df, labels = tables.read_two_headers(spark, str(tmp_path / "t.txt"))
    assert labels == {"id": "Subject", "age": "Age, years", "site": "Site"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("a", 9.5, "x"), ("b", None, "y")]


def test_kinds_of_association():
    assert gwas.typed("cross") is None and gwas.typed("long") is None
    assert gwas.typed("long_interact", ["t1", "t2"]) == ["Intercept", "t1", "t2"] and gwas.typed("cross_interact", ["sex"], main=False) == ["sex"]
    for bad in (("other",), ("long_interact",)):
        with pytest.raises(ValueError):
            gwas.typed(*bad)


def test_files_of_a_run(spark, tmp_path):
    df = spark.range(60).select(F.floor(F.col("id") / 6).alias("fid"), F.floor(F.col("id") / 2).alias("iid"), F.col("id").alias("eid"), F.rand(1).alias("x"), F.randn(2).alias("y"))
    job = spec.from_dict({"params": {"dependent": {"name": ["y"]}, "random": ["F", "S", "E"], "fixed": {"vars": [{"name": "x", "type_var": "continuous"}]}}})
    run = model.run(job, df)
    sinks.save_run(run, str(tmp_path / "out"))
    files = json.loads(spark.read.text(str(tmp_path / "out/files")).first()[0])
    assert {f["name"] for f in files} >= {"estimates", "shares", "by_term", "summary"} and all(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f["path"]).count() for f in files)
    by_term = {(r.kind, r.key): json.loads(r.json) for r in spark.read.parquet(str(tmp_path / "out/by_term")).collect()}
    assert set(by_term) == {("fixed", "x"), ("fixed", "Intercept"), ("random", "F"), ("random", "S"), ("random", "E"), ("variance", "sigma2")}
    assert by_term["variance", "sigma2"][0]["sigma2"] == pytest.approx(run.fit.gls.sigma2[0])
    wald = spark.createDataFrame([("y", 0, 3.5, 2, float("inf"))], "y_id string, contrast int, statistic double, df int, logp double")
    rows = {(r.kind, r.key): r.json for r in sinks.by_term(run.estimates, wald=wald).collect()}
    assert json.loads(rows["wald", "0"]) == [{"y_id": "y", "statistic": 3.5, "df": 2, "logp": "Inf"}]
