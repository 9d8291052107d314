"""``python -m varimesh {version,cite,fit,basis,gwas}``: run a job from files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

import varimesh


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="varimesh")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("version")
    sub.add_parser("cite")
    fit = sub.add_parser("fit", help="fit a job spec to a table")
    fit.add_argument("--spec", required=True, help="JSON or TOML job")
    fit.add_argument("--data", required=True)
    fit.add_argument("--outcomes")
    fit.add_argument("--out", required=True)
    basis = sub.add_parser("basis", help="write a spline basis on its grid")
    basis.add_argument("--ends", nargs=2, type=float, required=True)
    basis.add_argument("--knots", nargs="*", type=float, default=[])
    basis.add_argument("--kind", default="nsk")
    basis.add_argument("--method", default="svd")
    basis.add_argument("--out", required=True)
    scan = sub.add_parser("gwas", help="associate variants with the outcomes of a fitted job")
    for name in ("spec", "data", "plink", "out"):
        scan.add_argument(f"--{name}", required=True)
    a = p.parse_args(argv)
    if a.what in ("version", "cite"):
        print(varimesh.__version__ if a.what == "version" else f"varimesh {varimesh.__version__}: mass-univariate mixed models on Spark")
        return
    spark = SparkSession.builder.getOrCreate()
    if a.what == "basis":
        from varimesh.functions.splines import basis as make

        b = make(tuple(a.ends), a.knots, a.kind, a.method)
        rows = [(float(x), *map(float, v)) for x, v in zip(b.grid, b.values, strict=True)]
        spark.createDataFrame(rows, "x double, " + ", ".join(f"bf{k + 1} double" for k in range(b.values.shape[1]))).write.mode("overwrite").parquet(a.out)
        return
    from varimesh.plans import model, spec
    from varimesh.sources.sinks import save_run, write_table
    from varimesh.sources.tables import read_table

    text = "\n".join(r[0] for r in spark.read.text(a.spec).collect())
    job = spec.from_toml(text) if a.spec.endswith(".toml") else spec.from_json(text)
    data = read_table(spark, a.data)
    if a.what == "fit":
        result = model.run(job, data, read_table(spark, a.outcomes) if a.outcomes else None)
        save_run(result, a.out, {"spec": a.spec, "random": list(job.random), "n_bins": job.n_bins})
        return
    from pyspark.sql import functions as F

    from varimesh.operators import gwas
    from varimesh.sources import genotypes

    result = model.run(job, data)
    rows = result.design.df.select("fid", F.col("iid").cast("string").alias("iid"), *result.design.columns, *job.outcomes)
    variants = genotypes.genotypes(spark, a.plink)
    out = gwas.gwas(variants, rows, result.fit, places=genotypes.read_fam(spark, f"{a.plink}.fam").withColumnRenamed("row", "place"))
    write_table(gwas.gather([out]), a.out)


if __name__ == "__main__":
    main()
