"""Each registered query of the library against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from varimesh import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, db, name):
    df = q.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    assert rows
    if name in q.SQL:
        got = db.sql(q.SQL[name])
        assert sorted(got.columns) == names
        at = [got.columns.index(c) for c in names]
        want = [tuple(plain(r[i]) for i in at) for r in got.fetchall()]
        assert len(rows) == len(want)
        key = lambda r: tuple((x is None, str(x) if not isinstance(x, float) else f"{x:020.4f}") for x in r)
        for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
            assert a == pytest.approx(b, abs=2e-3) if all(isinstance(x, float) or x is None for x in a) else all(x == y or (isinstance(x, float) and abs(x - y) < 2e-3 * max(1, abs(y))) for x, y in zip(a, b, strict=True)), (a, b)


def test_enhancement_takes_a_hundred_steps(spark):
    """The registered enhancement against clusters grown by hand at each of the reference's hundred heights."""
    got = {r["pos"]: r["tfce"] for r in q.QUERIES["rs06_enhancement"](spark, DATA).collect()}
    v = np.array([list(r[0]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("embedding").collect()], float)
    v = v.mean(0) / v.std(0, ddof=1) * np.sqrt(len(v))
    place = np.stack(np.unravel_index(np.arange(64), (4, 4, 4)), 1)
    near = np.abs(place[:, None] - place[None]).max(2) <= 1
    want, dh = np.zeros(64), np.abs(v).max() / 100
    for k in range(1, 101):
        left = set(np.nonzero(np.abs(v) >= k * dh - 1e-9 * dh)[0].tolist())
        while left:
            own = todo = {left.pop()}
            while todo:
                todo = {j for j in left if near[j, list(todo)].any()}
                left -= todo
                own = own | todo
            want[list(own)] += len(own) ** 0.5 * (k * dh) ** 2 * dh
    assert len(got) == 64 and [got[i] for i in range(64)] == pytest.approx((np.sign(v) * want).tolist(), rel=1e-6)


@pytest.mark.parametrize("name", ["gw02_gwas_ols", "gw03_gwas"])
def test_every_supplier_is_a_variant(spark, db, name):
    """The whole job: as many variants as suppliers, not a fixed number of them."""
    got = {r["snp_id"] for r in q.QUERIES[name](spark, DATA).select("snp_id").collect()}
    assert got == {f"rs{r[0]}" for r in db.sql("select s_suppkey from supplier").fetchall()}
