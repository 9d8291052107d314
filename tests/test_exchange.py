"""Permutations within and of blocks, all of them where they are few, and the G statistic."""

from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from varimesh.operators import exchange, linear


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    rows = [(k, f"b{k // 3}", "u" if k % 2 else "v", 1.0, float(rng.normal()), float(rng.normal()), 0.0) for k in range(24)]
    rows = [(*r[:6], float(0.8 * r[4] + r[5] + rng.normal() * (2 if r[2] == "u" else 0.5))) for r in rows]
    return spark.createDataFrame(rows, "row long, block string, variance_group string, one double, x double, w double, y double").cache(), rows


def test_moves_stay_where_they_may(spark, data, monkeypatch):
    df, rows = data
    block = {r[0]: r[1] for r in rows}
    for size in (50_000, 2):
        monkeypatch.setattr(exchange, "RANGE", size)
        moves, n = exchange.sources(df, 40, "within", 1)
        got = moves.toPandas()
        assert n == 40 and len(got) == 40 * 24 and (got.sign == 1).all()
        for _, part in got.groupby("perm_id"):
            assert sorted(part.source) == sorted(part.row) == list(range(24)) and all(block[a] == block[b] for a, b in zip(part.row, part.source, strict=True))
        again = exchange.sources(df.repartition(7), 40, "within", 1)[0].toPandas()
        assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, got.to_numpy()))
    whole = exchange.sources(df, 30, "whole", 2, signs=True)[0].toPandas()
    for _, part in whole.groupby("perm_id"):
        assert sorted(part.source) == list(range(24))
        assert part.groupby(part.row.map(block)).agg({"source": lambda s: s.map(block).nunique(), "sign": "nunique"}).max().tolist() == [1, 1]
    with pytest.raises(ValueError):
        exchange.sources(df, 5, "none")


def test_orders_are_drawn_evenly(spark):
    df = spark.createDataFrame([(k, "a" if k < 3 else None) for k in range(5)], "row long, block string")
    got = exchange.sources(df, 1200, "within", 3, exhaustive=False)[0].toPandas().pivot(index="perm_id", columns="row", values="source")
    counts = got.value_counts()
    assert len(counts) == 12 and ((counts - 100) ** 2 / 100).sum() < 35


def brute(rows, xs, tested, orders, groups):
    """G of each order by plain least squares."""
    m = np.array([[r[{"one": 3, "x": 4, "w": 5}[c]] for c in xs] for r in rows])
    y = np.array([r[6] for r in rows])
    z = m[:, [i for i, c in enumerate(xs) if c not in tested]]
    r0 = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    at, out = [xs.index(c) for c in tested], []
    hat = np.eye(len(y)) - m @ np.linalg.pinv(m)
    for order in orders:
        v = r0[list(order)]
        b = np.linalg.lstsq(m, v, rcond=None)[0]
        e = v - m @ b
        w = np.zeros(len(y))
        for g in set(groups):
            own = np.array(groups) == g
            w[own] = np.trace(hat[np.ix_(own, own)]) / (e[own] @ e[own])
        c = np.linalg.inv(m.T @ np.diag(w) @ m)[np.ix_(at, at)]
        s = len(at)
        spread = 1 + 2 * (s - 1) / (s * (s + 2)) * sum((1 - w[np.array(groups) == g].sum() / w.sum()) ** 2 / np.trace(hat[np.ix_(np.array(groups) == g, np.array(groups) == g)]) for g in set(groups))
        out.append(b[at] @ np.linalg.inv(c) @ b[at] / (spread * s))
    return np.array(out)


@pytest.mark.parametrize("tested", [["x"], ["x", "w"]])
def test_all_orders_of_a_small_case(spark, data, tested):
    _, rows = data
    rows = rows[:9]
    df = spark.createDataFrame(rows, "row long, block string, variance_group string, one double, x double, w double, y double")
    xs = ["one", "x", "w"]
    orders = [sum(map(list, o), []) for o in product(*(permutations(range(k, k + 3)) for k in (0, 3, 6)))]
    want = brute(rows, xs, tested, orders, [r[2] for r in rows])
    got = exchange.permutation_test(df, xs, "y", tested, 215).toPandas()
    assert len(got) == 216 and sorted(got.statistic) == pytest.approx(sorted(want), rel=1e-6)
    assert got.logp[0] == pytest.approx(-np.log10((want >= want[0] * (1 - 1e-10)).mean()))
    whole = [sum((list(range(3 * b, 3 * b + 3)) for b in o), []) for o in permutations(range(3))]
    want = brute(rows, xs, tested, whole, [""] * 9)
    placed = exchange.permutation_test(df.drop("variance_group"), xs, "y", tested, 5, "whole").toPandas()
    assert len(placed) == 6 and placed.statistic[0] == pytest.approx(want[0])
    f = linear.ols(linear.gram(df, xs, ["y"]))
    assert want[0] == pytest.approx(linear.wald(f, [np.eye(3)[[xs.index(c) for c in tested]]], use_f=True)[0][2])


def test_drawn_orders_near_all_orders(data):
    df, rows = data
    xs = ["one", "x", "w"]
    got = exchange.permutation_test(df, xs, "y", ["x"], 400, seed=5).toPandas()
    rng = np.random.default_rng(1)
    orders = [np.arange(24)] + [np.concatenate([rng.permutation(3) + 3 * b for b in range(8)]) for _ in range(2000)]
    want = brute(rows, xs, ["x"], orders, [r[2] for r in rows])
    assert got.statistic[0] == pytest.approx(want[0]) and 10 ** -got.logp[0] == pytest.approx((want >= want[0]).mean(), abs=0.06)
    flipped = exchange.permutation_test(df, xs, "y", ["x"], 50, "none", signs=True)
    assert flipped.count() == 51 and exchange.permutation_test(df.limit(0), xs, "y", ["x"], 5).count() == 0
