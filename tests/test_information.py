"""Nearest-neighbour mutual information, against a plain comparison of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linelens.operators import information


def psi(n):
    n, out = float(n), 0.0
    while n < 40:
        out, n = out - 1 / n, n + 1
    return out + math.log(n) - 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * n**4)


def all_pairs(x, y, k=3):
    x, y = x / x.std(), y / y.std()
    n, total = len(x), 0.0
    for i in range(n):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        d = np.maximum(dx, dy)
        r = np.sort(np.delete(d, i))[k - 1]
        if r == 0:
            kp, nx, ny = (d == 0).sum(), (dx == 0).sum(), (dy == 0).sum()
        else:
            kp, nx, ny = k, (dx < r * (1 - 1e-10)).sum(), (dy < r * (1 - 1e-10)).sum()
        total += psi(kp) - psi(nx) - psi(ny)
    return max(0.0, total / n + psi(n))


def test_like_all_pairs(spark):
    rng = np.random.default_rng(3)
    n = 5000
    y = rng.normal(size=n)
    data = {
        "noise": rng.normal(size=n), "linear": y + rng.normal(size=n), "square": y**2 + 0.1 * rng.normal(size=n), "steps": np.floor(2 * y) * 1.0,
        "heavy": np.where(rng.random(n) < 0.4, 0.0, y + 0.3 * rng.normal(size=n)), "tail": np.exp(3 * rng.normal(size=n)) + np.abs(y)}
    rows = [(k, float(y[k]), *[float(v[k]) for v in data.values()], 1.0) for k in range(n)]
    df = spark.createDataFrame(rows, ["row_key", "y", *data, "same"]).repartition(4)
    got = {r.factor: r for r in information.neighbour_information(df, "y", [*data, "same"], "row_key", cell=150).collect()}
    for name, x in data.items():
        assert got[name].n == n
        assert got[name].mi == pytest.approx(all_pairs(x, y), abs=2e-4), name
        assert got[name].mi_baseline < 0.06
    assert got["linear"].mi == pytest.approx(0.5 * math.log(2), abs=0.05) and got["noise"].mi < 0.05 < got["steps"].mi
    assert (got["same"].n, got["same"].mi, got["same"].mi_baseline) == (0, None, None)


def test_discrete_targets_nulls_and_few_rows(spark):
    rng = np.random.default_rng(4)
    n = 600
    y, x = rng.integers(0, 3, n), rng.integers(0, 4, n)
    x = np.where(rng.random(n) < 0.5, y, x)
    rows = [(k, float(y[k]), float(x[k]), float(x[k]) if k % 2 else None, 1.0 * k if k < 20 else None, float("nan") if k % 3 else float(x[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "row_key long, y double, x double, half double, few double, nans double")
    got = {r.factor: r for r in information.neighbour_information(df, "y", ["x", "half", "few", "nans"], "row_key", cell=50).collect()}
    assert got["x"].mi == pytest.approx(all_pairs(x * 1.0, y * 1.0), abs=2e-4)
    assert got["half"].n == n // 2 and got["half"].mi == pytest.approx(all_pairs(x[1::2] * 1.0, y[1::2] * 1.0), abs=2e-4)
    assert got["nans"].n == n // 3 and got["few"].n == 20 and got["few"].mi is None
    assert information.neighbour_information(df.where("false"), "y", ["x"], "row_key").first().mi is None


def test_digamma(spark):
    values = [1, 2, 3, 7, 50, 10**6]
    got = spark.createDataFrame([(float(v),) for v in values], "n double").select(information.digamma(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([psi(v) for v in values], abs=1e-9)


def test_a_value_is_in_one_strip_and_its_rows_stay_in_their_cells(spark):
    rng = np.random.default_rng(5)
    n = 6000
    x, y = rng.integers(0, 4, n) * 1.0, rng.permutation(n) / n
    points = spark.createDataFrame([(2, float(a), float(b), 1, k) for k, (a, b) in enumerate(zip(x, y))], "g int, x double, y double, w long, id long")
    cells = information._cells(points, 100)
    assert cells.groupBy("x").agg(F.countDistinct("strip").alias("n")).agg(F.max("n")).first()[0] == 1
    sizes = [r["count"] for r in cells.groupBy("strip", "cell").count().collect()]
    assert sum(sizes) == n and 100 <= min(sizes) and max(sizes) < 200
    for k in (3, 40):
        got = {r.id: r.r for r in information._radii(cells, k).collect()}
        for i in range(0, n, 37):
            d = np.sort(np.maximum(np.abs(x - x[i]), np.abs(y - y[i])))[k]
            assert got[i] == pytest.approx(d, abs=1e-12)


def test_counts_along_an_axis_come_from_the_neighbours_in_a_run(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n, asked = 3000, []
    x = np.where(rng.random(n) < 0.1, 0.25, rng.random(n))  # a tenth of the points have one value
    y, w, r = rng.integers(0, 5, n) / 4, rng.integers(1, 4, n), np.where(rng.random(n) < 0.2, 0.0, 0.004 * rng.random(n))
    r[:3] = 0.6  # these leave every piece
    rows = [(k, 2 + k % 2, float(x[k]), float(y[k]), int(w[k]), float(r[k]), 3) for k in range(n)]
    radii = spark.createDataFrame(rows, "id long, g int, x double, y double, w long, r double, kp long").repartition(3)
    plain = information.cumulative

    def counting(df, *how):
        asked.append(df.where("id IS NOT NULL").count())
        return plain(df, *how)

    monkeypatch.setattr(information, "cumulative", counting)
    want = []
    for k in range(n):
        same = np.arange(n) % 2 == k % 2
        for v in (x, y):
            edge = max(r[k] - 1e-12 * (abs(v[k]) + r[k]), 0.0)
            want.append((2 + k % 2, int(w[k]), int(w[same & (v >= v[k] - edge) & (v <= v[k] + edge)].sum())))
    for pieces, most in ((1 << 18, 60), (300, 600), (1, 2 * n)):
        got = [tuple(g) for g in information._within(radii, few_values=5, piece_rows=pieces).select("g", "w", "n").collect()]
        assert sorted(got) == sorted(want)
        assert asked.pop() <= most and not asked
