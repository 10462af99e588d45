"""Exact tail probabilities against tabulated values and numeric integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linelens.functions.tails import correlation_p


def by_integral(r, n):
    """The density of a correlation under independence, (1 - r^2)^((n - 4) / 2), integrated over the tails."""
    log_beta = math.lgamma((n - 2) / 2) + math.lgamma(0.5) - math.lgamma((n - 1) / 2)
    x, w = np.polynomial.legendre.leggauss(400)
    high = min(1.0, abs(r) + 60 / math.sqrt(n))
    at = abs(r) + (x + 1) / 2 * (high - abs(r))
    return float(2 * np.sum(w * np.exp((n - 4) / 2 * np.log1p(-at * at) - log_beta)) * (high - abs(r)) / 2)


def test_correlation_p(spark):
    rows = [(k / math.sqrt(n - 2 + k * k), n) for n in (30, 31, 50, 101, 1000, 10_001, 1_000_000) for k in (0.01, 0.5, 1.0, 1.7, 1.96, 2.4, 2.5, 3.0, 5.0, 9.0)]
    got = spark.createDataFrame(rows, "r double, n long").select("r", "n", correlation_p(F.col("r"), F.col("n")).alias("p"), correlation_p(-F.col("r"), F.col("n")).alias("q")).collect()
    for row in got:
        assert row.p == row.q and row.p == pytest.approx(by_integral(row.r, row.n), abs=1e-9, rel=1e-6)


def test_tabulated_quantiles_of_t(spark):
    # two-sided 5% and 1% points of Student's t for 28, 60 and 120 degrees of freedom
    table = [(28, 2.048407, 0.05), (28, 2.763262, 0.01), (60, 2.000298, 0.05), (60, 2.660283, 0.01), (120, 1.979930, 0.05), (120, 2.617421, 0.01)]
    rows = [(t / math.sqrt(df + t * t), df + 2, p) for df, t, p in table]
    for row in spark.createDataFrame(rows, "r double, n long, want double").select("want", correlation_p(F.col("r"), F.col("n")).alias("p")).collect():
        assert row.p == pytest.approx(row.want, abs=2e-7)


def test_edges(spark):
    rows = [(0.0, 40), (1.0, 40), (-1.0, 40), (None, 40), (0.5, None), (0.5, 2), (0.9999, 10**9)]
    got = [r.p for r in spark.createDataFrame(rows, "r double, n long").select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got[:6] == [1.0, 0.0, 0.0, None, None, None] and got[6] == 0.0
