"""Ordered scans against plain loops, including the many-block and many-run cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from linelens.operators import ordered


def frame(spark, n, seed=1, nulls=False):
    rnd = random.Random(seed)
    rows = [(i, None if nulls and rnd.random() < 0.2 else float(rnd.randint(0, 40))) for i in range(n)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "k long, x double").repartition(5)


def test_row_index_is_contiguous_and_ordered(spark):
    rows, df = frame(spark, 1000)
    got = {r["k"]: r["row_index"] for r in ordered.with_row_index(df, ["k"]).collect()}
    assert got == {k: k for k, _ in rows}


def test_row_index_with_one_dominant_order_value(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, 7).otherwise(F.col("id")).alias("t"), F.col("id"))
    got = [r["row_index"] for r in ordered.with_row_index(df, ["t", "id"]).orderBy("t", "id").collect()]
    assert got == list(range(900))


def test_running_sums(spark):
    rows, df = frame(spark, 500)
    out = ordered.running_sums(ordered.with_row_index(df, ["k"]), {"s": F.col("x")})
    got = {r["k"]: r["s"] for r in out.collect()}
    total = 0.0
    for k, x in rows:
        total += x
        assert got[k] == pytest.approx(total)


@pytest.mark.parametrize("block", [10, 64, 1000])
def test_ewma_over_block_borders(spark, block):
    rows, df = frame(spark, 700)
    out = ordered.ewma(ordered.with_row_index(df, ["k"]), {"e": F.col("x")}, 200, block=block)
    got = {r["k"]: r["e"] for r in out.collect()}
    a, y = 2 / 201, None
    for k, x in rows:
        y = x if y is None else (1 - a) * y + a * x
        assert got[k] == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("block", [25, 1000])
def test_rolling_mean_over_block_borders(spark, block):
    rows, df = frame(spark, 300, nulls=True)
    out = ordered.rolling_mean(ordered.with_row_index(df, ["k"]), {"m": "x"}, 20, block=block)
    got = {r["k"]: r["m"] for r in out.collect()}
    assert len(got) == 300
    for k, _ in rows:
        part = [x for _, x in rows[max(0, k - 19):k + 1] if x is not None]
        want = sum(part) / len(part) if part else None
        assert got[k] == (pytest.approx(want) if want is not None else None)


def test_average_ranks_with_ties_and_hot_value(spark):
    values = [5.0] * 60 + [float(i) for i in range(40)]
    df = spark.createDataFrame([("f", v) for v in values], "f string, x double")
    ranks = {r["x"]: r["avg_rank"] for r in ordered.average_ranks(df, ["f"], "x").collect()}
    ordered_values = sorted(values)
    for v in set(values):
        places = [i + 1 for i, w in enumerate(ordered_values) if w == v]
        assert ranks[v] == pytest.approx(sum(places) / len(places))


def test_attach_keeps_hot_and_cold_rows(spark):
    df = spark.createDataFrame([("hot",)] * 300 + [(f"c{i}",) for i in range(200)], "k string")
    lookup = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("k"))
    for share in (2, 2000):  # hot by broadcast, or everything by broadcast
        out = ordered.attach(df, lookup, ["k"], hot_share=share)
        assert out.count() == 500 and out.where("v is null").isEmpty()


@pytest.mark.parametrize("q", [0.02, 0.1, 0.25, 0.5, 0.75, 0.999])
def test_exact_quantiles_match_sorting(spark, q):
    rows, df = frame(spark, 997, nulls=True)
    values = sorted(x for _, x in rows if x is not None)
    h = (len(values) - 1) * q
    want = values[int(h)] + (values[min(int(h) + 1, len(values) - 1)] - values[int(h)]) * (h - int(h))
    narrow = ordered.exact_quantiles(df, {"x": [q]})["x"][0]
    wide = ordered.exact_quantiles(df, {"x": [q]}, slack=0.02)["x"][0]
    assert narrow == wide == pytest.approx(want)


def test_exact_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert ordered.exact_quantiles(df, {"a": [0.5], "b": [0.5]}) == {"a": [None], "b": [1.5]}


def test_exact_quantiles_of_many_columns(spark):
    df = spark.range(500).select(*[((F.col("id") * (k + 1)) % 499).cast("double").alias(f"c{k}") for k in range(70)], F.lit(None).cast("double").alias("gap"))
    got = ordered.exact_quantiles(df, {**{f"c{k}": [0.1, 0.5] for k in range(70)}, "gap": [0.5]})
    rows = [r.asDict() for r in df.collect()]
    for k in range(70):
        values = sorted(r[f"c{k}"] for r in rows)
        assert got[f"c{k}"] == [pytest.approx(values[49] + 0.9 * (values[50] - values[49])), pytest.approx((values[249] + values[250]) / 2)]
    assert got["gap"] == [None]


def test_share_below(spark):
    ref = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3, 9)], "c string, d double")
    ask = spark.createDataFrame([(1, "a", 2.0), (2, "a", 0.5), (3, "a", 10.0)], "id int, c string, d double")
    got = {r["id"]: r["s"] for r in ordered.share_below(ask, ref, ["c"], "d", "s").collect()}
    assert got == {1: 0.2, 2: 0.0, 3: 1.0}


def test_counting_edges_takes_a_few_comparisons(spark):
    """Quantile ranges and bins place a value by halving; a column with 15 edges took 15 comparisons a bin and 30 a range."""
    from linelens.functions.expr import count_below

    edges = [0.0, 1.0, 1.0, 2.5, 4.0, 7.0, 7.5]
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.5, 3.0, 7.0, 7.2, 9.0)], "v double")
    for r in rows.select("v", count_below(F.col("v"), edges).alias("a"), count_below(F.col("v"), edges, over=True).alias("b")).collect():
        assert (r.a, r.b) == (sum(e < r.v for e in edges), sum(e <= r.v for e in edges))
    assert rows.select(count_below(F.col("v"), []).alias("a")).distinct().collect()[0].a == 0


def test_brackets_of_one_column_may_touch(spark):
    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") < 40, F.col("id") * 1.0).alias("y"))
    ps = [k / 16 for k in range(17)]
    got = ordered.exact_quantiles(df, {"x": ps, "y": ps}, slack=0.03)
    for c, n in (("x", 300), ("y", 40)):
        values = sorted(i % 7 * 1.0 if c == "x" else i * 1.0 for i in range(n))
        for p, v in zip(ps, got[c]):
            h = (n - 1) * p
            assert v == pytest.approx(values[int(h)] + (values[min(int(h) + 1, n - 1)] - values[int(h)]) * (h - int(h)))
