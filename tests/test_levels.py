"""Several levels of one pass, and set comparison."""

import statistics

import pytest

from linelens.operators import features, flow


def test_levels_with_nulls_and_large_values(spark):
    rows = [(["a", "b", None][k % 3], ["u", "w"][k % 2], 1e9 + k % 7 if k % 5 else None) for k in range(300)] + [("a", "u", float("nan")), ("z", "u", None)]
    got = {(r.station, r.metric, r.level): r for r in features.metric_levels(spark.createDataFrame(rows, "station string, metric string, v double"), ["station", "metric"], "v").collect()}
    good = [r for r in rows if r[2] is not None and r[2] == r[2]]
    want = {}
    for s, m, v in good:
        for key in ((s, m, 0), (s, None, 1), (None, m, 2), (None, None, 3)):
            want.setdefault(key, []).append(v)
    assert set(got) == set(want)
    for key, vs in want.items():
        r = got[key]
        assert (r.samples, r.min, r.max) == (len(vs), min(vs), max(vs))
        assert r.mean == pytest.approx(statistics.fmean(vs), abs=1e-5) and r.std_pop == pytest.approx(statistics.pstdev(vs), abs=1e-4)


def test_levels_of_named_sets_and_no_rows(spark):
    df = spark.createDataFrame([("a", "u", 1.0), ("a", "w", 3.0)], "station string, metric string, v double")
    got = {(r.station, r.level): r.mean for r in features.metric_levels(df, ["station", "metric"], "v", [["station"], []]).collect()}
    assert got == {("a", 1): 2.0, (None, 3): 2.0}
    assert features.metric_levels(df.where("false"), ["station", "metric"], "v", [["station"]]).count() == 0


def test_compare_sets(spark):
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "station string")
    got = sorted(((r.station, r.place) for r in flow.compare_sets(make("a", "a", "b", None), make("b", "c", None, "b"), "station").collect()), key=str)
    assert got == sorted([("a", "LEFT"), ("b", "BOTH"), (None, "BOTH"), ("c", "RIGHT")], key=str)
