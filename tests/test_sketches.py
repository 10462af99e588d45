"""Profiles merged from the sketches of files."""

import bisect
import statistics

import pytest

from linelens.operators import profile
from linelens.operators import sketches as S

SCHEMA = "id long, v double, kind string, const int, gone double"


def _rows(n, start=0):
    kinds = ["red", "blue", None, "7", "green"]
    return [(start + k, 1e9 + (k * 7919 % 1009) if k % 11 else float("nan"), kinds[(k * k) % 5], 4, None) for k in range(n)]


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "rows"), str(tmp_path / "sketches")


def _add(spark, rows, folder, files):
    spark.createDataFrame(rows, SCHEMA).repartition(files, "id").write.mode("append").parquet(folder)


def _merged(spark, place):
    return {r.column: r for r in S.merge(S.current(spark, *place)).collect()}


def test_merged_equals_profile_of_the_union(spark, place):
    a, b = _rows(4000), [(i, v if v != v else v * 3, k, c, g) for i, v, k, c, g in _rows(3000, 4000)]
    _add(spark, a, place[0], 3)
    first = S.refresh(spark, *place)
    _add(spark, b, place[0], 2)
    second = S.refresh(spark, *place)
    assert first and second and not set(first) & set(second) and S.refresh(spark, *place) == []
    got, want = _merged(spark, place), {r.column: r for r in profile.column_stats(spark.createDataFrame(a + b, SCHEMA)).collect()}
    assert set(got) == set(want)
    for c, w in want.items():
        g = got[c]
        assert (g.ordinal, g.dtype, g.rows, g.nonnull, g.nulls, g.min, g.max, g.numeric_text) == (w.ordinal, w.dtype, w.rows, w.nonnull, w.nulls, w.min, w.max, w.numeric_text), c
        for x, y in ((g.mean, w.mean), (g["std"], w["std"])):
            assert x == (None if y is None else pytest.approx(y, rel=1e-9)), c
        assert g.unique == w.unique if g.distinct_exact else abs(g.unique - w.unique) <= 0.05 * w.unique, c
    assert [got[c].distinct_exact for c in ("kind", "const", "gone", "id")] == [True, True, True, False]
    vs = sorted(r[1] for r in a + b if r[1] == r[1])
    for p, x in zip((0.25, 0.5, 0.75), got["v"].quartiles):
        assert bisect.bisect_left(vs, x) / len(vs) - 0.03 <= p <= bisect.bisect_right(vs, x) / len(vs) + 0.03


def test_offsets_do_not_cancel(spark, place):
    rows = [(k, 1e9 + k % 3 + (0.5 if k >= 300 else 0.0), "x", 1, None) for k in range(600)]
    _add(spark, rows[:300], place[0], 1)
    S.refresh(spark, *place)
    _add(spark, rows[300:], place[0], 1)
    S.refresh(spark, *place)
    assert _merged(spark, place)["v"]["std"] == pytest.approx(statistics.stdev(r[1] for r in rows), rel=1e-6)


def test_common_values_are_exact(spark, place):
    rows = _rows(5000)
    _add(spark, rows, place[0], 4)
    S.refresh(spark, *place)
    merged = S.merge(S.current(spark, *place))
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda d: sorted(map(tuple, d.select("column", "value", "n", "rank").collect()))
    assert key(S.common_values(merged)) == key(profile.common_values(profile.value_counts(df)))
    with pytest.raises(ValueError):
        S.common_values(merged, max_unique=S.FEW + 1)


def test_removed_files_and_repeated_refresh(spark, place):
    import pathlib

    _add(spark, _rows(100), place[0], 1)
    (old,) = S.refresh(spark, *place)
    _add(spark, _rows(50, 100), place[0], 1)
    S.refresh(spark, *place)
    spark.read.parquet(place[1]).write.mode("append").parquet(place[1] + "-copy")
    spark.read.parquet(place[1] + "-copy").write.mode("append").parquet(place[1])  # as if two refreshes had run at once
    assert _merged(spark, place)["id"].rows == 150
    pathlib.Path(old.removeprefix("file:")).unlink()
    assert _merged(spark, place)["id"].rows == 50


def test_no_rows(spark, place):
    _add(spark, [], place[0], 1)
    S.refresh(spark, *place)
    assert S.merge(S.current(spark, *place)).count() == 0


def test_roles_from_merged_facts(spark, place):
    _add(spark, _rows(500), place[0], 2)
    S.refresh(spark, *place)
    roles = {r.column: r.role for r in profile.classify_roles(S.merge(S.current(spark, *place))).collect()}
    want = {r.column: r.role for r in profile.classify_roles(profile.column_facts(spark.createDataFrame(_rows(500), SCHEMA))).collect()}
    assert roles == want
