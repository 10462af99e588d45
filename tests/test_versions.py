"""The versioned registry: rewritten buckets, pinned readers, two writers."""

import os

import pytest
from pyspark.sql import functions as F

from linelens.sources.versions import VersionConflict, VersionedRegistry

SCHEMA = "id string, at int, v string"


def rows_of(df):
    return sorted(((r.id, r.at, r.v) for r in df.collect()), key=str)


def files_of(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    reg = VersionedRegistry(spark, str(tmp_path / "r"), "id", "at", buckets=32)
    assert reg.version() == 0
    first = [(f"k{i}", 1, "old") for i in range(1000)] + [("k1", 0, "older"), (None, 1, "null id")]
    assert reg.upsert(spark.createDataFrame(first, SCHEMA)) == 1
    one, before = reg.manifest(), files_of(tmp_path / "r")
    few = [(f"k{i}", 2, "new") for i in range(0, 1000, 100)] + [("fresh", 2, "new"), ("k5", 0, "too old"), ("k7", 1, "tie"), ("k8", None, "no stamp")]
    assert reg.upsert(spark.createDataFrame(few, SCHEMA)) == 2
    two = reg.manifest()
    changed = {b for b in two["folders"] if two["folders"][b] != one["folders"].get(b)}
    again = {r.b for r in spark.createDataFrame(few, SCHEMA).select(reg._bucket_of(F.col("id"), 32).alias("b")).collect()}
    assert changed == {str(b) for b in again} and len(changed) < 20
    fresh = files_of(tmp_path / "r") - before
    assert before <= files_of(tmp_path / "r") and all(any(f"_bucket={b}/" in f for b in changed) for f in fresh)
    want = {r[0]: r for r in first if r != ("k1", 0, "older")} | {r[0]: r for r in few if r[2] in ("new", "tie")}
    assert rows_of(reg.read()) == sorted(want.values(), key=str)
    assert rows_of(reg.read(1)) == sorted((r for r in first if r != ("k1", 0, "older")), key=str)
    assert rows_of(reg.by_id("k100")) == [("k100", 2, "new")] and rows_of(reg.by_id("k100", 1)) == [("k100", 1, "old")]
    assert rows_of(reg.by_id("none")) == [] and rows_of(reg.by_id(None)) == [(None, 1, "null id")]
    assert len(reg.by_id("k100").inputFiles()) == 1


def test_the_second_of_two_writers_fails_or_tries_again(spark, tmp_path):
    path = str(tmp_path / "r")
    a, b = (VersionedRegistry(spark, path, "id", "at", buckets=4) for _ in range(2))
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    a.upsert(make(("x", 1, "a"), ("y", 1, "a")))
    pinned = b.read()
    a.upsert(make(("x", 2, "a2")), base=1)
    with pytest.raises(VersionConflict):
        b.upsert(make(("y", 2, "b2")), base=1)
    assert rows_of(b.read()) == [("x", 2, "a2"), ("y", 1, "a")] and rows_of(pinned) == [("x", 1, "a"), ("y", 1, "a")]
    assert b.upsert_retrying(make(("y", 2, "b2"))) == 3
    assert rows_of(a.read()) == [("x", 2, "a2"), ("y", 2, "b2")]


def test_new_columns_and_no_rows(spark, tmp_path):
    reg = VersionedRegistry(spark, str(tmp_path / "r"), "id", "at", buckets=8)
    with pytest.raises(ValueError, match="no version"):
        reg.read()
    reg.upsert(spark.createDataFrame([], SCHEMA))
    assert reg.read().count() == 0 and reg.by_id("a").count() == 0
    reg.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], SCHEMA))
    reg.upsert(spark.createDataFrame([("c", 1, "z", 7)], SCHEMA + ", more int"))
    assert {(r.id, r.v, r.more) for r in reg.read().collect()} == {("a", "x", None), ("b", "y", None), ("c", "z", 7)}
