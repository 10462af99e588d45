"""Intermediate tables and the shuffle files behind them."""

import time

from pyspark.sql import functions as F

from linelens.session import materialize


def _shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_a_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffled(spark), spark.conf.get(key, None)
    rows = spark.range(5000).select((F.col("id") % 700).alias("k"), "id").repartition(5, "k").groupBy("k").agg(F.count("id").alias("n"))
    kept = materialize(rows)
    for _ in range(50):
        if not _shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffled(spark) - before
    assert spark.conf.get(key, None) == setting
    assert kept.agg(F.sum("n")).first()[0] == rows.agg(F.sum("n")).first()[0] == 5000


def test_a_kept_frame_is_still_there(spark):
    held = spark.range(3000).select((F.col("id") % 70).alias("k")).groupBy("k").agg(F.count("k").alias("n")).persist()
    try:
        materialize(held)
        assert held.agg(F.sum("n")).first()[0] == materialize(held.repartition(3, "n")).agg(F.sum("n")).first()[0] == 3000
    finally:
        held.unpersist()
