"""Append-only registries: latest by id, latest analysis, listings, deterministic ids, inspection records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.functions.expr import q, short_id

INSPECTION_SCHEMA = ("inspection_id long, filename string, decision string, predicted_class string, confidence double, "
                     "anomaly double, novelty double, novelty_status string, generated_at timestamp")


def upsert(existing: DataFrame, arriving: DataFrame, key: str, stamp: str) -> DataFrame:
    """Replace-by-id: the newest row per id. An aggregate, so an id with many versions stays cheap.

    Rows without a stamp are older than any other; among equal stamps the arriving row wins.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(arriving.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return _newest(both, key, stamp, [c for c in both.columns if c != "_new"], F.col("_new"))


def _newest(rows: DataFrame, group: str, stamp: str, cols: list[str], *ties: Column) -> DataFrame:
    whole = F.struct(*[q(c) for c in cols])
    order = F.struct(q(stamp).isNotNull().alias("known"), q(stamp).alias("stamp"), *ties)
    return rows.groupBy(group).agg(F.max_by(whole, order).alias("s")).select("s.*")


def latest(rows: DataFrame, group: str, stamp: str) -> DataFrame:
    """The newest row of each group, rows without a stamp last; a group without rows is simply absent."""
    return _newest(rows, group, stamp, rows.columns)


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(q(key) == F.lit(value))


def list_recent(rows: DataFrame, stamp: str, limit: int, tie: str | None = None) -> DataFrame:
    """Newest first, a bounded listing (TakeOrderedAndProject, no full sort)."""
    return rows.orderBy(F.desc(stamp), *([tie] if tie else [])).limit(limit)


def analysis_id(*parts: Column | str) -> Column:
    return short_id(*parts)


def class_fingerprint(classes: DataFrame, klass: str) -> DataFrame:
    """12-digit id over the sorted (class, count) pairs of a labelled set."""
    counts = classes.groupBy(klass).agg(F.count(F.lit(1)).alias("n"))
    packed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(q(klass).cast("string").alias("c"), "n"))),
                                      lambda s: F.concat(s["c"], F.lit(":"), s["n"].cast("string"))), ";")
    return counts.agg(F.count(F.lit(1)).alias("classes"), F.substring(F.sha2(packed, 256), 1, 12).alias("fingerprint"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_inspections(inspections: DataFrame, path: str) -> None:
    inspections.write.mode("overwrite").json(path)


def scan_inspections(spark: SparkSession, path: str) -> DataFrame:
    """Stored inspection records with an explicit schema; listing and point lookup are ordinary filters on it."""
    return spark.read.schema(INSPECTION_SCHEMA).json(path)
