"""Small helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than blank, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small: at most this many rows each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that columns added beside it cannot clash with their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def from_row(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns packed by ``as_row`` again, some of them replaced."""
    return df.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in columns])
