"""Incremental profile: one sketch row per file and column, stored, and merged into the profile of all files.

A sketch row holds counts, extremes, mean and squared deviations (merged exactly), a HyperLogLog sketch of the values,
a KLL sketch of the numbers and a frequent-items sketch of the values as text. All of them come from one scan grouped by
file with partial aggregation, so what is shuffled is a row a task and file, and no cell is unpivoted. A file that is in the store
under its length and change time is not read again.

Counts of values are exact where a column has few of them: a frequent-items sketch forgets nothing before it holds
TRACKED values, and a column whose distinct estimate is at most FEW is far below that. Such a column has its exact
distinct count and the exact count of each value. Others have an estimate (HyperLogLog of 2^12 registers, relative
standard error 1.6%) and no list. Quantiles are within about 1.7% in rank (KLL, k = 200).

Defined cases: NaN is missing, infinities are values; a column without values has nulls and a distinct count of 0; a file
without rows has no sketch row and is looked at again by the next refresh; a folder without files or rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelens.functions.expr import is_numeric, literal, present_sql, quoted

#: Distinct estimates up to here stand for exactly counted columns; TRACKED is well above, whatever the estimate's error.
FEW = 100
TRACKED = 1024
FILE = ["file", "length", "modified"]
_STAMP = ["_metadata.file_path AS file", "_metadata.file_size AS length", "_metadata.file_modification_time AS modified"]


def file_sketches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per file and column of a table read from files."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    aggs, entries = ["count(1) AS _rows"], []
    for i, f in enumerate(fields):
        numeric, text = is_numeric(f.dataType), isinstance(f.dataType, T.StringType)
        value = f"v{i}"
        shown = f"CAST({value} + 0D AS STRING)" if numeric else f"CAST({value} AS STRING)"
        aggs += [f"count({value}) AS n{i}", f"hll_sketch_agg({shown}) AS hll{i}", f"approx_top_k_accumulate({shown}, {TRACKED}) AS top{i}"]
        if numeric:
            aggs += [f"min({value}) AS lo{i}", f"max({value}) AS hi{i}", f"avg({value}) AS mu{i}", f"var_pop({value}) * count({value}) AS m2{i}", f"kll_sketch_agg_double({value}) AS kll{i}"]
        if text:
            aggs.append(f"count_if(try_cast({value} AS DOUBLE) IS NOT NULL) AS num{i}")
        number = lambda key, kind="DOUBLE": f"{key}{i}" if numeric else f"CAST(NULL AS {kind})"  # noqa: E731, B023
        entries.append(
            f"named_struct('ordinal', {i}, 'column', {literal(f.name)}, 'dtype', {literal(f.dataType.simpleString())}, 'rows', _rows, 'nonnull', n{i}, 'min', {number('lo')}, 'max', {number('hi')}, "
            f"'mean', {number('mu')}, 'm2', {number('m2')}, 'numeric_text', {f'num{i}' if text else 'CAST(NULL AS BIGINT)'}, 'hll', hll{i}, 'kll', {number('kll', 'BINARY')}, 'top', top{i})")
    values = [F.expr(present_sql(f.name) if is_numeric(f.dataType) else quoted(f.name)).alias(f"v{i}") for i, f in enumerate(fields)]
    wide = df.select(*map(F.expr, _STAMP), *values).groupBy(*FILE).agg(*map(F.expr, aggs))
    return wide.selectExpr(*FILE, f"inline(array({', '.join(entries)}))")


def _listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Path, length and change time of the files of a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    return spark.read.parquet(store) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def refresh(spark: SparkSession, folder: str, store: str, pattern: str = "*.parquet") -> list[str]:
    """Sketch the files of a parquet folder that the store does not hold as they are now; their paths.

    The list of new files goes through the driver: it is a listing, as any reader makes one. Rows are appended, so a
    refresh that fails leaves the store as it was, and one that runs twice adds equal rows, which merging takes once.
    """
    listed, known = _listing(spark, folder, pattern), _stored(spark, store)
    new = listed if known is None else listed.join(known.select(*FILE).distinct(), FILE, "left_anti")
    paths = sorted(r["file"] for r in new.select("file").collect())
    if paths:
        file_sketches(spark.read.parquet(*paths)).write.mode("append").parquet(store)
    return paths


def current(spark: SparkSession, folder: str, store: str, pattern: str = "*.parquet") -> DataFrame:
    """Sketch rows of the files that are in the folder now: changed and removed files have none of their old rows."""
    once = spark.read.parquet(store).dropDuplicates([*FILE, "column"])
    return once.join(_listing(spark, folder, pattern), FILE, "left_semi")


def merge(sketches: DataFrame) -> DataFrame:
    """One row per column: the facts that roles and profiles read, ``distinct_exact``, quartiles and the sketches merged."""
    total = F.sum("nonnull")
    weighted = F.sum(F.when(F.col("nonnull") > 0, F.col("mean") * F.col("nonnull")))
    # sum of n (mean - m)^2 by pairs of the same pass: means are centred by the least one, so large offsets cancel nothing
    base = sketches.groupBy("column").agg(F.min("mean").alias("base"))
    near = sketches.join(base, "column")
    off = F.col("mean") - F.col("base")
    between = F.sum(F.col("nonnull") * off * off) - F.try_divide(F.pow(F.sum(F.col("nonnull") * off), 2), F.sum(F.when(F.col("mean").isNotNull(), F.col("nonnull"))))
    spread = F.try_divide(F.sum("m2") + between, total - 1)
    merged = near.groupBy("column").agg(
        F.min("ordinal").alias("ordinal"), F.max("dtype").alias("dtype"), F.sum("rows").alias("rows"), total.alias("nonnull"), (F.sum("rows") - total).alias("nulls"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.try_divide(weighted, total).alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0) * spread)).alias("std"),
        F.sum("numeric_text").alias("numeric_text"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"), F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"))
    estimate = F.hll_sketch_estimate("hll")
    items = F.expr(f"approx_top_k_estimate(top, {TRACKED})")
    few = estimate <= FEW
    counted = merged.withColumn("common", F.when(few & (F.col("nonnull") > 0), F.filter(items, lambda x: x["item"].isNotNull())))
    quartiles = F.when((F.col("nonnull") > 0) & F.col("kll").isNotNull() & F.col("min").isNotNull(), F.kll_sketch_get_quantile_double("kll", F.array(*map(F.lit, (0.25, 0.5, 0.75)))))
    exact = F.when(F.col("nonnull") == 0, F.lit(0)).when(few, F.size("common"))
    return counted.withColumn("unique", F.coalesce(exact, estimate).cast("long")).withColumn("distinct_exact", few).withColumn("quartiles", quartiles)


def common_values(merged: DataFrame, max_unique: int = 50, top: int = 8) -> DataFrame:
    """Most frequent values of the columns with few distinct ones (ties by value), with exact counts; at most FEW."""
    if max_unique > FEW:
        raise ValueError(f"values are counted exactly up to {FEW} distinct ones")
    small = merged.where(F.col("distinct_exact") & (F.col("unique") <= max_unique) & F.col("common").isNotNull())
    # at most max_unique entries in each array
    ranked = F.slice(F.array_sort(F.transform("common", lambda x: F.struct((-x["count"]).alias("low"), x["item"].alias("value")))), 1, top)
    return small.select("column", F.posexplode(ranked).alias("place", "x")).select(
        "column", F.col("x.value").alias("value"), (-F.col("x.low")).alias("n"), (F.col("place") + 1).alias("rank"))
