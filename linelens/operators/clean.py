"""Cleaning: every change to the data is reported as a row of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import finite, is_numeric, literal, present_sql, q, quoted, stack_rows, stack_sql, to_number
from linelens.operators.ordered import exact_quantiles
from linelens.operators.profile import Meta, distinct_counts

EXTREME = 1e12


def empty_columns(df: DataFrame) -> list[str]:
    counts = df.selectExpr(*[f"count({present_sql(f.name) if is_numeric(f.dataType) else quoted(f.name)}) AS c{i}" for i, f in enumerate(df.schema)]).first()
    return [f.name for i, f in enumerate(df.schema) if counts[f"c{i}"] == 0]


def coerce_numeric(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Text to number with null for what does not parse, plus (column, failed) counts."""
    out = df.select(*[to_number(q(c)).alias(c) if c in columns else q(c) for c in df.columns])
    failed = df.agg(*[F.count_if(q(c).isNotNull() & to_number(q(c)).isNull()).alias(f"c{i}") for i, c in enumerate(columns)])
    return out, stack_rows(failed, [{"column": F.lit(c), "failed": F.col(f"c{i}")} for i, c in enumerate(columns)])


def dedupe_rows(df: DataFrame, row_key: str | None = None, aligned: bool = False) -> DataFrame:
    """Exact duplicates out. One-column and row-aligned tables are left alone.

    ``row_key`` names an added row number that is not part of the record: it is ignored in the
    comparison and the first copy (smallest key) stays.
    """
    others = [c for c in df.columns if c != row_key]
    if len(others) < 2 or aligned:
        return df
    if row_key is None:
        return df.dropDuplicates()
    return df.groupBy(*[q(c) for c in others]).agg(F.min(q(row_key)).alias(row_key)).select(*[q(c) for c in df.columns])


def percent_columns(df: DataFrame, utilization: list[str]) -> list[str]:
    """Utilization columns kept in percent: none negative, median above 1, none above 100."""
    if not utilization:
        return []
    stats = df.agg(*[f(finite(q(c))).alias(f"{k}{i}") for i, c in enumerate(utilization) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    candidates = [c for i, c in enumerate(utilization)
                  if stats[f"lo{i}"] is not None and stats[f"lo{i}"] >= 0 and 1 < stats[f"hi{i}"] <= 100]
    if not candidates:
        return []
    medians = exact_quantiles(df, {c: [0.5] for c in candidates})
    return [c for c in candidates if medians[c][0] > 1]


def percent_to_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[(q(c) / 100.0).alias(c) if c in columns else q(c) for c in df.columns])


def impossible_values(df: DataFrame, non_negative: list[str], ratios: list[str]) -> tuple[DataFrame, DataFrame]:
    """Negative values of non-negative metrics and ratios above one become null, with counts per rule."""
    picked = []
    for c in df.columns:
        v = q(c)
        if c in non_negative:
            v = F.when(v < 0, None).otherwise(v)
        if c in ratios:
            v = F.when(v > 1, None).otherwise(v)
        picked.append(v.alias(c))
    rules = [(c, "negative_value", q(c) < 0) for c in non_negative] + [(c, "utilization_out_of_range", q(c) > 1) for c in ratios]
    counts = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(rules)])
    report = stack_rows(counts, [{"column": F.lit(c), "rule": F.lit(rule), "count": F.col(f"c{i}")} for i, (c, rule, _) in enumerate(rules)])
    return df.select(*picked), report.where("count > 0")


def extreme_values(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.abs(q(c)) > EXTREME).alias(f"c{i}") for i, c in enumerate(columns)])
    return stack_rows(counts, [{"column": F.lit(c), "beyond": F.col(f"c{i}")} for i, c in enumerate(columns)])


def constant_columns(df: DataFrame) -> DataFrame:
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return names.join(F.broadcast(distinct_counts(df)), "column", "left").select(
        "column", F.coalesce("unique", F.lit(0)).alias("unique")).where("unique <= 1")


def missing_summary(df: DataFrame) -> DataFrame:
    counts = df.selectExpr("count(1) AS _n", *[
        f"count({present_sql(f.name) if is_numeric(f.dataType) else quoted(f.name)}) AS c{i}" for i, f in enumerate(df.schema)])
    return stack_sql(counts, [{"column": literal(f.name), "missing": f"_n - c{i}"} for i, f in enumerate(df.schema)]).where("missing > 0")


def clean_table(df: DataFrame, meta: Meta, row_key: str | None = None, aligned: bool = False) -> tuple[DataFrame, DataFrame]:
    """All rules in order. Returns the cleaned table and the report (rule, column, count)."""
    spark = df.sparkSession
    if not df.columns or df.isEmpty():
        raise ValueError("EMPTY_TABLE: no rows or columns to clean")
    rows_before = df.count()
    dropped = [c for c in df.columns if meta.get(c) is not None and meta.get(c)["role"] == "empty"]
    work = df.drop(*dropped)
    to_coerce = [c for c in work.columns if meta.get(c)["role"] in fixed.NUMERIC_ROLES and not is_numeric(work.schema[c].dataType)]
    report = spark.createDataFrame([("empty_column", c, 1) for c in dropped], "rule string, column string, count long")
    if to_coerce:
        work, failed = coerce_numeric(work, to_coerce)
        report = report.unionByName(failed.select(F.lit("coerced_to_null").alias("rule"), "column", F.col("failed").alias("count")))
    work = dedupe_rows(work, row_key, aligned)
    deduped = work.count()
    ratios = [c for c in meta.metric("utilization") if c in work.columns]
    percent = percent_columns(work, ratios)
    work = percent_to_ratio(work, percent)
    non_negative = [r["column"] for r in meta.rows if r["metric"] in fixed.NON_NEGATIVE_METRICS and r["column"] in work.columns]
    if non_negative:
        work, nulled = impossible_values(work, non_negative, ratios)
        report = report.unionByName(nulled.select("rule", "column", "count"))
    numeric = [c for c in work.columns if is_numeric(work.schema[c].dataType)]
    report = report.unionByName(extreme_values(work, numeric).where("beyond > 0").select(
        F.lit("beyond_1e12").alias("rule"), "column", F.col("beyond").alias("count")))
    report = report.unionByName(constant_columns(work).select(F.lit("constant_column").alias("rule"), "column", F.lit(1).cast("long").alias("count")))
    report = report.unionByName(missing_summary(work).select(F.lit("missing").alias("rule"), "column", F.col("missing").alias("count")))
    if deduped > rows_before:
        raise ValueError("ROW_COUNT_INVARIANT: cleaning must never add rows")
    totals = [("original_rows", None, rows_before), ("cleaned_rows", None, deduped), ("duplicate_rows_removed", None, rows_before - deduped),
              ("original_columns", None, len(df.columns)), ("cleaned_columns", None, len(work.columns))]
    totals += [("percent_to_ratio", c, 1) for c in percent]
    return work, report.unionByName(spark.createDataFrame(totals, "rule string, column string, count long"))
