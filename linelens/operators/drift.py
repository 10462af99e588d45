"""Drift of ordered columns against their own first quarter: EWMA of z, and a CUSUM change point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import finite, is_numeric, q, rounded, stack_rows
from linelens.operators.ordered import ewma, running_sums, with_row_index

SCHEMA = ("column string, rows long, baseline_mean double, baseline_std double, peak_ewma_z double, "
          "peak_position long, change_position long, drift_detected boolean, direction string")


def detect_drift(df: DataFrame, order_cols: list[str], columns: list[str], baseline_frac: float = fixed.DRIFT_BASELINE,
                 block: int = 1000) -> DataFrame:
    """One row per analysable column. Columns with fewer than 500 values or no spread are left out."""
    spark = df.sparkSession
    columns = [c for c in columns if c in df.columns and is_numeric(df.schema[c].dataType)]
    if not order_cols or not columns:
        return spark.createDataFrame([], SCHEMA)
    narrow = df.where(q(order_cols[0]).isNotNull()).select(
        *[q(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], *[finite(q(c)).alias(f"x{i}") for i, c in enumerate(columns)])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        x = F.col(f"x{i}")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), (F.max(x) > F.min(x)).alias(f"v{i}")]
    facts = narrow.agg(*aggs).first()
    live = [i for i in range(len(columns)) if facts[f"n{i}"] >= fixed.DRIFT_MIN_ROWS and facts[f"v{i}"]]
    if not live:
        return spark.createDataFrame([], SCHEMA)
    indexed = with_row_index(narrow, [f"_o{i}" for i in range(len(order_cols))])
    sums = {}
    for i in live:
        sums[f"v{i}"] = F.col(f"x{i}").isNotNull().cast("long")
        sums[f"c{i}"] = F.coalesce(F.col(f"x{i}") - F.lit(facts[f"m{i}"]), F.lit(0.0))
    ran = running_sums(indexed, sums)
    second = []
    for i in live:
        x, base_n = F.col(f"x{i}"), max(int(facts[f"n{i}"] * baseline_frac), 100)
        base = F.when(F.col(f"v{i}") <= base_n, x)
        second += [F.avg(base).alias(f"bm{i}"), F.stddev_pop(base).alias(f"bs{i}"),
                   F.max_by(F.col(f"v{i}") - 1, F.when(x.isNotNull(), F.struct(F.abs(F.col(f"c{i}")), -F.col(f"v{i}")))).alias(f"cp{i}")]
    base = ran.agg(*second).first()
    live = [i for i in live if base[f"bs{i}"] and base[f"bs{i}"] > 0]
    if not live:
        return spark.createDataFrame([], SCHEMA)
    z = {i: (F.col(f"x{i}") - F.lit(base[f"bm{i}"])) / F.lit(base[f"bs{i}"]) for i in live}
    full = [i for i in live if facts[f"n{i}"] == facts["rows"]]
    gaps = [i for i in live if i not in full]
    peaks = []
    peak = lambda y, pos: F.max(F.struct(F.abs(y).alias("peak"), (-pos).alias("neg"), (y > 0).alias("up")))
    if full:  # no gaps: all columns advance together
        smooth = ewma(indexed, {f"e{i}": z[i] for i in full}, fixed.EWMA_SPAN, block=block)
        wide = smooth.agg(*[peak(F.col(f"e{i}"), F.col("row_index")).alias(f"s{i}") for i in full])
        peaks.append(stack_rows(wide, [{"k": F.lit(i), "s": F.col(f"s{i}")} for i in full]))
    if gaps:  # gaps are skipped, so each such column keeps its own position
        cells = F.array(*[F.when(F.col(f"x{i}").isNotNull(), F.struct(F.lit(i).alias("k"), (F.col(f"v{i}") - 1).alias("place"), z[i].alias("z"))) for i in gaps])
        long = ran.select(F.explode(cells).alias("s")).where("s is not null").select("s.*")
        smooth = ewma(long, {"e": F.col("z")}, fixed.EWMA_SPAN, index="place", keys=["k"], block=block)
        peaks.append(smooth.groupBy("k").agg(peak(F.col("e"), F.col("place")).alias("s")))
    found = peaks[0] if len(peaks) == 1 else peaks[0].unionByName(peaks[1])
    rows = [(i, columns[i], facts[f"n{i}"], base[f"bm{i}"], base[f"bs{i}"], base[f"cp{i}"]) for i in live]
    known = spark.createDataFrame(rows, "k int, column string, rows long, bm double, bs double, change_position long")
    return known.join(found, "k").select(
        "column", "rows", rounded(F.col("bm")).alias("baseline_mean"), rounded(F.col("bs")).alias("baseline_std"),
        rounded(F.col("s.peak"), 4).alias("peak_ewma_z"), (-F.col("s.neg")).alias("peak_position"), "change_position",
        (F.col("s.peak") >= fixed.DRIFT_Z).alias("drift_detected"),
        F.when(F.col("s.up"), "increase").otherwise("decrease").alias("direction"))


def drift_status(columns: DataFrame, has_order: bool = True) -> DataFrame:
    """One row: status, reason, columns analysed and drifted."""
    row = columns.agg(F.count(F.lit(1)).alias("columns_analyzed"), F.count_if(F.col("drift_detected")).alias("columns_drifted"))
    reason = "no usable ordering column" if not has_order else "no numeric columns with enough ordered variation"
    none = F.col("columns_analyzed") == 0
    return row.select(
        F.when(none, "DRIFT_ANALYSIS_NOT_SUPPORTED").when(F.col("columns_drifted") > 0, "DRIFT_DETECTED").otherwise("NO_SIGNIFICANT_DRIFT_DETECTED").alias("status"),
        F.when(none, reason).alias("reason"), "columns_analyzed", "columns_drifted")
