"""Profiling: column statistics, inferred roles, stations, capabilities and module coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelens.functions import fixed
from linelens.functions.expr import beside, is_numeric, literal, present, present_sql, q, quoted, stack_rows, stack_sql

HEAD_ROWS = 256


def _number(df: DataFrame, c: str) -> Column:
    f = df.schema[c]
    return present(q(c)) if is_numeric(f.dataType) else q(c)


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column from a single scan: counts, min, max, mean, sample deviation, numeric text share."""
    aggs, rows = ["count(1) AS _rows"], []
    for i, f in enumerate(df.schema):
        numeric = is_numeric(f.dataType)
        c = present_sql(f.name) if numeric else quoted(f.name)
        aggs.append(f"count({c}) AS n{i}")
        if numeric:
            aggs += [f"min({c}) AS lo{i}", f"max({c}) AS hi{i}", f"avg({c}) AS mu{i}", f"stddev_samp({c}) AS sd{i}"]
        text_column = isinstance(f.dataType, T.StringType)
        if text_column:
            aggs.append(f"count_if(try_cast({c} AS DOUBLE) IS NOT NULL) AS num{i}")
        stat = lambda key: f"{key}{i}" if numeric else "CAST(NULL AS DOUBLE)"
        rows.append({
            "ordinal": f"{i}", "column": literal(f.name), "dtype": literal(f.dataType.simpleString()), "rows": "_rows", "nonnull": f"n{i}", "nulls": f"_rows - n{i}",
            "min": stat("lo"), "max": stat("hi"), "mean": stat("mu"), "std": stat("sd"), "numeric_text": f"num{i}" if text_column else "CAST(NULL AS BIGINT)"})
    return stack_sql(df.selectExpr(*aggs), rows)


def role_facts(df: DataFrame) -> DataFrame:
    """Only what the role rules need: non-null counts and the share of numeric text."""
    aggs, rows = ["count(1) AS _rows"], []
    for i, f in enumerate(df.schema):
        c = present_sql(f.name) if is_numeric(f.dataType) else quoted(f.name)
        text_column = isinstance(f.dataType, T.StringType)
        aggs.append(f"count({c}) AS n{i}")
        if text_column:
            aggs.append(f"count_if(try_cast({c} AS DOUBLE) IS NOT NULL) AS num{i}")
        rows.append({"ordinal": f"{i}", "column": literal(f.name), "dtype": literal(f.dataType.simpleString()), "rows": "_rows", "nonnull": f"n{i}",
                     "numeric_text": f"num{i}" if text_column else "CAST(NULL AS BIGINT)"})
    return stack_sql(df.selectExpr(*aggs), rows)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n) for the non-null values of every column; values as text, numbers as doubles."""
    columns = columns or df.columns
    texts = df.selectExpr(*[
        f"CAST({present_sql(c)} + 0D AS STRING) AS {quoted(c)}" if is_numeric(df.schema[c].dataType) else f"CAST({quoted(c)} AS STRING) AS {quoted(c)}"
        for c in columns])
    long = texts.unpivot([], [quoted(c) for c in columns], "column", "value").where("value is not null")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique"))


def varying(df: DataFrame, columns: list[str]) -> set[str]:
    """Columns with more than one value: min and max differ. One wide aggregate, no shuffle of values."""
    if not columns:
        return set()
    value = lambda c: _number(df, c)
    row = df.agg(*[(F.max(value(c)) > F.min(value(c))).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return {c for i, c in enumerate(columns) if row[f"v{i}"]}


def column_stats(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Facts plus exact distinct counts. The distincts come from one grouped pass, not from an Expand per column."""
    distinct = (counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique")) if counts is not None else distinct_counts(df))
    return column_facts(df).join(F.broadcast(distinct), "column", "left").withColumn(
        "unique", F.coalesce("unique", F.lit(0)))


def common_values(counts: DataFrame, max_unique: int = 50, top: int = 8) -> DataFrame:
    """Most frequent values of the columns with few distinct ones (ties by value)."""
    unique = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique")).where(F.col("unique") <= max_unique)
    # at most max_unique rows per column reach the window
    ranked = counts.join(F.broadcast(unique), "column").withColumn(
        "rank", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("rank") <= top).select("column", "value", "n", "rank")


def samples(df: DataFrame, order_cols: list[str], k: int = 3) -> DataFrame:
    """First k non-null values of each column in the given order.

    The head of the table answers nearly always; a column that is null throughout the head
    is looked up by its own ordered limit.
    """
    spark = df.sparkSession
    columns = df.columns
    texts = [q(c).cast("string").alias(f"_t{i}") for i, c in enumerate(columns)]
    total = df.agg(*[F.count(_number(df, c)).alias(f"_n{i}") for i, c in enumerate(columns)]).first()
    head = df.orderBy(*order_cols).limit(HEAD_ROWS).select(*texts).collect()
    rows = []
    for i, c in enumerate(columns):
        seen = [r[f"_t{i}"] for r in head if r[f"_t{i}"] not in (None, "NaN")][:k]
        if len(seen) < min(k, total[f"_n{i}"]):
            seen = [r[0] for r in df.where(_number(df, c).isNotNull()).orderBy(*order_cols).limit(k).select(texts[i]).collect()]
        rows.append((c, seen))
    return spark.createDataFrame(rows, "column string, samples array<string>")


def _like(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + pattern)


def metric_of(name: Column) -> Column:
    first, *rest = fixed.METRIC_PATTERNS
    out = F.when(_like(name, first[1]), first[0])
    for label, pattern in rest:
        out = out.when(_like(name, pattern), label)
    return out


def station_metric(name: Column) -> tuple[Column, Column]:
    """(station, metric) of a column name such as ``Press 1 Utilization`` or ``c_Cycle3``."""
    metric = metric_of(name)
    low = F.lower(name)
    tokens = F.filter(F.split(name, r"[_\s]+"), lambda t: t != "")
    first = F.when((F.lower(F.get(tokens, F.lit(0))) == "c") & (F.size(tokens) > 1), 1).otherwise(0)
    token, following = F.get(tokens, first), F.get(tokens, first + 1)
    word = F.lower(token)
    stop = (word.isin(fixed.NON_STATION_TOKENS) | word.startswith("sku") | word.startswith("total")
            | word.startswith("part"))
    plain = F.when(~stop, F.when(following.rlike(r"^\d+$"), F.concat_ws("_", token, following)).otherwise(token))
    cycle_no = F.regexp_extract(name, "(?i)" + fixed.COUNTER_CYCLE, 1)
    unit = F.regexp_extract(name, "(?i)" + fixed.COUNTER_UNIT, 1)
    unit_no = F.regexp_extract(name, "(?i)" + fixed.COUNTER_UNIT, 2)
    counter_station = F.when(cycle_no != "", F.concat(F.lit("Cell"), cycle_no)).when(unit != "", F.concat(unit, unit_no))
    is_counter = low.startswith("c_")
    station = F.when(metric.isNull(), None).when(is_counter, counter_station).otherwise(plain)
    kind = F.when(metric.isNull(), None).when(
        is_counter, F.when(cycle_no != "", F.lit("cycle_time")).otherwise("counter")).otherwise(metric)
    return station, kind


def classify_roles(facts: DataFrame, date_like: list[str] | None = None) -> DataFrame:
    """Add role, station and metric to the column facts (first rule that fits decides)."""
    name = F.col("column")
    low = F.lower(F.trim(name))
    dtype = F.col("dtype")
    stored_number = dtype.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    share = F.try_divide(F.col("numeric_text"), F.col("nonnull"))
    numeric = stored_number | ((dtype == "string") & (share >= 0.6))
    station, metric = station_metric(name)
    dated = _like(low, fixed.DATE_NAMES) & (numeric | name.isin(date_like or []))
    role = (
        F.when(F.col("nonnull") == 0, "empty")
        .when(dtype.isin("timestamp", "timestamp_ntz", "date") | low.isin(fixed.TIME_NAMES), "timestamp")
        .when(dated, "timestamp")
        .when(_like(low, fixed.THROUGHPUT_NAMES), "response_candidate")
        .when(metric.isNotNull(), "process_metric")
        .when(_like(low, fixed.QC_RESPONSE_NAMES) & numeric, "response_candidate")
        .when(_like(low, fixed.QC_VOLUME_NAMES) & numeric, "input_factor")
        .when(low.contains("predictor"), "input_factor")
        .when(_like(low, fixed.INPUT_NAMES) & numeric, "input_factor")
        .when(low.contains("response") | low.contains("answer"), "ml_variable")
        .when(_like(low, fixed.IMAGE_NAMES), "image_reference")
        .when(_like(low, fixed.CLASS_NAMES) & numeric, "ml_variable")
        .when(numeric & _like(low, fixed.VALUE_ADDED_TIME), "response_candidate")
        .when(numeric, "numeric")
        .otherwise("categorical"))
    measured = role == "process_metric"
    return facts.select("*", role.alias("role"), F.when(measured, station).alias("station"),
                        F.when(measured, metric).alias("metric"))


def date_like_columns(df: DataFrame, order_cols: list[str]) -> list[str]:
    """Text columns with a date-like name whose values all parse as timestamps: one scan for all of them."""
    import re

    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and re.search(fixed.DATE_NAMES, f.name, re.I)]
    if not names:
        return []
    bad = lambda c: F.count_if(q(c).isNotNull() & F.try_to_timestamp(q(c)).isNull())
    row = df.agg(*[F.struct(F.count(q(c)).alias("n"), bad(c).alias("bad")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[f"c{i}"]["n"] and row[f"c{i}"]["bad"] == 0]


def profile(df: DataFrame, table: str, order_cols: list[str]) -> DataFrame:
    """Metadata DataFrame, one row per column of the table."""
    facts = column_stats(df)
    roles = classify_roles(facts, date_like_columns(df, order_cols))
    return roles.select(F.lit(table).alias("table"), "*")


def table_profile(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows, columns, dtype counts, null cells and rate, constants, exact duplicates."""
    dtype = F.col("dtype")
    base = meta.agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"),
        F.count_if(dtype.rlike("int|float|double|decimal")).alias("numeric_columns"),
        F.count_if(dtype.isin("string", "boolean")).alias("categorical_columns"),
        F.count_if(dtype.rlike("^(timestamp|date)")).alias("datetime_columns"),
        F.sum("nulls").alias("null_cells"),
        F.count_if((F.col("role") != "empty") & (F.col("unique") == 1)).alias("constant_columns"),
        F.count_if(F.col("role") == "empty").alias("empty_columns"))
    cells = F.col("rows") * F.col("columns")
    return beside(base, duplicate_rows(df)).withColumn("null_rate", F.when(cells > 0, F.round(F.col("null_cells") / cells, 4)).otherwise(0.0))


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def station_map(meta: DataFrame) -> DataFrame:
    return meta.where("station is not null and metric is not null").groupBy("station", "metric").agg(
        F.sort_array(F.collect_set("column")).alias("columns"))


def capability_flags(meta: DataFrame) -> DataFrame:
    """Eleven yes/no capabilities of the whole dataset (all tables), each from detected evidence."""
    role, name = F.col("role"), F.col("column")
    tables = meta.groupBy("table").agg(
        F.max("rows").alias("rows"), F.count_if(F.col("dtype").rlike("int|float|double|decimal")).alias("numeric"),
        *[F.coalesce(F.bool_or(role == r), F.lit(False)).alias(r) for r in
          ("image_reference", "process_metric", "input_factor", "response_candidate", "ml_variable", "timestamp")],
        F.bool_or(F.col("station").isNotNull()).alias("stations"),
        F.bool_or(_like(name, fixed.LABEL_NAMES) & (F.col("unique") <= 30)).alias("labels"),
        F.bool_or(_like(name, fixed.QUALITY_NAMES)).alias("quality"))
    every = tables.agg(
        F.sum("rows").alias("total_rows"), F.max("numeric").alias("max_numeric"), F.max_by("table", "rows").alias("primary_table"),
        *[F.bool_or(c).alias(c) for c in ("image_reference", "process_metric", "input_factor", "timestamp", "stations", "labels", "quality")],
        F.bool_or(F.col("response_candidate") | F.col("ml_variable")).alias("responses"))
    enough = F.col("total_rows") >= 100
    return every.select(
        "total_rows", "primary_table",
        F.col("image_reference").alias("has_image_data"), F.col("labels").alias("has_defect_labels"),
        F.col("quality").alias("has_quality_columns"),
        (F.col("process_metric") | F.col("stations")).alias("has_process_data"),
        F.col("stations").alias("has_station_structure"), F.col("input_factor").alias("has_process_inputs"),
        F.col("responses").alias("has_response_variables"), F.col("timestamp").alias("has_time_series"),
        (F.col("input_factor") & F.col("responses") & enough).alias("supports_process_regression"),
        ((F.col("max_numeric") >= 2) & enough).alias("supports_anomaly_detection"),
        F.col("image_reference").alias("supports_vision"))


def module_coverage(flags: DataFrame, station_count: Column, input_count: Column) -> DataFrame:
    """One row per analysis module: status and reason."""
    process, anomaly, images = F.col("has_process_data"), F.col("supports_anomaly_detection"), F.col("has_image_data")
    gate = lambda ok, other="NOT_SUPPORTED": F.when(ok, "SUPPORTED").otherwise(other)
    vision = F.when(images, "SUPPORTED").otherwise("NOT_SUPPORTED")
    no_images = F.when(images, "images or image references are present").otherwise("no image files or image columns in this dataset")
    table = [
        ("data_ingestion", F.lit("SUPPORTED"), F.lit("tables were read, profiled and cleaned")),
        ("process_analysis", gate(process), F.when(process, "process or station columns found").otherwise("no process or station columns found")),
        ("station_analysis", gate(station_count > 0), F.concat(station_count.cast("string"), F.lit(" station(s) found"))),
        ("predictive_modeling", gate(input_count > 0), F.concat(input_count.cast("string"), F.lit(" model input(s) prepared"))),
        ("anomaly_detection", gate(anomaly), F.when(anomaly, "numeric process data for a normal reference").otherwise("needs 2 numeric columns and 100 rows")),
        ("root_cause_analysis", gate(process, "PARTIALLY_SUPPORTED"), F.lit("association analysis; association is not causation")),
        ("vision_inspection", vision, no_images),
        ("visual_localization", vision, no_images),
        ("visual_novelty_detection", vision, no_images),
        ("process_novelty_detection", gate(anomaly), F.when(anomaly, "scored against this dataset's normal rows").otherwise("needs 2 numeric columns and 100 rows")),
        ("economic_analysis", F.lit("REQUIRES_ASSUMPTIONS"), F.lit("costs and prices must be supplied by the user")),
        ("what_if_simulation", F.lit("PARTIALLY_SUPPORTED"), F.lit("process level from the data; money needs user assumptions")),
    ]
    return stack_rows(flags, [{"module": F.lit(m), "status": s, "reason": r} for m, s, r in table])


def empty_guard(df: DataFrame, table: str) -> DataFrame:
    """A typed status row: EMPTY_TABLE without columns, EMPTY_DATASET without rows, else READY."""
    spark = df.sparkSession
    if not df.columns:
        code = "EMPTY_TABLE"
    else:
        code = "EMPTY_DATASET" if df.isEmpty() else "READY"
    return spark.createDataFrame([(table, code)], "table string, status string")


@dataclass
class Meta:
    """Collected column metadata (one entry per column of the table, so bounded by its width)."""

    rows: list

    @classmethod
    def of(cls, meta: DataFrame) -> "Meta":
        return cls(sorted(meta.collect(), key=lambda r: r["ordinal"]))

    def role(self, *roles: str) -> list[str]:
        return [r["column"] for r in self.rows if r["role"] in roles]

    def metric(self, metric: str) -> list[str]:
        return [r["column"] for r in self.rows if r["station"] and r["metric"] == metric]

    def stations(self) -> dict[str, dict[str, list[str]]]:
        out: dict[str, dict[str, list[str]]] = {}
        for r in self.rows:
            if r["station"] and r["metric"]:
                out.setdefault(r["station"], {}).setdefault(r["metric"], []).append(r["column"])
        return out

    def get(self, column: str):
        return next((r for r in self.rows if r["column"] == column), None)
