"""Profiling, cleaning, features, station metrics, alignment and splits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import finite, q, row_mean, row_spread, row_sum
from linelens.operators import align, clean, features, profile, sketches, split
from linelens.operators.ordered import rolling_mean, with_row_index
from linelens.plans.catalog.base import (
    DIRTY_COLUMNS, H, HOURLY_COLUMNS, O, ORDER_COLUMNS, X, dirty, hourly, meta_of, orders, query, r, sql_metric, union_all)
from linelens.session import materialize, shared_dir
from linelens.sources import views as V

NUMERIC_H = ["Time_Now", "Demand"] + V.HOURLY_METRICS + ["throughput_units"]


# --- profiling

def _stats_sql(cte: str, t: str, columns: list[str], text: set[str]) -> str:
    parts = []
    for c in columns:
        numbers = "NULL, NULL, NULL, NULL" if c in text else f"min({c})::DOUBLE, max({c})::DOUBLE, avg({c}), stddev_samp({c})"
        parts.append(f"SELECT '{c}', count(*) - count({c}), count(DISTINCT {c}), {numbers} FROM {t}")
    body = union_all(parts)
    return (f"{cte} SELECT c AS \"column\", nulls, uniq AS \"unique\", {r('lo')} AS \"min\", {r('hi')} AS \"max\", {r('mu')} AS mean, {r('sd')} AS std "
            f"FROM ({body}) s(c, nulls, uniq, lo, hi, mu, sd)")


@query("p1_column_stats", _stats_sql(H, "h", HOURLY_COLUMNS, {"hour_ts"}))
def p1(spark, sf):
    return profile.column_stats(hourly(spark, sf)).select("column", "nulls", "unique", "min", "max", "mean", "std")


@query("p1_column_stats_orders", _stats_sql(O, "o", ORDER_COLUMNS, set()).replace(", 4)", ", 2)"), digits=2)
def p1_orders(spark, sf):
    return profile.column_stats(orders(spark, sf)).select("column", "nulls", "unique", "min", "max", "mean", "std")


_METRIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}', 'i') THEN '{m}'" for m, p in fixed.METRIC_PATTERNS) + " END"
_STOP = "(" + ", ".join(f"'{w}'" for w in fixed.NON_STATION_TOKENS) + ")"
_NAMES_X = "(VALUES " + ", ".join(f"('{c}')" for c in DIRTY_COLUMNS) + ") n(c)"
_ROLE_SQL = f"""
CASE WHEN nonnull = 0 THEN 'empty'
     WHEN kind = 'time' OR lower(c) IN ('time_now', 'time', 'timestamp', 'datetime') THEN 'timestamp'
     WHEN regexp_matches(c, '{fixed.DATE_NAMES}', 'i') AND num THEN 'timestamp'
     WHEN regexp_matches(c, '{fixed.THROUGHPUT_NAMES}', 'i') THEN 'response_candidate'
     WHEN {_METRIC_SQL} IS NOT NULL THEN 'process_metric'
     WHEN regexp_matches(c, '{fixed.QC_RESPONSE_NAMES}', 'i') AND num THEN 'response_candidate'
     WHEN regexp_matches(c, '{fixed.QC_VOLUME_NAMES}', 'i') AND num THEN 'input_factor'
     WHEN contains(lower(c), 'predictor') THEN 'input_factor'
     WHEN regexp_matches(c, '{fixed.INPUT_NAMES}', 'i') AND num THEN 'input_factor'
     WHEN regexp_matches(c, 'response|answer', 'i') THEN 'ml_variable'
     WHEN regexp_matches(c, '{fixed.IMAGE_NAMES}', 'i') THEN 'image_reference'
     WHEN regexp_matches(c, '{fixed.CLASS_NAMES}', 'i') AND num THEN 'ml_variable'
     WHEN num THEN 'numeric' ELSE 'categorical' END"""


def _facts_x() -> str:
    parts = []
    for c in DIRTY_COLUMNS:
        kind = "time" if c == "hour_ts" else "text" if c == "Demand_text" else "num"
        num = "count(TRY_CAST(Demand_text AS DOUBLE)) >= 0.6 * count(Demand_text)" if c == "Demand_text" else ("false" if c == "hour_ts" else "true")
        parts.append(f"SELECT '{c}', count({c}), '{kind}', {num} FROM x")
    return "(" + union_all(parts) + ") f(c, nonnull, kind, num)"


@query("p2_classify_roles", f"{X} SELECT c AS \"column\", {_ROLE_SQL} AS role FROM {_facts_x()}")
def p2(spark, sf):
    return profile.classify_roles(profile.column_facts(dirty(spark, sf))).select("column", "role")


_PART_NAMES = ["Part 1 VA Time", "Drilling Queue Time", "Press 1 Utilization", "c_Cycle3", "c_cell2", "SKU1_VA Time", "Total parts", "Paint1_Util"]
_TOKENS = "list_filter(regexp_split_to_array(c, '[_\\s]+'), lambda t: t <> '')"
_STATION_SQL = f"""
WITH names AS (SELECT DISTINCT concat(b, ' ', s) AS c FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS b FROM part) a,
  (VALUES ('Util'), ('Queue Time'), ('2 Utilization'), ('Cycle'), ('label')) v(s)
  UNION SELECT DISTINCT concat('c_Cycle', CAST(p_size AS VARCHAR)) FROM part UNION SELECT DISTINCT concat('c_Cell', CAST(p_size AS VARCHAR), ' wip') FROM part
  UNION SELECT DISTINCT concat('Total parts ', split_part(p_type, ' ', 1)) FROM part),
t AS (SELECT c, {_METRIC_SQL} AS m, {_TOKENS} AS tk FROM names),
u AS (SELECT c, m, tk[CASE WHEN lower(tk[1]) = 'c' AND len(tk) > 1 THEN 2 ELSE 1 END] AS w, tk[CASE WHEN lower(tk[1]) = 'c' AND len(tk) > 1 THEN 3 ELSE 2 END] AS nx FROM t)
SELECT c AS "column",
 CASE WHEN m IS NULL THEN NULL WHEN lower(c) LIKE 'c\\_%' ESCAPE '\\' THEN
   CASE WHEN regexp_matches(c, '^c_cycle(\\d+)', 'i') THEN concat('Cell', regexp_extract(c, '^c_cycle(\\d+)', 1, 'i'))
        WHEN regexp_matches(c, '^c_(cell|press|blanking|paint|quality|forklift|warehouse)', 'i')
          THEN concat(regexp_extract(c, '{fixed.COUNTER_UNIT}', 1, 'i'), regexp_extract(c, '{fixed.COUNTER_UNIT}', 2, 'i')) END
  WHEN lower(w) IN {_STOP} OR lower(w) LIKE 'sku%' OR lower(w) LIKE 'total%' OR lower(w) LIKE 'part%' THEN NULL
  WHEN regexp_matches(coalesce(nx, ''), '^\\d+$') THEN concat(w, '_', nx) ELSE w END AS station,
 CASE WHEN m IS NULL THEN NULL WHEN lower(c) LIKE 'c\\_%' ESCAPE '\\' THEN
   CASE WHEN regexp_matches(c, '^c_cycle(\\d+)', 'i') THEN 'cycle_time' ELSE 'counter' END ELSE m END AS metric
FROM u"""


@query("p3_parse_station_metric", _STATION_SQL)
def p3(spark, sf):
    """Column names built from the words of the part table, parsed to station and metric."""
    part = V.table(spark, sf, "part")
    word = F.substring_index("p_type", " ", 1)
    kinds = F.explode(F.array(*[F.lit(s) for s in ("Util", "Queue Time", "2 Utilization", "Cycle", "label")]))
    size = F.col("p_size").cast("string")
    names = (part.select(word.alias("b")).distinct().select("b", kinds.alias("s")).select(F.concat_ws(" ", "b", "s").alias("column"))
             .unionByName(part.select(F.concat(F.lit("c_Cycle"), size).alias("column")))
             .unionByName(part.select(F.concat(F.lit("c_Cell"), size, F.lit(" wip")).alias("column")))
             .unionByName(part.select(F.concat(F.lit("Total parts "), word).alias("column")))).distinct()
    station, metric = profile.station_metric(F.col("column"))
    return names.select("column", station.alias("station"), metric.alias("metric"))


def _common_sql(t_cte: str, t: str, columns: list[str]) -> str:
    parts = [f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for c in columns]
    return f"""{t_cte}, l AS ({union_all(parts)}), g AS (SELECT c, v, count(*) AS n FROM l GROUP BY c, v),
      k AS (SELECT c FROM g GROUP BY c HAVING count(*) <= 50),
      z AS (SELECT c, v, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS rk FROM g JOIN k USING (c))
      SELECT c AS "column", v AS "value", n, CAST(rk AS INTEGER) AS "rank" FROM z WHERE rk <= 8"""


_LINE_COLS = ["l_returnflag", "l_linestatus", "l_shipmode", "l_shipinstruct"]


@query("p4_common_values", _common_sql("WITH li AS (SELECT * FROM lineitem)", "li", ["l_returnflag", "l_linestatus"]))
def p4(spark, sf):
    df = V.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    return profile.common_values(profile.value_counts(df))


_BY_FILE = _stats_sql(O, "o", ORDER_COLUMNS, set()).replace(", 4)", ", 2)").replace('uniq AS "unique"', 'CASE WHEN uniq <= 50 THEN uniq END AS "unique"')


@query("p1_profile_by_file_orders", _BY_FILE, digits=2)
def p1_by_file(spark, sf):
    """Rows that arrive in two batches of files: the second refresh reads the new files only, and the sketches merge."""
    folder = f"{shared_dir(spark)}/profiles/{uuid.uuid4().hex}"
    df = orders(spark, sf, keep=True)
    batch = F.pmod(F.xxhash64("row_key"), F.lit(2))
    for k in range(2):
        df.where(batch == k).write.mode("append").parquet(f"{folder}/rows")
        sketches.refresh(spark, f"{folder}/rows", f"{folder}/sketches")
    merged = sketches.merge(sketches.current(spark, f"{folder}/rows", f"{folder}/sketches"))
    exact = F.when(F.col("distinct_exact") & (F.col("unique") <= 50), F.col("unique"))
    return merged.select("column", "nulls", exact.alias("unique"), "min", "max", "mean", "std")


_FEW_COLS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
_FEW_SQL = "WITH li AS (SELECT l_returnflag, l_linestatus, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FEW_COLS[2:]) + " FROM lineitem)"


@query("p4_common_values_by_file", _common_sql(_FEW_SQL, "li", _FEW_COLS))
def p4_by_file(spark, sf):
    """Exact counts of the values of columns with few of them, from the stored sketches of the table's files."""
    store, path = f"{shared_dir(spark)}/profiles/{uuid.uuid4().hex}", f"{sf}/lineitem.parquet"
    sketches.refresh(spark, path, store)
    merged = sketches.merge(sketches.current(spark, path, store))
    return sketches.common_values(merged.where(F.col("column").isin(_FEW_COLS)))


def _null_cells(columns):
    return " + ".join(f"(count(*) - count({c}))" for c in columns)


@query("p5_table_profile", f"""{X}, d AS (SELECT coalesce(sum(n - 1), 0) AS dup FROM (SELECT count(*) AS n FROM x GROUP BY {', '.join(DIRTY_COLUMNS)})),
  u AS (SELECT count(*) AS k FROM ({union_all([f"SELECT count(DISTINCT {c}) AS u, count({c}) AS n FROM x" for c in DIRTY_COLUMNS])}) q WHERE u = 1 AND n > 0)
  SELECT count(*) AS "rows", CAST({len(DIRTY_COLUMNS)} AS BIGINT) AS "columns", CAST({len(DIRTY_COLUMNS) - 2} AS BIGINT) AS numeric_columns, CAST(1 AS BIGINT) AS categorical_columns,
  CAST(1 AS BIGINT) AS datetime_columns, CAST({_null_cells(DIRTY_COLUMNS)} AS BIGINT) AS null_cells, CAST(any_value(u.k) AS BIGINT) AS constant_columns, CAST(1 AS BIGINT) AS empty_columns,
  CAST(any_value(d.dup) AS BIGINT) AS duplicate_rows, {r(f"round(({_null_cells(DIRTY_COLUMNS)})::DOUBLE / (count(*) * {len(DIRTY_COLUMNS)}), 4)")} AS null_rate FROM x, d, u""")
def p5(spark, sf):
    df = dirty(spark, sf, keep=True)
    return profile.table_profile(df, profile.classify_roles(profile.column_stats(df)))


@query("p6_duplicate_rows", f"{X} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM x GROUP BY {', '.join(DIRTY_COLUMNS)})")
def p6(spark, sf):
    return profile.duplicate_rows(dirty(spark, sf))


def _map_rows(columns):
    return "(VALUES " + ", ".join("('{}', '{}', '{}')".format(*sql_metric(c), c) for c in columns) + ") m(station, metric, c)"


@query("p7_station_map", f"SELECT station, metric, string_agg(c, ', ' ORDER BY c) AS columns FROM {_map_rows(V.ORDER_METRICS)} WHERE (SELECT count(*) FROM lineitem) > 0 GROUP BY station, metric")
def p7(spark, sf):
    meta = profile.classify_roles(profile.role_facts(orders(spark, sf)))
    return profile.station_map(meta).select("station", "metric", F.array_join("columns", ", ").alias("columns"))


@query("p8_capability_flags", f"""WITH h AS ({V.PROCESS_HOURLY}), o AS ({V.PROCESS_ORDERS}), n AS (SELECT (SELECT count(*) FROM h) AS a, (SELECT count(*) FROM o) AS b)
  SELECT CAST(a + b AS BIGINT) AS total_rows, CASE WHEN b >= a THEN 'process_orders' ELSE 'process_hourly' END AS primary_table, false AS has_image_data, false AS has_defect_labels,
  false AS has_quality_columns, true AS has_process_data, true AS has_station_structure, true AS has_process_inputs, true AS has_response_variables, true AS has_time_series,
  a + b >= 100 AS supports_process_regression, a + b >= 100 AS supports_anomaly_detection, false AS supports_vision FROM n""")
def p8(spark, sf):
    return profile.capability_flags(_both_profiles(spark, sf))


def _both_profiles(spark, sf):
    parts = [profile.classify_roles(profile.column_stats(df)).select(F.lit(n).alias("table"), "*")
             for n, df in (("process_hourly", hourly(spark, sf, True)), ("process_orders", orders(spark, sf, True)))]
    return align.union_profiles(parts)


@query("p9_module_coverage", f"""{H}, k AS (SELECT count(*) >= 100 AS big, 'x' AS y FROM h) SELECT status, count(*) AS modules FROM (SELECT unnest([
  'SUPPORTED', 'SUPPORTED', 'SUPPORTED', 'SUPPORTED', CASE WHEN big THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END, 'SUPPORTED', 'NOT_SUPPORTED', 'NOT_SUPPORTED', 'NOT_SUPPORTED',
  CASE WHEN big THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END, 'REQUIRES_ASSUMPTIONS', 'PARTIALLY_SUPPORTED']) AS status FROM k) s GROUP BY status""")
def p9(spark, sf):
    df = hourly(spark, sf, True)
    meta = materialize(profile.classify_roles(profile.column_stats(df)).select(F.lit("process_hourly").alias("table"), "*"))
    m = profile.Meta.of(meta)
    _, summary = align.build_model_input(features.project_features(df, features.plan_features(m)[0]), m, "process_hourly")
    cover = profile.module_coverage(profile.capability_flags(meta), F.lit(len(m.stations())), F.lit(1 if summary["status"] == "READY" else 0))
    return cover.groupBy("status").agg(F.count(F.lit(1)).alias("modules"))


@query("p10_empty_guard", "SELECT t AS \"table\", CASE WHEN n = 0 THEN 'EMPTY_DATASET' ELSE 'READY' END AS status FROM (SELECT 'events' AS t, count(*) AS n FROM events UNION ALL SELECT 'none', count(*) FROM events WHERE value < -1e18) q")
def p10(spark, sf):
    df = V.table(spark, sf, "events")
    return profile.empty_guard(df, "events").unionByName(profile.empty_guard(df.where("value < -1e18"), "none"))


@query("p1_samples", None)
def p1_samples(spark, sf):
    """First three non-null values of each column in time order."""
    return profile.samples(hourly(spark, sf, True), ["Time_Now"]).select("column", F.array_join("samples", " | ").alias("samples"))


# --- cleaning

@query("c1_drop_empty_columns", f"{X} SELECT c AS \"column\" FROM ({union_all([f'SELECT {chr(39)}{c}{chr(39)} AS c, count({c}) AS n FROM x' for c in DIRTY_COLUMNS])}) q WHERE n = 0")
def c1(spark, sf):
    df = dirty(spark, sf)
    return spark.createDataFrame([(c,) for c in clean.empty_columns(df)], "column string")


@query("c2_coerce_numeric", f"{X} SELECT 'Demand_text' AS \"column\", count(*) FILTER (WHERE Demand_text IS NOT NULL AND TRY_CAST(Demand_text AS DOUBLE) IS NULL) AS failed FROM x")
def c2(spark, sf):
    return clean.coerce_numeric(dirty(spark, sf), ["Demand_text"])[1]


@query("c3_dedupe_rows", f"{X} SELECT DISTINCT Time_Now, Demand_text, {r('click_Util')} AS click_Util, {r('click_Queue')} AS click_Queue, {r('throughput_units')} AS throughput_units FROM x")
def c3(spark, sf):
    return clean.dedupe_rows(dirty(spark, sf)).select("Time_Now", "Demand_text", "click_Util", "click_Queue", "throughput_units")


_UTIL_H = [c for c in V.HOURLY_METRICS if c.endswith("_Util")]


@query("c4_percent_to_ratio", f"{X}, d AS (SELECT DISTINCT * FROM x) SELECT * FROM (" + union_all([
    f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", {r(f'avg({c} / 100)')} AS mean FROM d HAVING min({c}) >= 0 AND quantile_cont({c}, 0.5) > 1 AND max({c}) <= 100" for c in _UTIL_H]) + ")")
def c4(spark, sf):
    df = clean.dedupe_rows(dirty(spark, sf, True))
    found = clean.percent_columns(df, _UTIL_H)
    fixed_df = clean.percent_to_ratio(df, found)
    parts = [fixed_df.agg(F.count(F.lit(1)).alias("rows"), F.avg(q(c)).alias("mean")).select(F.lit(c).alias("column"), "rows", "mean") for c in found]
    return align.union_profiles(parts)


_NONNEG = V.HOURLY_METRICS


@query("c5_null_impossible", f"{X}, d AS (SELECT DISTINCT * FROM x) SELECT * FROM (" + union_all(
    [f"SELECT '{c}' AS \"column\", 'negative_value' AS rule, count(*) FILTER (WHERE {c} < 0) AS \"count\" FROM d" for c in _NONNEG]
    + [f"SELECT '{c}', 'utilization_out_of_range', count(*) FILTER (WHERE {c}{' / 100' if c == 'click_Util' else ''} > 1) FROM d" for c in _UTIL_H]) + ") q WHERE \"count\" > 0")
def c5(spark, sf):
    df = clean.dedupe_rows(dirty(spark, sf, True))
    df = clean.percent_to_ratio(df, clean.percent_columns(df, _UTIL_H))
    return clean.impossible_values(df, _NONNEG, _UTIL_H)[1]


@query("c6_flag_extreme", "SELECT * FROM (" + union_all([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE abs({e}) > 1e12) AS beyond FROM lineitem" for c, e in
                                                         (("price_scaled", "l_extendedprice::DOUBLE * 2e7"), ("l_quantity", "l_quantity::DOUBLE"))]) + ") q")
def c6(spark, sf):
    df = V.table(spark, sf, "lineitem").select((F.col("l_extendedprice").cast("double") * 2e7).alias("price_scaled"), F.col("l_quantity").cast("double").alias("l_quantity"))
    return clean.extreme_values(df, df.columns)


@query("c7_constant_columns", f"{X} SELECT c AS \"column\", n AS \"unique\" FROM ({union_all([f'SELECT {chr(39)}{c}{chr(39)} AS c, count(DISTINCT {c}) AS n FROM x' for c in DIRTY_COLUMNS])}) q WHERE n <= 1")
def c7(spark, sf):
    return clean.constant_columns(dirty(spark, sf))


@query("c8_missing_summary", f"{X} SELECT c AS \"column\", n AS missing FROM ({union_all([f'SELECT {chr(39)}{c}{chr(39)} AS c, count(*) - count({c}) AS n FROM x' for c in DIRTY_COLUMNS])}) q WHERE n > 0")
def c8(spark, sf):
    return clean.missing_summary(dirty(spark, sf))


def _clean_sql() -> str:
    kept = [c for c in DIRTY_COLUMNS if c != "empty_col"]
    val = {}
    for c in kept:
        e = c
        if c == "Demand_text":
            e = "TRY_CAST(Demand_text AS DOUBLE)"
        if c == "click_Util":
            e = "click_Util / 100"
        if c in V.HOURLY_METRICS:
            top = f" OR {e} > 1" if c.endswith("_Util") else ""
            e = f"CASE WHEN {e} < 0{top} THEN NULL ELSE {e} END"
        val[c] = e
    miss = [f"SELECT 'missing', '{c}', count(*) - count({val[c]}) FROM d" for c in kept]
    const = [f"SELECT 'constant_column', '{c}', CASE WHEN count(DISTINCT {val[c]}) <= 1 THEN 1 ELSE 0 END FROM d" for c in kept]
    bad = [f"SELECT 'negative_value', '{c}', count(*) FILTER (WHERE {c} < 0) FROM d" for c in V.HOURLY_METRICS]
    over = [f"SELECT 'utilization_out_of_range', '{c}', count(*) FILTER (WHERE {c}{' / 100' if c == 'click_Util' else ''} > 1) FROM d" for c in _UTIL_H]
    fixed_rows = ["SELECT 'empty_column', 'empty_col', 1", "SELECT 'percent_to_ratio', 'click_Util', 1",
                  "SELECT 'coerced_to_null', 'Demand_text', count(*) FILTER (WHERE Demand_text = 'bad') FROM x",
                  "SELECT 'original_rows', NULL, count(*) FROM x", "SELECT 'cleaned_rows', NULL, count(*) FROM d",
                  "SELECT 'duplicate_rows_removed', NULL, (SELECT count(*) FROM x) - count(*) FROM d",
                  f"SELECT 'original_columns', NULL, {len(DIRTY_COLUMNS)}", f"SELECT 'cleaned_columns', NULL, {len(kept)}"]
    return (f"{X}, d AS (SELECT DISTINCT * FROM x) SELECT rule, c AS \"column\", CAST(n AS BIGINT) AS \"count\" FROM ({union_all(miss + const + bad + over + fixed_rows)}) q(rule, c, n) "
            "WHERE n > 0 OR rule IN ('duplicate_rows_removed')")


@query("c9_cleaning_report", _clean_sql())
def c9(spark, sf):
    df = dirty(spark, sf, True)
    return clean.clean_table(df, meta_of(df))[1].select("rule", "column", "count")


# --- features

_U7, _Q7 = [f"Line{n}_Util" for n in range(1, 8)], [f"Line{n}_Queue" for n in range(1, 8)]


def _sum(cols):
    return " + ".join(f"coalesce({c}, 0)" for c in cols)


def _cnt(cols):
    return " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols)


@query("f1_row_mean", f"{O} SELECT row_key, {r(f'({_sum(_U7)}) / nullif({_cnt(_U7)}, 0)')} AS utilization_mean FROM o")
def f1(spark, sf):
    return orders(spark, sf).select("row_key", row_mean([finite(q(c)) for c in _U7]).alias("utilization_mean"))


@query("f2_row_spread", f"{O} SELECT row_key, {r(f'greatest({chr(44).join(_U7)}) - least({chr(44).join(_U7)})')} AS utilization_spread FROM o")
def f2(spark, sf):
    return orders(spark, sf).select("row_key", row_spread([finite(q(c)) for c in _U7]).alias("utilization_spread"))


@query("f3_row_sum_min1", f"{O} SELECT row_key, {r(f'CASE WHEN {_cnt(_Q7)} > 0 THEN {_sum(_Q7)} END')} AS queue_load_total FROM o")
def f3(spark, sf):
    return orders(spark, sf).select("row_key", row_sum([finite(q(c)) for c in _Q7]).alias("queue_load_total"))


@query("f4_base_group_features", f"""{O} SELECT row_key, {r(f'({_sum(_U7)}) / nullif({_cnt(_U7)}, 0)')} AS Line_utilization_mean,
  {r(f'greatest({chr(44).join(_U7)}) - least({chr(44).join(_U7)})')} AS Line_utilization_spread, {r(f'CASE WHEN {_cnt(_Q7)} > 0 THEN {_sum(_Q7)} END')} AS Line_queue_total FROM o""")
def f4(spark, sf):
    """Group features planned from the column metadata alone (Line1..Line7 share a base name)."""
    df = orders(spark, sf)
    derived, _ = features.plan_features(meta_of(df))
    group = [d for d in derived if d["name"].startswith("Line_")]
    return features.project_features(df, group).select("row_key", *[d["name"] for d in group])


_SKU = "SELECT l_orderkey AS row_key, " + ", ".join(
    f"CAST(SUM(CASE WHEN l_linenumber = {n} THEN l_{f} END) AS DOUBLE) AS SKU{n}_{w}_Time" for n in (1, 2) for f, w in (("quantity", "VA"), ("discount", "NVA"), ("tax", "Transport"))) + " FROM lineitem GROUP BY l_orderkey"
_SKU_COLS = {n: [f"SKU{n}_{w}_Time" for w in ("VA", "NVA", "Transport")] for n in (1, 2)}


@query("f5_sku_time_total", f"WITH s AS ({_SKU}) SELECT row_key, " + ", ".join(
    f"{r(f'CASE WHEN {_cnt(_SKU_COLS[n])} > 0 THEN {_sum(_SKU_COLS[n])} END')} AS SKU{n}_time_total" for n in (1, 2)) + " FROM s")
def f5(spark, sf):
    df = V._run(spark, _SKU, sf, "lineitem")
    derived, _ = features.plan_features(meta_of(df))
    sku = [d for d in derived if d["name"].startswith("SKU")]
    return features.project_features(df, sku).select("row_key", *[d["name"] for d in sku])


@query("f6_rolling_mean_20", f"{H} SELECT Time_Now, " + ", ".join(
    f"{r(f'avg({c}) OVER (ORDER BY Time_Now ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 8)} AS {c}_rolling_mean_20" for c in _UTIL_H) + " FROM h", digits=8)
def f6(spark, sf):
    indexed = with_row_index(hourly(spark, sf).select("Time_Now", *_UTIL_H), ["Time_Now"])
    out = {f"{c}_rolling_mean_20": c for c in _UTIL_H}
    return rolling_mean(indexed, out, 20).select("Time_Now", *out)


@query("f7_monotonic_order_check", f"""WITH e AS (SELECT event_id, ts, value FROM events), l AS (SELECT ts < lag(ts) OVER (ORDER BY event_id) AS a, value < lag(value) OVER (ORDER BY event_id) AS b FROM e)
  SELECT 'ts' AS "column", count(*) FILTER (WHERE a) AS violations FROM l UNION ALL SELECT 'value', count(*) FILTER (WHERE b) FROM l""")
def f7(spark, sf):
    df = V.table(spark, sf, "events").select("event_id", "ts", "value")
    return align.union_profiles([features.order_check(df, c, "event_id").select(F.lit(c).alias("column"), "violations") for c in ("ts", "value")])


@query("f8_feature_lineage", None)
def f8(spark, sf):
    df = hourly(spark, sf, True)
    return features.build_features(df, meta_of(df), "process_hourly", "Time_Now")[1]


# --- station metrics

def _metric_sql(cte, t, columns):
    parts = []
    for c in columns:
        s, m = sql_metric(c)
        parts.append(f"SELECT '{s}', '{m}', {c} FROM {t} WHERE {c} IS NOT NULL")
    return f"{cte}, l AS (SELECT * FROM ({union_all(parts)}) q(station, metric, v))"


@query("a1_station_metrics", _metric_sql(H, "h", V.HOURLY_METRICS) + f" SELECT station, metric, {r('avg(v)')} AS mean, {r('max(v)')} AS \"max\", {r('min(v)')} AS \"min\", {r('stddev_pop(v)')} AS std_pop, count(*) AS samples FROM l GROUP BY station, metric")
def a1(spark, sf):
    df = hourly(spark, sf)
    return features.station_metrics(df, meta_of(df))


@query("a1_station_metrics_orders", _metric_sql(O, "o", V.ORDER_METRICS) + f" SELECT station, metric, {r('avg(v)')} AS mean, {r('max(v)')} AS \"max\", {r('min(v)')} AS \"min\", {r('stddev_pop(v)')} AS std_pop, count(*) AS samples FROM l GROUP BY station, metric")
def a1_orders(spark, sf):
    """From the column profile: one scan of the order table."""
    return features.station_metrics_from_profile(profile.classify_roles(profile.column_facts(orders(spark, sf))))


_LEVELS = """WITH l AS (SELECT l_returnflag AS "table", l_linenumber AS station, metric, v FROM (SELECT l_returnflag, l_linenumber, 'quantity' AS metric, CAST(l_quantity AS DOUBLE) AS v FROM lineitem
  UNION ALL SELECT l_returnflag, l_linenumber, 'price', CAST(l_extendedprice AS DOUBLE) FROM lineitem UNION ALL SELECT l_returnflag, l_linenumber, 'discount', CAST(l_discount AS DOUBLE) FROM lineitem) z)"""


# the operator reports 6 digits
@query("a1_metric_levels", f"""{_LEVELS} SELECT "table", station, metric, CAST(grouping("table") * 4 + grouping(station) * 2 + grouping(metric) AS INTEGER) AS level, count(*) AS samples, {r('round(avg(v), 6)')} AS mean, {r('min(v)')} AS "min", {r('max(v)')} AS "max", {r('round(stddev_pop(v), 6)', 3)} AS std_pop
  FROM l GROUP BY GROUPING SETS (("table", station, metric), (station, metric), (metric), ("table", metric), ())""")
def a1_levels(spark, sf):
    """Every order line as a sample of three metrics; station, table, metric and total levels from one pass."""
    lines = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("table"), F.col("l_linenumber").alias("station"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v")) for m, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"))])).alias("s"))
    out = features.metric_levels(lines.select("table", "station", "s.*"), ["table", "station", "metric"], "v",
                                 [["table", "station", "metric"], ["station", "metric"], ["metric"], ["table", "metric"], []])
    return out.withColumn("std_pop", F.round("std_pop", 3))


@query("a2_output_stats", f"{H} SELECT 'throughput_units' AS \"column\", {r('avg(throughput_units)')} AS mean, {r('max(throughput_units)')} AS \"max\", {r('min(throughput_units)')} AS \"min\", count(throughput_units) AS samples FROM h")
def a2(spark, sf):
    df = hourly(spark, sf)
    return features.output_stats(df, meta_of(df))


@query("a3_metric_coverage", _metric_sql(O, "o", V.ORDER_METRICS) + """, s AS (SELECT station, count(DISTINCT metric) AS k, bool_or(metric = 'cycle_time') AS c FROM l GROUP BY station)
  SELECT station, k AS available_metrics, CAST(7 AS INTEGER) AS tracked_metrics, round(k / 7.0, 3)::DOUBLE AS fraction, 'wip, cycle time, throughput' AS missing FROM s""")
def a3(spark, sf):
    df = orders(spark, sf, True)
    m = meta_of(df)
    return features.metric_coverage(features.station_metrics(df, m), sorted(m.stations()))


@query("a4_station_metrics_all_tables", f"""WITH h AS ({V.PROCESS_HOURLY}), o AS ({V.PROCESS_ORDERS}), l AS (SELECT * FROM ({union_all(
    [f"SELECT 'process_hourly', CAST(0 AS INTEGER), '{sql_metric(c)[0]}', '{sql_metric(c)[1]}', {c} FROM h WHERE {c} IS NOT NULL" for c in V.HOURLY_METRICS]
    + [f"SELECT 'process_orders', 1, '{sql_metric(c)[0]}', '{sql_metric(c)[1]}', {c} FROM o WHERE {c} IS NOT NULL" for c in V.ORDER_METRICS])}) q(t, p, station, metric, v))
  SELECT t AS "table", p AS priority, station, metric, {r('avg(v)')} AS mean, count(*) AS samples FROM l GROUP BY t, p, station, metric""")
def a4(spark, sf):
    tables = {n: (df, meta_of(df)) for n, df in (("process_hourly", hourly(spark, sf, True)), ("process_orders", orders(spark, sf, True)))}
    return features.station_metrics_tables(tables, "process_hourly").select("table", "priority", "station", "metric", "mean", "samples")


_STATE = "CASE WHEN value > 150 THEN 'ANOMALOUS' ELSE 'NORMAL' END"


@query("a5_anomaly_rate", f"SELECT event_type AS model, count(*) AS \"rows\", count(*) FILTER (WHERE {_STATE} = 'ANOMALOUS') AS anomalous_rows, {r(f'count(*) FILTER (WHERE {_STATE} = {chr(39)}ANOMALOUS{chr(39)})::DOUBLE / count(*)')} AS anomaly_rate FROM events GROUP BY event_type")
def a5(spark, sf):
    scored = V.table(spark, sf, "events").select(F.col("event_type").alias("model"), F.expr(_STATE).alias("anomaly_state"))
    return features.anomaly_rate(scored, "model")


# --- alignment and model inputs

@query("j1_align_tables", f"""{H}, c AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice FROM orders), d AS (SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS i, o_custkey FROM orders)
  SELECT c.i AS row_index, {r('c.o_totalprice', 2)} AS Model1Predictors, d.o_custkey AS Model1Answer_0 FROM c JOIN d USING (i)""", digits=4)
def j1(spark, sf):
    """Two variables of one model family, stored in tables of equal length and fused by position."""
    o = V.table(spark, sf, "orders")
    tables = {"Model1Predictors": (o.select("o_orderkey", F.round(F.col("o_totalprice").cast("double"), 2).alias("Model1Predictors")), ["o_orderkey"]),
              "Model1Answer_0": (o.select("o_custkey", "o_orderkey", F.col("o_custkey").alias("Model1Answer_0")), ["o_custkey", "o_orderkey"])}
    groups = align.alignment_groups({n: ("orders", df.count()) for n, (df, _) in tables.items()})
    return align.align_tables([tables[n] for n in sorted(next(iter(groups.values())), reverse=True)])


_PRED = ["Demand", "utilization_mean", "utilization_spread", "queue_load_total"]


def _model_input(spark, sf):
    df = hourly(spark, sf, True)
    m = meta_of(df, exact=True)
    return align.build_model_input(features.project_features(df, features.plan_features(m)[0]), m, "process_hourly", keep=["Time_Now"])


_HU, _HQ = [c for c in V.HOURLY_METRICS if c.endswith("_Util")], [c for c in V.HOURLY_METRICS if c.endswith("_Queue")]


@query("j2_build_model_input", f"""{H} SELECT Time_Now, CAST(Demand AS DOUBLE) AS Demand, {r(f'({_sum(_HU)}) / ({_cnt(_HU)})')} AS utilization_mean,
  {r(f'greatest({chr(44).join(_HU)}) - least({chr(44).join(_HU)})')} AS utilization_spread, {r(_sum(_HQ))} AS queue_load_total, {r('throughput_units')} AS throughput_units FROM h WHERE throughput_units IS NOT NULL""")
def j2(spark, sf):
    return _model_input(spark, sf)[0].select("Time_Now", *_PRED, "throughput_units")


@query("j3_complete_response_rows", f"{H} SELECT Time_Now, {r('click_Cycle', 6)} AS click_Cycle, {r('view_Cycle', 6)} AS view_Cycle FROM h WHERE click_Cycle IS NOT NULL AND view_Cycle IS NOT NULL", digits=6)
def j3(spark, sf):
    return align.complete_response_rows(hourly(spark, sf).select("Time_Now", "click_Cycle", "view_Cycle"), ["click_Cycle", "view_Cycle"])


_CYC = [c for c in V.HOURLY_METRICS if c.endswith("_Cycle")]


@query("j4_impute_median", f"{H} SELECT Time_Now, " + ", ".join(f"{r(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM h))', 6)} AS {c}" for c in _CYC) + " FROM h", digits=6)
def j4(spark, sf):
    return align.impute_median(hourly(spark, sf, True).select("Time_Now", *_CYC), _CYC)[0]


@query("j4_imputed_cells_orders", f"{O} SELECT * FROM (" + union_all([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS filled, {r(f'quantile_cont({c}, 0.5)')} AS median FROM o" for c in _Q7]) + ") q WHERE filled > 0")
def j4_orders(spark, sf):
    """Filled cells and the exact median behind them, on the sparse order table."""
    gaps = align.gap_medians(orders(spark, sf, True), _Q7)
    return spark.createDataFrame([(c, n, median) for c, (n, median) in gaps.items()], "column string, filled long, median double")


@query("j5_finite_invariant", f"{H} SELECT CAST({' + '.join(f'(count(*) - count({c}))' for c in _CYC + _HU)} AS BIGINT) AS not_finite FROM h")
def j5(spark, sf):
    return align.finite_check(hourly(spark, sf), _CYC + _HU)


@query("j5_rejected_inputs", f"""WITH h AS ({V.PROCESS_HOURLY}), o AS ({V.PROCESS_ORDERS})
  SELECT name, CASE WHEN n >= 10 AND ok THEN 'READY' WHEN NOT ok THEN 'NOT_SUPPORTED' ELSE 'INSUFFICIENT_DATA' END AS status, n AS "rows", CAST(rank() OVER (ORDER BY n DESC, name) AS INTEGER) AS position
  FROM (SELECT 'process_hourly' AS name, count(throughput_units) AS n, true AS ok FROM h UNION ALL SELECT 'process_orders', count(throughput_units), true FROM o) q""")
def j5_rejected(spark, sf):
    rows = []
    for n, df in (("process_hourly", hourly(spark, sf, True)), ("process_orders", orders(spark, sf, True))):
        m = meta_of(df, exact=True)
        s = align.build_model_input(features.project_features(df, features.plan_features(m)[0]), m, n)[1]
        rows.append((s["name"], s["status"], s["rows"]))
    ledger = spark.createDataFrame(rows, "name string, status string, rows long")
    return align.rank_inputs(ledger)


@query("j6_attribute_station", f"SELECT c AS factor, station FROM (SELECT * FROM {_map_rows(V.HOURLY_METRICS)} UNION ALL SELECT NULL, NULL, 'Demand') z WHERE (SELECT count(*) FROM events) > 0")
def j6(spark, sf):
    meta = profile.classify_roles(profile.column_facts(hourly(spark, sf)))
    found = meta.where(F.col("role").isin("process_metric", "input_factor")).select(F.col("column").alias("factor"))
    return align.attach_columns(found, meta)


@query("j12_union_column_profiles", f"SELECT 'process_hourly' AS \"table\", count(*) AS \"columns\" FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in HOURLY_COLUMNS)}) v UNION ALL SELECT 'process_orders', count(*) FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in ORDER_COLUMNS)}) v WHERE (SELECT count(*) FROM events) > 0")
def j12(spark, sf):
    parts = [profile.column_facts(df).select(F.lit(n).alias("table"), "*") for n, df in (("process_hourly", hourly(spark, sf)), ("process_orders", orders(spark, sf)))]
    return align.union_profiles(parts).groupBy("table").agg(F.count(F.lit(1)).alias("columns"))


@query("j11_asof_link", f"""WITH p AS (SELECT event_type, ts, value FROM events WHERE value > 60)
  SELECT i.event_id, CASE WHEN epoch_us(i.ts) - epoch_us(p.ts) <= 3600000000 THEN {r('p.value')} END AS process_value,
    CASE WHEN epoch_us(i.ts) - epoch_us(p.ts) <= 3600000000 THEN 'LINKED' ELSE 'NOT_AVAILABLE' END AS link_status
  FROM events i ASOF LEFT JOIN p ON p.event_type = i.event_type AND i.ts >= p.ts""")
def j11(spark, sf):
    """Inspection events take the latest process reading of their station within an hour."""
    ev = V.table(spark, sf, "events")
    process = ev.where("value > 60").select("event_type", F.col("ts").alias("read_at"), "value")
    out = align.asof_link(ev.select("event_id", "event_type", "ts"), process, "event_type", "ts", "read_at", 3600)
    return out.select("event_id", "process_value", "link_status")


@query("j11_interval_link", f"""WITH p AS (SELECT event_type, CASE WHEN event_id % 997 <> 0 THEN ts END AS valid_from, CASE WHEN event_id % 1009 <> 0 THEN ts + to_seconds(CAST(floor(value * 30) AS BIGINT)) END AS valid_to, value FROM events WHERE value > 60),
  m AS (SELECT i.event_id, count(*) AS states, arg_max(p.value, (coalesce(epoch_us(p.valid_from), -9e18::BIGINT), coalesce(epoch_us(p.valid_to), 9e18::BIGINT), p.value)) AS v
    FROM events i JOIN p ON p.event_type = i.event_type AND (p.valid_from IS NULL OR i.ts >= p.valid_from) AND (p.valid_to IS NULL OR i.ts < p.valid_to) GROUP BY i.event_id)
  SELECT e.event_id, coalesce(m.states, 0) AS states, {r('m.v')} AS process_value, CASE WHEN m.states IS NULL THEN 'NOT_AVAILABLE' ELSE 'LINKED' END AS link_status FROM events e LEFT JOIN m ON m.event_id = e.event_id""")
def j11_interval(spark, sf):
    """Inspection events take the state of their station that is valid at their instant, some states open at one end."""
    ev = V.table(spark, sf, "events")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 30).cast("long") * 1_000_000)
    state = ev.where("value > 60").select("event_type", F.when(F.col("event_id") % 997 != 0, F.col("ts").cast("timestamp")).alias("valid_from"),
                                          F.when(F.col("event_id") % 1009 != 0, end).alias("valid_to"), "value")
    out = align.interval_link(ev.select("event_id", "event_type", "ts"), state, "event_type", "event_id", "ts", "valid_from", "valid_to", unit_seconds=600)
    return out.select("event_id", "states", "process_value", "link_status")


@query("j11_link_by_key", f"SELECT e.event_id, {r('c.c_acctbal')} AS c_acctbal, CASE WHEN c.c_custkey IS NULL THEN 'NOT_AVAILABLE' ELSE 'LINKED' END AS link_status FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def j11_key(spark, sf):
    ev = V.table(spark, sf, "events").select("event_id", F.col("user_id").alias("unit_id"))
    process = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return align.link_process(ev, process, ["unit_id"]).select("event_id", "c_acctbal", "link_status")


@query("j15_incremental_duplicates", """WITH d AS (SELECT doc_id, sha256(text) AS s, doc_id % 3 = 0 AS arriving FROM documents), k AS (SELECT DISTINCT s FROM d WHERE NOT arriving),
  f AS (SELECT s, min(doc_id) AS first FROM d WHERE arriving GROUP BY s)
  SELECT d.doc_id, (k.s IS NOT NULL OR d.doc_id <> f.first) AS duplicate FROM d JOIN f USING (s) LEFT JOIN k USING (s) WHERE d.arriving""")
def j15(spark, sf):
    docs = materialize(V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest")))  # texts are read once
    out = align.incremental_duplicates(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0"), "digest", "doc_id")
    return out.select("doc_id", "duplicate")


# --- splits

def _cut(i, n):
    return f"CASE WHEN {i} < floor({n} * 0.7::DOUBLE) THEN 'train' WHEN {i} < floor({n} * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END"


@query("x1_chronological_holdout", f"{H} SELECT Time_Now, {_cut('(row_number() OVER (ORDER BY Time_Now) - 1)', '(SELECT count(*) FROM h)')} AS split FROM h")
def x1(spark, sf):
    return split.compute_split(hourly(spark, sf, True), "Time_Now", ["Demand"], ["Time_Now"])[0].select("Time_Now", "split")


@query("x2_sequential_holdout", f"SELECT event_id, {_cut('(row_number() OVER (ORDER BY event_id) - 1)', '(SELECT count(*) FROM events)')} AS split FROM events")
def x2(spark, sf):
    return split.positional_split(V.table(spark, sf, "events").select("event_id"), ["event_id"])


@query("x3_grouped_holdout", f"""{O}, g AS (SELECT CAST(Demand AS VARCHAR) AS g, count(*) AS n FROM o GROUP BY 1), k AS (SELECT g, n, md5(concat(g, '|42')) AS h FROM g),
  w AS (SELECT g, n, row_number() OVER (ORDER BY h DESC, g DESC) AS last, coalesce(sum(n) OVER (ORDER BY h, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM k),
  s AS (SELECT g, CASE WHEN last = 1 THEN 'test' WHEN last = 2 THEN 'validation' WHEN before < 0.7 * total THEN 'train' WHEN before < 0.85 * total THEN 'validation' ELSE 'test' END AS split FROM w)
  SELECT o.row_key, s.split FROM o JOIN s ON s.g = CAST(o.Demand AS VARCHAR)""")
def x3(spark, sf):
    df = orders(spark, sf, True).select("row_key", "Demand")
    return split.grouped_split(df, "Demand", "row_key", 7).select("row_key", "split")


@query("x4_seeded_random_holdout", f"{O}, k AS (SELECT row_key, row_number() OVER (ORDER BY md5(concat(CAST(row_key AS VARCHAR), '|42')), row_key) - 1 AS i FROM o) SELECT row_key, {_cut('i', '(SELECT count(*) FROM o)')} AS split FROM k")
def x4(spark, sf):
    return split.random_split(orders(spark, sf).select("row_key"), "row_key")


@query("x5_unsplit_small", f"SELECT n_nationkey, 'unsplit' AS split FROM nation WHERE (SELECT count(*) FROM nation) < 30")
def x5(spark, sf):
    return split.compute_split(V.table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", [], [])[0]


@query("x6_split_meta", f"""{H}, s AS (SELECT {_cut('(row_number() OVER (ORDER BY Time_Now) - 1)', '(SELECT count(*) FROM h)')} AS s FROM h)
  SELECT 'process_hourly' AS name, count(*) AS "rows", 'chronological_holdout' AS strategy, 'Time_Now' AS group_key, count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'validation') AS validation,
  count(*) FILTER (WHERE s = 'test') AS test, 'COMPUTED' AS status FROM s""")
def x6(spark, sf):
    meta = split.compute_split(hourly(spark, sf, True), "Time_Now", ["Demand"], ["Time_Now"], name="process_hourly")[1]
    return meta.select("name", "rows", "strategy", "group_key", "train", "validation", "test", "status")


@query("x7_quantile_bins", f"""{H}, k AS (SELECT Time_Now, row_number() OVER (ORDER BY Demand, Time_Now) AS rk, count(*) OVER () AS n FROM h)
  SELECT Time_Now, CAST(greatest(ceil((rk - 1) * 5 / (n - 1)::DOUBLE), 1) - 1 AS INTEGER) AS bin FROM k""")
def x7(spark, sf):
    return split.quantile_bins(hourly(spark, sf, True).select("Time_Now", "Demand"), "Demand", "Time_Now").select("Time_Now", "bin")


@query("x8_content_group_split", """WITH d AS (SELECT doc_id, lang, sha256(text) AS s FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rk FROM d),
  c AS (SELECT * FROM p), g AS (SELECT lang, s, count(*) AS n, md5(concat(s, '|42')) AS h FROM c GROUP BY lang, s),
  w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY h, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY lang) AS total FROM g)
  SELECT c.doc_id, CASE WHEN w.before < floor(w.total * 4 / 6.0) THEN 'train' WHEN w.before < floor(w.total * 4 / 6.0) + floor(w.total / 6.0) THEN 'validation' ELSE 'test' END AS split FROM c JOIN w USING (lang, s)""")
def x8(spark, sf):
    """Documents by language; equal texts stay together."""
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    return split.content_group_split(docs, "lang", "digest").select("doc_id", "split")
