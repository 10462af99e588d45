"""Process and inspection views over the driver's star-schema tables.

The view text is plain SQL that both Spark and DuckDB accept, so an operator and its
check run on the same input. ``process_hourly`` has one row per calendar hour, which
bounds the row_number window in it. Sums are rounded to 6 digits, so that the order of
addition leaves no trace in the input of an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.functions.expr import doubles

EVENT_STATIONS = ["click", "error", "purchase", "signup", "view"]
D = "CAST({} AS DOUBLE)"


def _hourly_sql() -> str:
    parts = []
    for s in EVENT_STATIONS:
        parts.append(
            f"round(CAST(SUM(CASE WHEN event_type='{s}' THEN 1 ELSE 0 END) AS DOUBLE)/COUNT(*), 6) AS {s}_Util, "
            f"round(SUM(CASE WHEN event_type='{s}' THEN value ELSE CAST(0 AS DOUBLE) END), 6) AS {s}_Queue, "
            f"round(AVG(CASE WHEN event_type='{s}' THEN value END), 6) AS {s}_Cycle")
    return (
        "SELECT CAST(ROW_NUMBER() OVER (ORDER BY hour_ts) - 1 AS BIGINT) AS Time_Now, * FROM ("
        "SELECT date_trunc('hour', ts) AS hour_ts, COUNT(DISTINCT user_id) AS Demand, "
        + ", ".join(parts)
        + ", round(SUM(value), 6) AS throughput_units FROM events GROUP BY date_trunc('hour', ts)) h")


def _orders_sql() -> str:
    parts = []
    for n in range(1, 8):
        parts.append(
            f"CAST(MAX(CASE WHEN l_linenumber={n} THEN l_discount*10 END) AS DOUBLE) AS Line{n}_Util, "
            f"CAST(SUM(CASE WHEN l_linenumber={n} THEN l_quantity END) AS DOUBLE) AS Line{n}_Queue")
    return (
        "SELECT l_orderkey AS row_key, COUNT(*) AS Demand, " + ", ".join(parts)
        + ", round(CAST(SUM(l_extendedprice) AS DOUBLE), 6) AS throughput_units FROM lineitem GROUP BY l_orderkey")


def _dirty_sql(hourly: str) -> str:
    kept = []
    for s in EVENT_STATIONS:
        for m in ("Util", "Queue", "Cycle"):
            name = f"{s}_{m}"
            expr = name
            if name == "click_Util":
                expr = f"{name} * {D.format(100)}"
            if name == "error_Util":
                expr = f"CASE WHEN Time_Now % 60 = 0 THEN {D.format('1.5')} ELSE {name} END"
            if name == "click_Queue":
                expr = f"CASE WHEN Time_Now % 50 = 0 THEN {D.format('-1.0')} ELSE {name} END"
            kept.append(f"{expr} AS {name}")
    body = (
        "SELECT Time_Now, hour_ts, CASE WHEN Time_Now % 37 = 0 THEN 'bad' ELSE CAST(Demand AS VARCHAR(32)) END AS Demand_text, "
        + ", ".join(kept)
        + f", throughput_units, CAST(NULL AS DOUBLE) AS empty_col, CAST(7 AS DOUBLE) AS const_col FROM ({hourly}) p")
    return f"{body} UNION ALL {body} WHERE Time_Now % 40 = 0"


PROCESS_HOURLY = _hourly_sql()
PROCESS_ORDERS = _orders_sql()
PROCESS_DIRTY = _dirty_sql(PROCESS_HOURLY)
HOURLY_METRICS = [f"{s}_{m}" for s in EVENT_STATIONS for m in ("Util", "Queue", "Cycle")]
ORDER_METRICS = [f"Line{n}_{m}" for n in range(1, 8) for m in ("Util", "Queue")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sql: str, sf_dir: str, source: str) -> DataFrame:
    # DataFrame parameters keep the session catalog clean
    return spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))


def process_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, PROCESS_HOURLY, sf_dir, "events")


def process_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, PROCESS_ORDERS, sf_dir, "lineitem")


def process_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, PROCESS_DIRTY, sf_dir, "events")


def inspection_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inspection_id, truth (0 = normal), 10 logits and the embedding as doubles."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("inspection_id"), F.col("label").cast("int").alias("label"),
        F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 20).alias("logits"),
        doubles(F.col("embedding")).alias("embedding"))


INSPECTION_INPUTS = (
    "SELECT vec_id AS inspection_id, CAST(label AS INTEGER) AS label, "
    "list_transform(embedding[1:10], lambda x: x::DOUBLE * 20) AS logits, "
    "list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings")
