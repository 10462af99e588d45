"""Registry of runnable queries and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linelens.functions.expr import round_doubles
from linelens.operators.profile import Meta, classify_roles, column_stats, role_facts
from linelens.session import materialize
from linelens.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

H = f"WITH h AS ({V.PROCESS_HOURLY}) "
O = f"WITH o AS ({V.PROCESS_ORDERS}) "
X = f"WITH x AS ({V.PROCESS_DIRTY}) "
I = f"WITH i AS ({V.INSPECTION_INPUTS}) "


def query(name: str, sql: str | None = None, digits: int = 4):
    """Register a query. Doubles are rounded for the comparison only, on both sides."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def r(expr: str, digits: int = 4) -> str:
    """The same rounding in SQL."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def hourly(spark, sf_dir, keep: bool = False):
    df = V.process_hourly(spark, sf_dir)
    return materialize(df) if keep else df


def orders(spark, sf_dir, keep: bool = False):
    df = V.process_orders(spark, sf_dir)
    return materialize(df) if keep else df


def dirty(spark, sf_dir, keep: bool = False):
    df = V.process_dirty(spark, sf_dir)
    return materialize(df) if keep else df


def meta_of(df: DataFrame, exact: bool = False) -> Meta:
    """Roles of a view: from null counts alone, or with exact distinct counts."""
    facts = column_stats(df) if exact else role_facts(df)
    return Meta.of(classify_roles(facts))


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


HOURLY_COLUMNS = ["Time_Now", "hour_ts", "Demand"] + V.HOURLY_METRICS + ["throughput_units"]
ORDER_COLUMNS = ["row_key", "Demand"] + V.ORDER_METRICS + ["throughput_units"]
DIRTY_COLUMNS = ["Time_Now", "hour_ts", "Demand_text"] + V.HOURLY_METRICS + ["throughput_units", "empty_col", "const_col"]


def sql_metric(c: str) -> tuple[str, str]:
    """(station, metric) of the view columns, as the checks spell it out."""
    station, kind = c.rsplit("_", 1)
    return station, {"Util": "utilization", "Queue": "queue_wait", "Cycle": "cycle_time"}[kind]
