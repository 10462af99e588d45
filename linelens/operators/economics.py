"""Economics from observed throughput and user assumptions; nothing is ever assumed for the user.

All tables are long or one row per (dataset, scenario). A missing input yields NOT_AVAILABLE with
the list of what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import finite, row_sum, rounded, stack_rows

FIELDS = [f for f, *_ in fixed.ASSUMPTION_FIELDS]


def bounds(spark) -> DataFrame:
    return spark.createDataFrame(fixed.ASSUMPTION_FIELDS, "field string, unit string, low double, high double")


def validate_assumptions(updates: DataFrame) -> DataFrame:
    """updates: dataset_id, field, raw (text), at. Adds unit, value, value_text, source, status and reason."""
    b = bounds(updates.sparkSession)
    raw = F.col("raw")
    number = raw.try_cast("double")
    code = F.upper(F.trim(raw))
    currency = F.col("field") == "currency"
    joined = updates.join(F.broadcast(b), "field", "left")
    reason = (
        F.when(~currency & F.col("unit").isNull(), "UNKNOWN_ASSUMPTION")
        .when(raw.isNull(), None)
        .when(currency, F.when((code == "") | (F.length(code) > 8), "INVALID_CURRENCY"))
        .when(number.isNull(), "NOT_NUMERIC")
        .when(finite(number).isNull(), "NOT_FINITE")
        .when(number < F.col("low"), "BELOW_MINIMUM")
        .when(number > F.col("high"), "ABOVE_MAXIMUM"))
    checked = joined.withColumn("reason", reason)
    good = F.col("reason").isNull()
    given = good & raw.isNotNull()
    return checked.select(
        "dataset_id", "field", "raw", "at", F.when(currency, "currency code").otherwise(F.col("unit")).alias("unit"),
        F.when(given & ~currency, number).alias("value"), F.when(given & currency, code).alias("value_text"),
        F.when(given, "USER_ASSUMPTION").otherwise("NOT_PROVIDED").alias("source"),
        F.when(good, "ACCEPTED").otherwise("REJECTED").alias("status"), "reason")


def merge_assumptions(*accepted: DataFrame) -> DataFrame:
    """Latest accepted entry per dataset and field; a null entry clears the field."""
    rows = accepted[0]
    for a in accepted[1:]:
        rows = rows.unionByName(a)
    latest = rows.where("status = 'ACCEPTED'").groupBy("dataset_id", "field").agg(
        F.max_by(F.struct("value", "value_text", "unit", "source", "at"), "at").alias("s"))
    return latest.select("dataset_id", "field", "s.value", "s.value_text", "s.unit", "s.source", F.col("s.at").alias("provided_at"))


def assumption_wide(assumptions: DataFrame) -> DataFrame:
    """One row per dataset with a column for every field."""
    return assumptions.groupBy("dataset_id").agg(
        F.max(F.when(F.col("field") == "currency", F.col("value_text"))).alias("currency"),
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])


def missing_fields(assumptions: DataFrame) -> DataFrame:
    """(dataset_id, field) not supplied, by anti-join against the field list."""
    spark = assumptions.sparkSession
    every = assumptions.select("dataset_id").distinct().select("dataset_id", F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field"))
    return every.join(assumptions.where("value is not null").select("dataset_id", "field"), ["dataset_id", "field"], "left_anti")


def fingerprint(assumptions: DataFrame) -> DataFrame:
    """12-digit id of a dataset's whole assumption set, independent of the order it was given in."""
    wide = assumption_wide(assumptions)
    listed = F.concat_ws(";", *[F.concat_ws("=", F.lit(f), F.col(f).cast("string")) for f in ["currency", *sorted(FIELDS)]])
    return wide.select("dataset_id", F.substring(F.sha2(listed, 256), 1, 12).alias("fingerprint"))


def _missing(*names: str) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names])), ", ")


def baseline_economics(inputs: DataFrame) -> DataFrame:
    """Units and contribution per day and month. ``inputs``: throughput_per_hour plus the wide assumptions."""
    units = F.col("throughput_per_hour") * F.col("working_hours_per_day")
    daily = units * F.col("contribution_margin_per_unit")
    monthly = daily * F.col("working_days_per_month")
    base = ["throughput_per_hour", "contribution_margin_per_unit", "working_hours_per_day", "currency"]
    return inputs.select(
        "*", rounded(units).alias("units_per_day"), rounded(daily).alias("daily_contribution"), rounded(monthly).alias("monthly_contribution"),
        F.when(units.isNull(), _missing(*base)).otherwise("").alias("units_missing"),
        F.when(daily.isNull(), _missing(*base)).otherwise("").alias("daily_missing"),
        F.when(monthly.isNull(), _missing(*base, "working_days_per_month")).otherwise("").alias("monthly_missing"),
        F.when(daily.isNull(), "NOT_AVAILABLE").otherwise("CALCULATED").alias("baseline_status"))


def run_scenarios(scenarios: DataFrame, baseline: DataFrame) -> DataFrame:
    """scenarios: dataset_id, scenario_type, change, scaling_basis. Refused ones keep a status and reason.

    A utilization cut never moves throughput by itself: that relation is confounded by demand.
    """
    rows = scenarios.join(baseline, "dataset_id")  # one baseline row per dataset
    kind, change = F.col("scenario_type"), finite(F.col("change"))
    reason = (
        F.when(~kind.isin("utilization_reduction", "throughput_scaling", "demand_uplift"), "UNSUPPORTED_SCENARIO")
        .when(change.isNull(), "INVALID_SCENARIO: change must be a finite number")
        .when(F.abs(change) > fixed.MAX_SCENARIO_CHANGE, "INVALID_SCENARIO: change beyond 95%")
        .when((kind == "utilization_reduction") & F.col("current_utilization").isNull(), "SCENARIO_NOT_SUPPORTED: no utilization for the candidate")
        .when((kind == "utilization_reduction") & (change <= 0), "INVALID_SCENARIO: utilization_reduction must be above 0")
        .when((kind == "throughput_scaling") & ~F.coalesce(F.col("scaling_basis") == "user_assumption", F.lit(False)), "SCENARIO_NOT_SUPPORTED: needs scaling_basis = user_assumption")
        .when((kind == "throughput_scaling") & F.col("throughput_per_hour").isNull(), "SCENARIO_NOT_SUPPORTED: no baseline throughput")
        .when((kind == "demand_uplift") & F.col("units_per_day").isNull(), "SCENARIO_NOT_SUPPORTED: no daily units"))
    checked = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return checked.select(
        "*", F.when(ok, "SIMULATED").otherwise("NOT_SUPPORTED").alias("scenario_status"),
        F.when(ok & (kind == "utilization_reduction"), rounded(F.col("current_utilization") * (1 - change))).alias("scenario_utilization"),
        F.when(ok & (kind == "throughput_scaling"), rounded(F.col("throughput_per_hour") * (1 + change))).alias("scenario_throughput"),
        F.when(ok, F.when(kind == "demand_uplift", rounded(F.col("units_per_day") * (1 + change)))
               .when(kind == "throughput_scaling", rounded(F.col("throughput_per_hour") * (1 + change)) * F.col("working_hours_per_day"))
               .otherwise(F.col("units_per_day"))).alias("scenario_units_per_day"))


def scenario_delta(scenarios: DataFrame) -> DataFrame:
    units = rounded(F.col("scenario_units_per_day") - F.col("units_per_day"))
    daily = rounded(units * F.col("contribution_margin_per_unit"))
    return scenarios.select("*", units.alias("units_delta"), daily.alias("daily_delta"),
                            rounded(daily * F.col("working_days_per_month")).alias("monthly_delta"),
                            F.when(daily.isNull(), "NOT_AVAILABLE").otherwise("CALCULATED").alias("delta_status"))


COSTS = {
    "scrap": ["units_delta", "expected_defect_rate", "scrap_cost_per_unit"],
    "rework": ["units_delta", "expected_rework_rate", "rework_cost_per_unit"],
    "downtime": ["downtime_hours_per_day", "downtime_cost_per_hour"],
    "operating": ["working_hours_per_day", "operating_cost_per_hour"],
}


def cost_columns(deltas: DataFrame) -> DataFrame:
    """Four cost lines, each only where all its own inputs exist."""
    def product(names):
        out = F.col(names[0])
        for n in names[1:]:
            out = out * F.col(n)
        return rounded(out)

    return deltas.select("*", *[product(names).alias(f"cost_{k}") for k, names in COSTS.items()])


def cost_blocks(costed: DataFrame, keep: list[str]) -> DataFrame:
    """The cost lines as rows with status and missing inputs."""
    return stack_rows(costed, [
        {"cost": F.lit(k), "value": F.col(f"cost_{k}"), "status": F.when(F.col(f"cost_{k}").isNull(), "NOT_AVAILABLE").otherwise("CALCULATED"),
         "missing": _missing(*names)} for k, names in COSTS.items()], keep)


def net_impact(costed: DataFrame) -> DataFrame:
    """Contribution delta minus the known costs; not available when neither side is known."""
    total = row_sum([F.col(f"cost_{k}") for k in COSTS])
    known = F.col("daily_delta").isNotNull() | total.isNotNull()
    return costed.select("*", F.when(known, rounded(F.coalesce(total, F.lit(0.0)))).alias("cost_total"),
                         F.when(known, rounded(F.coalesce("daily_delta", F.lit(0.0)) - F.coalesce(total, F.lit(0.0)))).alias("net_daily_impact"),
                         F.when(known, "CALCULATED").otherwise("NOT_AVAILABLE").alias("net_status"))


def break_even(inputs: DataFrame) -> DataFrame:
    """Daily units that pay an intervention back in a month (or in a day without working days)."""
    cost, margin, days = F.col("intervention_cost"), F.col("contribution_margin_per_unit"), F.col("working_days_per_month")
    need = F.when(margin > 0, F.when(days > 0, cost / (margin * days)).otherwise(cost / margin))
    return inputs.select("*", rounded(need).alias("break_even_units"), F.when(need.isNull(), "NOT_AVAILABLE").otherwise("CALCULATED").alias("break_even_status"),
                         F.when(need.isNotNull(), F.when(days > 0, "working month").otherwise("1 day")).alias("break_even_horizon"))


def sensitivity(baseline: DataFrame, scenario_type: str, values: list[float]) -> DataFrame:
    """The scenario model over a sweep of changes; refused points stay as NOT_SUPPORTED rows."""
    sweep = baseline.select("dataset_id", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("change")).select(
        "*", F.lit(scenario_type).alias("scenario_type"), F.lit("user_assumption").alias("scaling_basis"))
    done = net_impact(cost_columns(scenario_delta(run_scenarios(sweep, baseline))))
    ok = F.col("scenario_status") == "SIMULATED"
    return done.select("dataset_id", "scenario_type", F.col("change").alias("parameter_value"), F.col("scenario_status").alias("status"), "reason",
                       F.when(ok, F.col("units_delta")).alias("units_delta"), F.when(ok, F.col("daily_delta")).alias("daily_delta"),
                       F.when(ok, F.col("net_daily_impact")).alias("net_daily_impact"))


def economics_status(assumptions: DataFrame, what_if: DataFrame) -> DataFrame:
    """Readiness per dataset: fields supplied and missing, throughput known or not. what_if: dataset_id, throughput."""
    wide = assumption_wide(assumptions)
    have = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in FIELDS]))
    lack = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS]))
    joined = wide.join(what_if.select("dataset_id", "throughput", F.lit(True).alias("_b")), "dataset_id", "left")
    return joined.select("dataset_id", F.when(F.col("_b"), "READY").otherwise("NOT_ANALYZED").alias("status"),
                         F.col("throughput").isNotNull().alias("throughput_available"), F.array_join(have, ", ").alias("supplied"),
                         F.array_join(lack, ", ").alias("missing"), "currency")
