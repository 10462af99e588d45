"""Advisory recommendations: rules as filters over the analysis tables, then gate, priority and rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import short_id
from linelens.operators.language import validate
from linelens.session import materialize

RULES = ["high_utilization", "queue_bottleneck", "cycle_time", "process_drift", "anomaly_review", "scenario",
         "data_gap_economics", "data_gap_vision"]
PRESSURE_FLOOR = 0.8


def _evidence(statement: Column, detail: Column, source: str, kind: str, value: Column | None = None) -> Column:
    return F.struct(statement.alias("statement"), detail.alias("detail"), F.lit(source).alias("source"), F.lit(kind).alias("epistemic_status"),
                    (F.lit(None) if value is None else value).cast("double").alias("value"))


def _emit(df: DataFrame, rule: str, action: str, target: Column, title: Column, why: Column, evidence: Column, quality: Column,
          limits: list[str], station: Column | None = None, gap: bool = False) -> DataFrame:
    return df.select(
        "dataset_id", F.lit(rule).alias("rule"), F.lit(action).alias("action_type"), target.alias("target"),
        (F.lit(None).cast("string") if station is None else station).alias("station"), title.alias("title"), why.alias("why"),
        evidence.alias("evidence"), quality.alias("evidence_quality"), F.array(*[F.lit(t) for t in limits]).alias("limitations"),
        F.lit(gap).alias("data_requirement"))


def _num(c: Column) -> Column:
    return F.coalesce(F.format_number(c, 4), F.lit("n/a"))


def _pressure(candidates: DataFrame, rule: str, action: str, column: str, mean: str, samples: str, words: str, fixed_quality: str | None = None) -> DataFrame:
    hit = candidates.where(F.col(column) >= PRESSURE_FLOOR)
    s = F.col("station")
    proof = F.array(_evidence(F.concat(F.lit(f"{words} pressure "), F.format_number(column, 2), F.lit(" at "), s),
                              F.concat(F.lit("mean "), _num(F.col(mean)), F.lit(" over "), F.coalesce(F.col(samples).cast("string"), F.lit("0")), F.lit(" records")),
                              "bottleneck", "DATA_DERIVED", F.col(mean)))
    if rule == "high_utilization":
        proof = F.concat(proof, F.when(F.col("rca_factor").isNotNull(), F.array(_evidence(
            F.concat(F.lit("associated factor "), F.col("rca_factor")), F.concat(F.lit("evidence score "), _num(F.col("rca_score"))),
            "root_cause", "STATISTICAL_ASSOCIATION", F.col("rca_score")))).otherwise(F.filter(proof, lambda x: F.lit(False))))
    return _emit(hit, rule, action, s, F.concat(F.lit(f"Investigate {words} at "), s),
                 F.concat(s, F.lit(f" is the leading candidate and shows high {words} pressure; investigation is advised, an effect is not established.")),
                 proof, F.lit(fixed_quality) if fixed_quality else F.col("evidence_quality"),
                 [f"{words.capitalize()} pressure is relative to this dataset.", fixed.DISCLAIMER], s)


def rule_high_utilization(candidates: DataFrame) -> DataFrame:
    """``candidates``: one row per dataset, the candidate station with its components (see flow.score_stations)."""
    return _pressure(candidates, "high_utilization", "INVESTIGATE_HIGH_UTILIZATION", "utilization_pressure", "utilization_mean", "utilization_samples", "utilization")


def rule_queue(candidates: DataFrame) -> DataFrame:
    return _pressure(candidates, "queue_bottleneck", "INVESTIGATE_QUEUE_BOTTLENECK", "queue_pressure", "queue_wait_mean", "queue_wait_samples", "queue")


def rule_cycle_time(candidates: DataFrame) -> DataFrame:
    return _pressure(candidates, "cycle_time", "INVESTIGATE_CYCLE_TIME", "cycle_time_pressure", "cycle_time_mean", "cycle_time_samples", "cycle time", "MODERATE_EVIDENCE")


def rule_drift(drift: DataFrame) -> DataFrame:
    """``drift``: dataset_id plus the drift columns; the column with the largest |z| speaks."""
    top = drift.where("drift_detected").groupBy("dataset_id").agg(
        F.max_by(F.struct("column", "peak_ewma_z", "direction"), F.struct(F.abs("peak_ewma_z"), "column")).alias("s")).select("dataset_id", "s.*")
    c = F.col("column")
    return _emit(top, "process_drift", "INVESTIGATE_PROCESS_DRIFT", c, F.concat(F.lit("Investigate process drift in "), c),
                 F.concat(c, F.lit(" moved against its own baseline ("), F.col("direction"), F.lit("); the reason is open.")),
                 F.array(_evidence(F.concat(F.lit("smoothed z passed the threshold for "), c), F.concat(F.lit("peak z "), _num(F.col("peak_ewma_z"))),
                                   "root_cause", "STATISTICAL_ASSOCIATION", F.col("peak_ewma_z"))),
                 F.lit("MODERATE_EVIDENCE"), ["Drift compares a metric with its own baseline.", "Order is record order."])


def rule_anomaly(candidates: DataFrame, rates: DataFrame) -> DataFrame:
    """``rates``: dataset_id, source, rows, anomalous_rows, anomaly_rate."""
    top = rates.groupBy("dataset_id").agg(F.max_by(F.struct("source", "rows", "anomalous_rows", "anomaly_rate"), F.struct("anomaly_rate", "source")).alias("s"))
    joined = candidates.select("dataset_id", "station").join(top, "dataset_id").where(F.col("s.anomaly_rate") > 0)
    s = F.col("station")
    return _emit(joined, "anomaly_review", "REVIEW_ANOMALOUS_RECORDS", s, F.concat(F.lit("Review anomalous records related to "), s),
                 F.concat(F.col("s.anomalous_rows").cast("string"), F.lit(" of "), F.col("s.rows").cast("string"), F.lit(" scored records are unusual; review is advised.")),
                 F.array(_evidence(F.lit("anomaly-flagged records exist"), F.col("s.source").cast("string"), "predictions", "MODEL_CONTRIBUTION", F.col("s.anomaly_rate"))),
                 F.lit("LIMITED_EVIDENCE"), ["Anomaly means unusual in feature space, not a confirmed defect.", fixed.DISCLAIMER], s)


def rule_scenario(scenarios: DataFrame) -> DataFrame:
    """``scenarios``: the latest scenario per dataset with station, scenario_type, delta_status, daily_delta."""
    hit = scenarios.where("delta_status = 'CALCULATED'")
    target = F.coalesce("station", F.lit("candidate_constraint"))
    return _emit(hit, "scenario", "EVALUATE_CAPACITY_IMPROVEMENT", target, F.concat(F.lit("Evaluate the simulated scenario for "), target),
                 F.lit("A user scenario was simulated against the observed baseline; it is shown under supplied assumptions and is no forecast."),
                 F.array(_evidence(F.concat(F.lit("simulated "), F.col("scenario_type")), F.concat(F.lit("change "), F.col("change").cast("string")), "economics", "SIMULATED", F.col("daily_delta")),
                         _evidence(F.lit("baseline throughput was observed"), _num(F.col("throughput_per_hour")), "bottleneck", "DATA_DERIVED", F.col("throughput_per_hour"))),
                 F.lit("MODERATE_EVIDENCE"), ["Simulated under stated assumptions.", "No discrete-event simulation was run."], F.col("station"))


def rule_gap_economics(datasets: DataFrame, assumptions: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Key fields (margin, hours, currency) that nobody supplied, unless a scenario already calculated a delta."""
    key = ["contribution_margin_per_unit", "working_hours_per_day", "currency"]
    wanted = datasets.select("dataset_id", F.explode(F.array(*[F.lit(k) for k in key])).alias("field"))
    given = assumptions.where("value is not null or value_text is not null").select("dataset_id", "field")
    gaps = wanted.join(given, ["dataset_id", "field"], "left_anti").join(
        scenarios.where("delta_status = 'CALCULATED'").select("dataset_id").distinct(), "dataset_id", "left_anti")
    per = gaps.groupBy("dataset_id").agg(F.array_join(F.sort_array(F.collect_list("field")), ", ").alias("fields"))
    return _emit(per, "data_gap_economics", "REVIEW_DATA_GAP", F.lit("economic_assumptions"), F.lit("Provide economic assumptions to quantify impact"),
                 F.lit("The data has no money columns; amounts must come from the user."),
                 F.array(_evidence(F.lit("economic assumptions are missing"), F.concat(F.lit("missing fields: "), F.col("fields")), "assumptions", "USER_ASSUMPTION")),
                 F.lit("INSUFFICIENT_EVIDENCE"), ["No economic value is made up."], gap=True)


def rule_gap_vision(datasets: DataFrame) -> DataFrame:
    """``datasets``: dataset_id, has_image_data."""
    return _emit(datasets.where("not has_image_data"), "data_gap_vision", "REVIEW_DATA_GAP", F.lit("vision_dataset"),
                 F.lit("Provide inspection images to enable visual checks"), F.lit("There are no images in this dataset."),
                 F.array(_evidence(F.lit("visual inspection is not supported here"), F.lit("no image files or image columns"), "profile", "OBSERVED")),
                 F.lit("INSUFFICIENT_EVIDENCE"), ["Unsupported until images are supplied."], gap=True)


def combine(rules: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rules)


def priority(quality: Column, bottleneck: Column, scenario: Column, economics: Column) -> Column:
    rank = reduce(lambda acc, kv: acc.when(quality == kv[0], kv[1]), fixed.QUALITY_ORDER.items(), F.when(F.lit(False), 0)).otherwise(0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return (3.0 * rank + 2.0 * flag(bottleneck) + flag(scenario) + flag(economics)).cast("double")


def finish(produced: DataFrame, candidates: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Gate, priority, one per (action, target), rank. Rejected rows stay with their errors and no rank."""
    checked = materialize(validate(produced))  # a few rows per dataset; the rules behind them run once
    context = candidates.select("dataset_id", F.col("station").alias("_candidate"))
    done = scenarios.groupBy("dataset_id").agg(F.lit(True).alias("_has"), F.bool_or(F.col("delta_status") == "CALCULATED").alias("_calc"))
    joined = checked.join(context, "dataset_id", "left").join(done, "dataset_id", "left")
    evaluating = F.col("action_type") == "EVALUATE_CAPACITY_IMPROVEMENT"
    scored = joined.withColumn("priority", priority(
        F.col("evidence_quality"), F.col("station") == F.col("_candidate"), F.col("_has") & evaluating, F.col("_calc") & evaluating)).drop("_candidate", "_has", "_calc")
    scored = scored.withColumn("recommendation_id", short_id(F.col("dataset_id"), F.col("action_type"), F.col("target")))
    valid = F.size("errors") == 0
    rule_order = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    # at most eight rows per dataset
    first = F.row_number().over(W.partitionBy("dataset_id", "action_type", "target", valid).orderBy(rule_order))
    kept = scored.withColumn("duplicate", valid & (first > 1)).withColumn("_ok", valid & ~F.col("duplicate"))
    rank = F.row_number().over(W.partitionBy("dataset_id", "_ok").orderBy(F.desc("priority"), "action_type", "target"))
    return kept.withColumn("rank", F.when(F.col("_ok"), rank)).drop("_ok")


def rule_trace(finished: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every rule of every dataset: activated or not, kept, rejected or duplicate."""
    grid = datasets.select("dataset_id", F.explode(F.array(*[F.lit(r) for r in RULES])).alias("rule"))
    state = finished.select("dataset_id", "rule", F.when(F.size("errors") > 0, "REJECTED").when(F.col("duplicate"), "DUPLICATE").otherwise("ACTIVATED").alias("state"))
    return grid.join(state, ["dataset_id", "rule"], "left").select("dataset_id", "rule", F.coalesce("state", F.lit("NOT_ACTIVATED")).alias("state"))


def decision_summary(finished: DataFrame) -> DataFrame:
    """Per dataset: number of actions, the first one, data gaps and rejected rules."""
    live = F.col("rank").isNotNull()
    gaps = F.array_join(F.sort_array(F.collect_list(F.when(live & F.col("data_requirement"), F.col("target")))), ", ")
    return finished.groupBy("dataset_id").agg(
        F.count_if(live).alias("recommendations"), F.max(F.when(F.col("rank") == 1, F.col("action_type"))).alias("top_action"),
        F.max(F.when(F.col("rank") == 1, F.col("target"))).alias("top_target"), gaps.alias("data_gaps"), F.count_if(F.size("errors") > 0).alias("rejected"))


def recommendation_evidence(finished: DataFrame, recommendation_id: str | None = None) -> DataFrame:
    rows = finished if recommendation_id is None else finished.where(F.col("recommendation_id") == recommendation_id)
    return rows.select("recommendation_id", "action_type", F.posexplode("evidence").alias("position", "e")).select(
        "recommendation_id", "action_type", "position", "e.*")
