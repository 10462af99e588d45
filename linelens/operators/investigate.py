"""Per-inspection investigations: ten ordered stages, overall status, event feed and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelens.functions.expr import q, short_id

STAGES = ["received", "classifying", "localizing", "checking_robustness", "process_correlation", "root_cause", "bottleneck",
          "impact", "what_if", "recommendation"]
INSPECTION_STAGES = STAGES[:4]

CONTEXT = ("dataset_id string, has_process boolean, root_cause_status string, root_cause_findings long, bottleneck_status string, "
           "candidate string, assumptions_supplied long, daily_contribution double, scenarios long, recommendations long")


def _stage(stage: str, label: str, status: Column, summary: Column, epistemic: Column | str) -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.lit(label).alias("label"), status.alias("status"), summary.alias("summary"),
                    (F.lit(epistemic) if isinstance(epistemic, str) else epistemic).alias("epistemic"))


def investigate(inspections: DataFrame, context: DataFrame) -> DataFrame:
    """One row per inspection with its stages array and overall status.

    ``inspections``: inspection_id, dataset_id (may be null), decision, predicted_class, confidence,
    anomaly, novelty, novelty_status, localized, filename. ``context``: one row per analysed dataset.
    """
    j = inspections.join(context, "dataset_id", "left")  # one row per dataset
    here = F.coalesce("has_process", F.lit(False))
    gap = lambda status, other: F.when(here, status).otherwise(other)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("n/a"))
    no_data = F.lit("no process dataset selected")
    done = lambda c, positive: F.when(c == "FAILED", "FAILED").when(c.isNull() | ~positive, "DATA_GAP").otherwise("COMPLETE")
    review = (F.col("novelty_status") == "HIGH") | (F.col("decision") == "REVIEW")
    supplied, scenarios, advice = (F.coalesce(c, F.lit(0)) for c in ("assumptions_supplied", "scenarios", "recommendations"))
    stages = F.array(
        _stage("received", "Inspection received", F.lit("COMPLETE"), F.concat(F.lit("source "), text(F.coalesce("filename", F.col("inspection_id").cast("string")))), "OBSERVED"),
        _stage("classifying", "Classification", F.lit("COMPLETE"), F.concat(text(F.col("predicted_class")), F.lit(" at "), F.format_number(F.coalesce("confidence", F.lit(0.0)) * 100, 1), F.lit("%")), "MODEL OUTPUT"),
        _stage("localizing", "Localization", F.when(F.col("localized"), "COMPLETE").otherwise("DATA_GAP"), F.when(F.col("localized"), "region found").otherwise("no region found"), "MODEL-DERIVED"),
        _stage("checking_robustness", "Robustness check", F.when(F.coalesce(review, F.lit(False)), "REVIEW").otherwise("COMPLETE"),
               F.concat(F.lit("novelty "), F.coalesce("novelty_status", F.lit("NORMAL"))), "MODEL OUTPUT"),
        _stage("process_correlation", "Process correlation", gap(F.lit("PARTIAL"), F.lit("DATA_GAP")), gap(F.lit("dataset-level context"), no_data), gap(F.lit("OBSERVED"), F.lit("DATA GAP"))),
        _stage("root_cause", "Root-cause hypotheses", gap(done(F.col("root_cause_status"), F.col("root_cause_findings") > 0), F.lit("DATA_GAP")),
               gap(F.concat(text(F.col("root_cause_findings")), F.lit(" findings in order")), no_data), gap(F.lit("STATISTICAL ASSOCIATION"), F.lit("DATA GAP"))),
        _stage("bottleneck", "Bottleneck / flow", gap(done(F.col("bottleneck_status"), F.lit(True)), F.lit("DATA_GAP")),
               gap(F.concat(F.lit("likely constraint: "), F.coalesce("candidate", F.lit("none identified"))), no_data), gap(F.lit("EVIDENCE-BASED HYPOTHESIS"), F.lit("DATA GAP"))),
        _stage("impact", "Production impact", gap(F.when(supplied == 0, "AWAITING_INPUT").otherwise("COMPLETE"), F.lit("DATA_GAP")),
               gap(F.when(supplied == 0, "waiting for assumptions").otherwise(F.concat(F.lit("daily contribution "), text(F.round("daily_contribution", 2)))), no_data),
               gap(F.when(supplied == 0, "USER ASSUMPTION").otherwise("CALCULATED"), F.lit("DATA GAP"))),
        _stage("what_if", "What-if scenario", gap(F.when(scenarios == 0, "AWAITING_INPUT").otherwise("COMPLETE"), F.lit("DATA_GAP")),
               gap(F.when(scenarios == 0, "scenario runs on demand").otherwise(F.concat(scenarios.cast("string"), F.lit(" scenario(s) run"))), no_data), gap(F.lit("SIMULATION"), F.lit("DATA GAP"))),
        _stage("recommendation", "Advisory actions", gap(F.when(advice == 0, "DATA_GAP").otherwise("COMPLETE"), F.lit("DATA_GAP")),
               gap(F.concat(advice.cast("string"), F.lit(" advisory action(s)")), no_data), gap(F.lit("ADVISORY"), F.lit("DATA GAP"))))
    with_stages = j.select(*[q(c) for c in inspections.columns], stages.alias("stages"))
    failed = F.exists("stages", lambda s: s["status"] == "FAILED")
    overall = (F.when(F.col("decision") == "REVIEW", "REVIEW_REQUIRED").when(F.col("dataset_id").isNull(), "DATA_GAP")
               .when(failed, "PARTIAL").otherwise("COMPLETE"))
    how_many = lambda *names: F.size(F.filter("stages", lambda s: s["status"].isin(*names)))
    return with_stages.select(
        F.concat(F.lit("inv_"), short_id(F.col("inspection_id").cast("string"), F.coalesce("dataset_id", F.lit("")))).alias("investigation_id"), "*",
        overall.alias("status"), how_many("COMPLETE", "REVIEW").alias("stages_complete"), how_many("DATA_GAP").alias("stages_data_gap"),
        how_many("AWAITING_INPUT").alias("stages_awaiting"), how_many("FAILED").alias("stages_failed"), how_many("PARTIAL").alias("stages_partial"))


def stage_rows(investigations: DataFrame) -> DataFrame:
    return investigations.select("investigation_id", "inspection_id", F.posexplode("stages").alias("position", "s")).select(
        "investigation_id", "inspection_id", "position", "s.*")


def replay(investigations: DataFrame, inspection_id) -> DataFrame:
    """The stages of one investigation in order."""
    return stage_rows(investigations.where(F.col("inspection_id") == inspection_id)).orderBy("position")


def event_feed(investigations: DataFrame) -> DataFrame:
    """Business events of each investigation in order."""
    event = lambda kind, message, epistemic: F.struct(kind.alias("type"), message.alias("message"), epistemic.alias("epistemic"))
    lit = F.lit
    d = F.col("decision")
    none = lit(None).cast("struct<type:string,message:string,epistemic:string>")
    head = F.array(
        event(lit("inspection_completed"), F.concat(lit("inspection completed: "), F.coalesce(F.col("predicted_class").cast("string"), lit("n/a")), lit(" ("), d, lit(")")), lit("OBSERVED")),
        F.when(d == "DEFECT", event(lit("defect_detected"), lit("defect decision recorded"), lit("MODEL OUTPUT"))).otherwise(none),
        F.when(d == "REVIEW", event(lit("review_required"), lit("sample flagged for human review"), lit("MODEL OUTPUT"))).otherwise(none),
        event(lit("investigation_triggered"), lit("automatic investigation triggered"), lit("OBSERVED")))
    suffix = lambda s: (F.when(s["status"].isin("COMPLETE", "REVIEW"), "_complete").when(s["status"] == "DATA_GAP", "_data_gap")
                        .when(s["status"] == "AWAITING_INPUT", "_awaiting_input").when(s["status"] == "FAILED", "_failed"))
    rest = F.transform(F.filter("stages", lambda s: ~s["stage"].isin(*INSPECTION_STAGES) & suffix(s).isNotNull()), lambda s: event(
        F.concat(s["stage"], suffix(s)), F.concat(s["label"], lit(": "), s["summary"]),
        F.when(s["status"].isin("DATA_GAP", "FAILED"), "DATA GAP").otherwise(s["epistemic"])))
    return investigations.select("investigation_id", "inspection_id", F.posexplode(F.concat(F.array_compact(head), rest)).alias("position", "e")).select(
        "investigation_id", "inspection_id", "position", "e.*")
