"""Human review beside the model's decision, never over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelens.functions import fixed


def actions(spark) -> DataFrame:
    return spark.createDataFrame(fixed.HUMAN_ACTIONS, "action string, human_decision string, action_label string")


def record_review(inspections: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) review rows. requests: inspection_id, action, at. The model decision is kept beside."""
    known = requests.join(F.broadcast(actions(requests.sparkSession)), "action", "left")
    joined = known.join(inspections.select("inspection_id", F.col("decision").alias("ai_decision"), F.col("confidence").alias("ai_confidence")), "inspection_id", "left")
    reason = F.when(F.col("human_decision").isNull(), "INVALID_REVIEW_ACTION").when(F.col("ai_decision").isNull(), "INSPECTION_NOT_FOUND")
    judged = joined.withColumn("reason", reason)
    return (judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("inspection_id", "action", "at", "reason"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("inspection_id").agg(F.max_by(F.struct("action", "human_decision", "at"), "at").alias("s")).select("inspection_id", "s.action", "s.human_decision", "s.at")


def _with_review(inspections: DataFrame, reviews: DataFrame) -> DataFrame:
    return inspections.join(latest_reviews(reviews).select("inspection_id", "action", "human_decision"), "inspection_id", "left")


def review_queue(inspections: DataFrame, reviews: DataFrame, limit: int = 100, order: str = "inspection_id", include_reviewed: bool = False) -> DataFrame:
    """REVIEW inspections without a resolving human decision, oldest first."""
    rows = _with_review(inspections.where("decision = 'REVIEW'"), reviews)
    if not include_reviewed:
        rows = rows.where("human_decision is null or human_decision = 'REVIEW'")
    return rows.orderBy(order).limit(limit)


def review_stats(inspections: DataFrame, reviews: DataFrame) -> DataFrame:
    """Totals, rates and mean confidence over the whole history."""
    d, human = F.col("decision"), F.col("human_decision")
    settled = F.coalesce(human != "REVIEW", F.lit(False))
    n = F.count(F.lit(1))
    rate = lambda c: F.round(F.when(n > 0, F.count_if(c) / n), 4)
    return _with_review(inspections, reviews).agg(
        n.alias("total"), F.count_if(d != "REVIEW").alias("auto_resolved"), F.count_if((d == "REVIEW") & settled).alias("human_reviewed"),
        F.count_if((d == "REVIEW") & ~settled).alias("pending_review"), rate(d != "REVIEW").alias("auto_resolved_rate"),
        rate((d == "REVIEW") & settled).alias("human_review_rate"), rate((d == "REVIEW") & ~settled).alias("pending_review_rate"),
        *[F.count_if(d == k).alias(k.lower()) for k in ("PASS", "DEFECT")], F.count_if(d == "REVIEW").alias("review"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"))
