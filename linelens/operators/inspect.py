"""Inspection decisions from embeddings: calibrated class, anomaly, novelty, PASS / DEFECT / REVIEW."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import argmax, distance, q, rounded, softmax
from linelens.operators.ordered import cumulative, share_below

# --- classification and calibration

def fit_classifier(train: DataFrame, label: str = "label", embedding: str = "embedding", iterations: int = 200):
    """Standardise, then multinomial logistic regression."""
    vectors = train.select(array_to_vector(q(embedding)).alias("_v"), q(label).cast("double").alias("_y"))
    scale = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True)
    head = LogisticRegression(featuresCol="_z", labelCol="_y", rawPredictionCol="_logits", predictionCol="_p", probabilityCol="_prob",
                              family="multinomial", maxIter=iterations, regParam=1e-3)
    return Pipeline(stages=[scale, head]).fit(vectors)


def classify(model, df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Adds logits and the standardised embedding as arrays."""
    out = model.transform(df.withColumn("_v", array_to_vector(q(embedding))))
    return out.select(*[q(c) for c in df.columns if c != "logits"], vector_to_array("_logits").alias("logits"), vector_to_array("_z").alias("z"))


def temperature_curve(df: DataFrame, logits: str, label: str, log_temperatures: list[float]) -> DataFrame:
    """Mean negative log likelihood at each temperature (a literal grid, expanded before the partial sums)."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in log_temperatures])).alias("log_t")
    rows = df.select(q(logits).alias("l"), q(label).alias("y"), grid)
    picked = F.get(softmax(F.col("l"), F.exp("log_t")), F.col("y"))
    return rows.groupBy("log_t").agg(F.avg(-F.ln(F.greatest(F.least(picked, F.lit(1.0)), F.lit(1e-12)))).alias("nll"))


def fit_temperature(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Best temperature over log T in [-2, 2]: a coarse grid, then a fine one around its minimum."""
    best = lambda grid: temperature_curve(df, logits, label, grid).agg(F.min_by("log_t", F.struct("nll", "log_t")).alias("t"), F.min("nll").alias("nll"))
    coarse = best([round(-2 + 0.1 * k, 4) for k in range(41)]).first()["t"]
    fine = best([round(min(max(coarse + 0.01 * k, -2.0), 2.0), 4) for k in range(-10, 11)])
    return fine.select(F.col("t").alias("log_temperature"), rounded(F.exp("t")).alias("temperature"), rounded(F.col("nll")).alias("nll"))


def probabilities(df: DataFrame, temperature: float, logits: str = "logits") -> DataFrame:
    """Calibrated and raw confidence, predicted class index and confidence level."""
    with_p = df.withColumn("probability", softmax(q(logits), float(temperature))).withColumn("_raw", softmax(q(logits)))
    best = with_p.withColumn("predicted", argmax(F.col("probability")))
    confidence = F.array_max("probability")
    return best.select(*[q(c) for c in df.columns], "probability", "predicted", confidence.alias("confidence"),
                       F.get("_raw", F.col("predicted")).alias("raw_confidence"),
                       F.when(confidence >= 0.9, "HIGH").when(confidence >= 0.7, "MODERATE").otherwise("LOW").alias("confidence_level"))


# --- references

def centroids(df: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """Mean vector per class: one JVM aggregation, one row per class."""
    v = df.select(q(label).alias("class"), array_to_vector(q(embedding)).alias("_v"))
    return v.groupBy("class").agg(Summarizer.mean(F.col("_v")).alias("_m")).select("class", vector_to_array("_m").alias("centroid"))


def class_distances(df: DataFrame, centers: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Distance of every row to every class (the class list is a bounded broadcast)."""
    packed = centers.agg(F.sort_array(F.collect_list(F.struct("class", "centroid"))).alias("_c")).first()["_c"]
    every = F.array(*[F.struct(F.lit(c["class"]).alias("class"), distance(q(embedding), F.lit(np.array(c["centroid"], dtype="float64"))).alias("distance")) for c in packed])
    return df.withColumn("class_distances", every)


def class_novelty(df: DataFrame, reference: DataFrame, embedding: str = "embedding", predicted: str = "predicted", label: str = "label") -> DataFrame:
    """Share of the predicted class's own distances below this row's distance; HIGH above 0.99."""
    centers = centroids(reference, label, embedding)
    own = reference.join(F.broadcast(centers), reference[label] == centers["class"]).select(
        F.col("class").alias("_class"), distance(q(embedding), F.col("centroid")).alias("_d"))
    asked = df.join(F.broadcast(centers), df[predicted] == centers["class"], "left").withColumn(
        "_class", F.col("class")).withColumn("_d", distance(q(embedding), F.col("centroid"))).drop("class", "centroid")
    known, unknown = asked.where("_class is not null"), asked.where("_class is null").withColumn("novelty", F.lit(1.0))
    out = share_below(known, own, ["_class"], "_d", "novelty").unionByName(unknown)
    return out.withColumnRenamed("_d", "class_distance").drop("_class").withColumn(
        "novelty_status", F.when(F.col("novelty") > fixed.REVIEW_GATE, "HIGH").otherwise("NORMAL"))


def normal_reference(normal: DataFrame, embedding: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Mean and precision matrix of the normal class.

    Each task folds its rows into one (d + 1) x (d + 1) block of sums, so the shuffle and the
    driver see d squared numbers whatever the number of rows. The covariance is shrunk by 1e-3
    of its mean variance before it is inverted.
    """
    center = np.array(normal.agg(Summarizer.mean(array_to_vector(q(embedding))).alias("m")).first()["m"].toArray())
    shift = normal.sparkSession.sparkContext.broadcast(center)

    def fold(batches):
        total = None
        for b in batches:
            if len(b):
                x = np.stack(b["e"].to_numpy()) - shift.value
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            d = total.shape[0]
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"i": i, "j": j, "s": total.ravel()})

    parts = normal.select(q(embedding).alias("e")).mapInPandas(fold, "i int, j int, s double")
    sums = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    d = len(center) + 1
    block = np.zeros((d, d))
    block[sums["i"], sums["j"]] = sums["s"]
    n, first = block[-1, -1], block[-1, :-1]
    cov = (block[:-1, :-1] - np.outer(first, first) / n) / (n - 1)
    cov += 1e-3 * np.trace(cov) / len(cov) * np.eye(len(cov))
    return center + first / n, np.linalg.inv(cov)


def mahalanobis(df: DataFrame, mean: np.ndarray, precision: np.ndarray, embedding: str = "embedding", name: str = "mahalanobis") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((mean, precision))  # d squared numbers

    @F.pandas_udf("double")
    def measure(e: pd.Series) -> pd.Series:
        if len(e) == 0:
            return pd.Series([], dtype="float64")
        m, p = shared.value
        delta = np.stack(e.to_numpy()) - m
        return pd.Series(np.sqrt(np.einsum("ij,jk,ik->i", delta, p, delta)))

    return df.withColumn(name, measure(q(embedding)))


def anomaly_percentile(df: DataFrame, normal_fit: DataFrame, normal_validation: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Share of normal validation distances below each row's distance to the normal class."""
    mean, precision = normal_reference(normal_fit, embedding)
    key = F.lit("normal").alias("_ref_class")
    asked = mahalanobis(df, mean, precision, embedding).select("*", key)
    known = mahalanobis(normal_validation, mean, precision, embedding).select("mahalanobis", key)
    return share_below(asked, known, ["_ref_class"], "mahalanobis", "anomaly").drop("_ref_class")


def feature_space(train: DataFrame, label: str = "label", embedding: str = "embedding", points: int | None = None, order: str = "inspection_id"):
    """Two principal components: (fitted model, all rows or on request an even subsample per class, explained variance)."""
    v = train.select(q(order), q(label).alias("class"), array_to_vector(q(embedding)).alias("_v"))
    pipeline = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True), PCA(k=2, inputCol="_z", outputCol="_xy")])
    model = pipeline.fit(v)
    projected = project(model, v.select(order, "class", "_v"))
    variance = [float(x) for x in model.stages[-1].explainedVariance]
    if points is None:
        return model, projected.select(order, "class", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")), variance
    placed = cumulative(projected, ["class"], [order], {"rank": F.lit(1)})
    sizes = placed.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    take = F.least(F.col("n"), F.lit(points))
    # row i is kept when some k < take has floor(k * n / take) = i
    k = F.ceil(F.col("before_rank") * take / F.col("n"))
    kept = placed.join(F.broadcast(sizes), "class").where((k < take) & (F.floor(k * F.col("n") / take) == F.col("before_rank")))
    return model, kept.select(order, "class", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")), variance


def project(model, df: DataFrame) -> DataFrame:
    """New rows in the stored two components; signs are fixed by the largest loading."""
    pc = model.stages[-1].pc.toArray()
    sign = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(df).withColumn("_a", vector_to_array("_xy"))
    return out.select(*[q(c) for c in df.columns if c != "_v"], (F.get("_a", F.lit(0)) * sign[0]).alias("x"), (F.get("_a", F.lit(1)) * sign[1]).alias("y"))


# --- decision

def decide(df: DataFrame, normal: int = 0) -> DataFrame:
    """PASS, DEFECT or REVIEW with reasons, from predicted, confidence, anomaly and novelty.

    Without an anomaly or novelty column value (null) only the confidence gate applies.
    """
    is_normal = F.col("predicted") == normal
    odd = F.coalesce(F.col("anomaly") > fixed.REVIEW_GATE, F.lit(False))
    new = F.coalesce(F.col("novelty") > fixed.REVIEW_GATE, F.lit(False))
    unsure_pass = F.col("confidence") < fixed.PASS_CONFIDENCE
    unsure_defect = F.col("confidence") < fixed.DEFECT_CONFIDENCE
    decision = F.when(is_normal, F.when(~unsure_pass & ~odd, "PASS").otherwise("REVIEW")).otherwise(
        F.when(~unsure_defect & ~new, "DEFECT").otherwise("REVIEW"))
    reasons = F.array_compact(F.array(
        F.when(is_normal & odd, F.lit("anomaly above the review gate")),
        F.when(is_normal & unsure_pass, F.lit("confidence below the pass threshold")),
        F.when(~is_normal & new, F.lit("novelty above the review gate")),
        F.when(~is_normal & unsure_defect, F.lit("confidence below the defect threshold"))))
    return df.withColumn("decision", decision).withColumn("review_reasons", reasons)


def decision_matrix(decided: DataFrame, truth: str = "label", normal: int = 0) -> DataFrame:
    """Decisions per actual state."""
    actual = F.when(q(truth) == normal, "normal").otherwise("defective").alias("actual")
    return decided.groupBy(actual).agg(*[F.count_if(F.col("decision") == d).alias(d.lower()) for d in ("PASS", "DEFECT", "REVIEW")])


def decision_rates(decided: DataFrame, truth: str = "label", normal: int = 0) -> DataFrame:
    """Defects passed among all defects, normals rejected among all normals, and the review rate."""
    bad = q(truth) != normal
    share = lambda cond, among: F.avg(F.when(among, cond.cast("double")))
    d = F.col("decision")
    return decided.agg(F.count(F.lit(1)).alias("n"), rounded(share(d == "PASS", bad)).alias("false_accept_rate"),
                       rounded(share(d == "DEFECT", ~bad)).alias("false_reject_rate"), rounded(F.avg((d == "REVIEW").cast("double"))).alias("review_rate"))


def batch_quality(decided: DataFrame, truth: str = "label", normal: int = 0) -> DataFrame:
    """Counts and rates against ground truth; REVIEW is an escalation, not an error."""
    bad, d = q(truth) != normal, F.col("decision")
    row = decided.agg(
        F.count_if(bad & (d == "DEFECT")).alias("tp"), F.count_if(~bad & (d == "PASS")).alias("tn"),
        F.count_if(~bad & (d == "DEFECT")).alias("fp"), F.count_if(bad & (d == "PASS")).alias("fn"),
        F.count_if(d == "REVIEW").alias("review"), F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return row.select("tp", "tn", "fp", "fn", F.round(ratio(fn, fn + tn), 4).alias("escape_rate"), F.round(ratio(fp, fp + tp), 4).alias("overkill_rate"),
                      F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
                      F.round(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)), 4).alias("f1"),
                      F.round(ratio(F.col("review"), F.col("n")), 4).alias("review_rate"), F.round("c", 4).alias("avg_confidence"))


def ground_truth_join(results: DataFrame, images: DataFrame, key: str = "inspection_id") -> DataFrame:
    """Decision next to the class folder of the file, where the file has one."""
    return results.join(images.where("class_folder is not null").select(q(key), F.col("class_folder").alias("ground_truth")), key)


def interleave(images: DataFrame, normal: str = "normal") -> DataFrame:
    """Deterministic order: one defect (rotating classes), then two normals; by name without a normal class.

    ``within_rotation`` marks the frames that a rotation of as many steps as there are defects
    reaches; a class larger than its turn follows after them, so no frame is lost.
    """
    classes = [r["class_folder"] for r in images.where("class_folder is not null").select("class_folder").distinct().orderBy("class_folder").collect()]
    if normal not in classes or len(classes) < 2:
        from linelens.operators.ordered import with_row_index

        named = images.withColumn("_low", F.lower("original_name"))
        return with_row_index(named, ["_low", "original_name"], "frame").select("frame", "class_folder", "original_name", F.lit(True).alias("within_rotation"))
    defects = [c for c in classes if c != normal]
    ranked = cumulative(images.where("class_folder is not null"), ["class_folder"], ["original_name"], {"rank": F.lit(1)})
    turn = F.array_position(F.array(*[F.lit(c) for c in defects]), F.col("class_folder")) - 1
    is_normal = F.col("class_folder") == normal
    step = F.when(is_normal, F.floor(F.col("before_rank") / 2)).otherwise(F.col("before_rank") * len(defects) + turn)
    slot = F.when(is_normal, 1 + F.col("before_rank") % 2).otherwise(0)
    total = images.where((F.col("class_folder") != normal)).count()
    from linelens.operators.ordered import with_row_index

    keyed = ranked.select("class_folder", "original_name", step.cast("long").alias("_step"), slot.cast("int").alias("_slot")).withColumn(
        "within_rotation", is_normal | (F.col("_step") < total)).withColumn("_late", ~F.col("within_rotation"))
    return with_row_index(keyed, ["_late", "_step", "_slot", "original_name"], "frame").select("frame", "class_folder", "original_name", "within_rotation")
