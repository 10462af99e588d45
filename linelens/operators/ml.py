"""Predictive models on Spark ML: target types, candidates, selection, metrics, importance, registry."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import finite, is_numeric, q, rounded, stack_rows
from linelens.operators.profile import distinct_counts
from linelens.session import materialize

FOREST_TREES, BOOST_ROUNDS = 200, 150
#: Rows in a partition of the table that models are fitted on.
FIT_ROWS = 8192


def detect_target_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Regression, binary, multiclass or unsupported, per column. Counts are never read as classes."""
    columns = columns or df.columns
    aggs = []
    for i, c in enumerate(columns):
        numeric = is_numeric(df.schema[c].dataType)
        v = finite(q(c)) if numeric else q(c)
        near = F.count_if(F.abs(v - F.rint(v)) > 1e-8 + 1e-5 * F.abs(F.rint(v))) if numeric else F.lit(1)
        aggs += [F.count(v).alias(f"n{i}"), near.cast("long").alias(f"f{i}")]
    rows = stack_rows(df.agg(*aggs), [{"column": F.lit(c), "numeric": F.lit(is_numeric(df.schema[c].dataType)), "n_samples": F.col(f"n{i}"),
                                       "fractions": F.col(f"f{i}")} for i, c in enumerate(columns)])
    joined = rows.join(F.broadcast(distinct_counts(df, columns)), "column", "left").withColumn("n_unique", F.coalesce("unique", F.lit(0)))
    hint = F.col("column").rlike("(?i)" + fixed.TARGET_CLASS_NAMES)
    whole = F.col("fractions") == 0
    kind = (F.when((F.col("n_samples") == 0) | (F.col("n_unique") <= 1) | ~F.col("numeric"), "unsupported")
            .when(hint & (F.col("n_unique") == 2), "binary_classification")
            .when(hint & whole & F.col("n_unique").between(3, 12), "multiclass_classification")
            .otherwise("regression"))
    return joined.select("column", "n_samples", "n_unique", hint.alias("class_like_name"), (F.col("numeric") & whole).alias("integer_valued"), kind.alias("type"))


def regression_metrics(df: DataFrame, actual: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """n, mae, rmse and r2 (null when the actual values do not vary)."""
    e = actual - predicted
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(F.abs(e))).alias("mae"), rounded(F.sqrt(F.avg(e * e))).alias("rmse"),
        rounded(F.when(F.max(actual) > F.min(actual), 1 - F.sum(e * e) / (F.var_pop(actual) * F.count(F.lit(1))))).alias("r2"))


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    return df.groupBy(actual.alias("actual"), predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(table: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table (classes x classes rows)."""
    truth = table.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"))
    guess = table.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    hits = table.where("actual = predicted").select(F.col("actual").alias("class"), F.col("n").alias("hit"))
    joined = truth.join(guess, "class", "full").join(hits, "class", "left").na.fill(0, ["support", "called", "hit"])
    p = F.when(F.col("called") > 0, F.col("hit") / F.col("called")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    return joined.select("class", "support", "hit", p.alias("precision"), r.alias("recall")).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def classification_metrics(table: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 from a confusion table."""
    s = F.col("support")
    n = F.sum(s)
    return class_report(table).agg(
        n.alias("n"), rounded(F.sum("hit") / n).alias("accuracy"), rounded(F.sum(s * F.col("precision")) / n).alias("precision_weighted"),
        rounded(F.sum(s * F.col("recall")) / n).alias("recall_weighted"), rounded(F.sum(s * F.col("f1")) / n).alias("f1_weighted"))


def best_by_metric(results: DataFrame) -> DataFrame:
    """The best candidate: rmse lower, f1 higher, the earlier candidate on ties. Columns: candidate, place, kind, value."""
    key = F.when(F.col("kind") == "regression", F.col("value")).otherwise(-F.col("value"))
    return results.where("value is not null").agg(F.min_by(F.struct("candidate", "value"), F.struct(key, F.col("place"))).alias("s")).select("s.*")


class MeanBaseline:
    """Predicts the training mean, or the most frequent training class."""

    def __init__(self, classes: bool):
        self.classes = classes

    def fit(self, train: DataFrame) -> "MeanBaseline":
        if self.classes:
            top = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").first()
            self.value = top["label"]
        else:
            self.value = train.agg(F.avg("label").alias("m")).first()["m"]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(float(self.value)))


def candidates(kind: str, n_train: int, features: list[str], seed: int = 42, forest_trees: int = FOREST_TREES, boost_rounds: int = BOOST_ROUNDS) -> list[tuple[str, object]]:
    """(name, estimator) in fixed order, the same for every number of rows."""
    assemble = VectorAssembler(inputCols=features, outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    line = lambda est: Pipeline(stages=[assemble, scale, est])
    if kind == "regression":
        out = [("dummy_mean", MeanBaseline(False)),
               ("ridge", line(LinearRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False)))]
        out.append(("random_forest", line(RandomForestRegressor(numTrees=forest_trees, maxDepth=10, seed=seed, featureSubsetStrategy="all"))))
        return out + [("gradient_boosting", line(GBTRegressor(maxIter=boost_rounds, stepSize=0.1, maxDepth=5, seed=seed)))]
    if kind in ("binary_classification", "multiclass_classification"):
        out = [("dummy_most_frequent", MeanBaseline(True)), ("logistic_regression", line(LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1))))]
        out.append(("random_forest", line(RandomForestClassifier(numTrees=forest_trees, maxDepth=10, seed=seed))))
        boost = GBTClassifier(maxIter=boost_rounds, stepSize=0.1, maxDepth=5, seed=seed)
        return out + [("gradient_boosting", line(boost if kind.startswith("binary") else OneVsRest(classifier=boost)))]
    return []


def _score(kind: str, predicted: DataFrame) -> dict:
    if kind == "regression":
        return regression_metrics(predicted, F.col("label"), F.col("prediction")).first().asDict()
    return classification_metrics(confusion(predicted, F.col("label"), F.col("prediction"))).first().asDict()


def spread_rows(data: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """The columns of ``n`` rows in even partitions of about FIT_ROWS, sorted inside.

    A narrow table of many rows is little data, so a scan would give all of it to one task. The number of partitions and
    the order in them follow from the rows alone, and with them what a seeded forest draws.
    """
    return data.select(*[q(c) for c in columns]).repartition(-(-n // FIT_ROWS)).sortWithinPartitions(*[q(c) for c in columns])


def select_model(df: DataFrame, target: str, features: list[str], kind: str, seed: int = 42, forest_trees: int = FOREST_TREES,
                 boost_rounds: int = BOOST_ROUNDS) -> dict:
    """Fit on train, choose on validation, touch test once. A failed candidate is recorded, not fatal."""
    kept = [df.select("*", q(target).cast("double").alias("label")).persist()]
    try:
        data = kept[0]
        part = lambda s: data.where(F.col("split") == s)
        counts = {r["split"]: r["n"] for r in data.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not all(counts.get(s) for s in ("train", "validation", "test")):
            return {"status": "NOT_SUPPORTED", "reason": "a split partition is empty", "results": [], "best": None, "model": None}
        rows = sum(counts.values())
        if rows > FIT_ROWS:
            kept.append(spread_rows(data, rows, [*dict.fromkeys([*features, "label", "split"])]).persist())
            data = kept[1]
        measure, lower = ("rmse", True) if kind == "regression" else ("f1_weighted", False)
        results, best, first = [], None, None
        for place, (name, est) in enumerate(candidates(kind, counts["train"], features, seed, forest_trees, boost_rounds)):
            try:
                model = est.fit(part("train"))
                value = _score(kind, model.transform(part("validation")))[measure]
            except Exception as exc:  # noqa: BLE001
                results.append((name, place, "fit_failed", None, str(exc)[:200]))
                continue
            first = first or (name, model)
            results.append((name, place, "fitted", value, None))
            if value is not None and (best is None or (value < best[1] if lower else value > best[1])):
                best = (name, value, model)
        if best is None:
            return {"status": "FAILED", "reason": "none of the candidates could be fitted", "results": results, "best": None, "model": None}
        test = _score(kind, best[2].transform(part("test")))
        baseline = _score(kind, first[1].transform(part("test"))) if first[0] != best[0] else None
        return {"status": "READY", "reason": None, "results": results, "best": best[0], "model": best[2], "test": test, "baseline": baseline,
                "metric": measure, "counts": counts, "kind": kind, "features": features, "target": target}
    finally:
        for held in kept:
            held.unpersist()


def selection_table(spark, run: dict) -> DataFrame:
    rows = [(n, p, s, v, e, n == run["best"]) for n, p, s, v, e in run["results"]]
    return spark.createDataFrame(rows, "candidate string, place int, status string, value double, error string, selected boolean")


def feature_importance(spark, run: dict, df: DataFrame | None = None, key: str | None = None, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Coefficients, tree importance, or permutation importance of every feature, largest first. Association, not cause."""
    schema = "factor string, importance double, direction string, method string"
    model, names = run["model"], run["features"]
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(last, "coefficients") or hasattr(last, "coefficientMatrix"):
        if hasattr(last, "coefficients") and getattr(last, "numClasses", 2) <= 2:
            values = [float(v) for v in last.coefficients.toArray()]
        else:
            values = [float(v) for v in abs(last.coefficientMatrix.toArray()).mean(axis=0)]
        rows = [(n, abs(v), "positive_association" if v > 0 else "negative_association" if v < 0 else "neutral", "linear_coefficients") for n, v in zip(names, values)]
    elif hasattr(last, "featureImportances"):
        rows = [(n, float(v), None, "tree_impurity_importance") for n, v in zip(names, last.featureImportances.toArray())]
    elif df is not None and key is not None:
        rows = [(n, max(v, 0.0), None, "permutation_importance") for n, v in permutation_importance(run, df, key, repeats, seed).items()]
    else:
        return spark.createDataFrame([], schema)
    rows.sort(key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(n, round(v, 6), d, m) for n, v, d, m in rows], schema)


def permutation_importance(run: dict, df: DataFrame, key: str, repeats: int = 5, seed: int = 42) -> dict[str, float]:
    """Loss of the selection metric when one column is re-paired with other rows by seeded order."""
    from linelens.operators.split import seeded_key, with_previous

    measure, sign = run["metric"], 1.0 if run["metric"] == "rmse" else -1.0
    data = df.select("*", q(run["target"]).cast("double").alias("label"))
    base = _score(run["kind"], run["model"].transform(data))[measure]
    losses: dict[str, list[float]] = {f: [] for f in run["features"]}
    for r in range(repeats):  # one order a repeat, in which every feature is moved by itself
        keyed = data.select("*", seeded_key(seed * 1000 + r, q(key)).alias("_h"))
        shifted = materialize(with_previous(keyed, ["_h", key], run["features"]).drop("_h"))
        for f in run["features"]:
            moved = shifted.withColumn(f, q(f"_prev_{f}"))
            losses[f].append(sign * (_score(run["kind"], run["model"].transform(moved))[measure] - base))
    return {f: sum(x) / len(x) for f, x in losses.items()}


def coefficient_table(spark, run: dict) -> DataFrame | None:
    """Coefficients on standardised features and the intercept, for linear models."""
    last = run["model"].stages[-1] if isinstance(run["model"], PipelineModel) else run["model"]
    if not hasattr(last, "coefficients") or not hasattr(last, "intercept"):
        return None
    rows = [("(intercept)", round(float(last.intercept), 6))] + [(n, round(float(v), 6)) for n, v in zip(run["features"], last.coefficients.toArray())]
    return spark.createDataFrame(rows, "term string, coefficient double")


def prediction_table(run: dict, df: DataFrame, key: str, states: DataFrame | None = None) -> DataFrame:
    """Actual, predicted and residual of all test rows, with the anomaly state where there is one."""
    out = run["model"].transform(df.where("split = 'test'")).select(
        q(key), q(run["target"]).cast("double").alias("actual"), F.col("prediction").alias("predicted"))
    if run["kind"] == "regression":
        out = out.withColumn("residual", F.col("actual") - F.col("predicted"))
    return out if states is None else out.join(states.select(q(key), "anomaly_state", "anomaly_score"), key, "left")


def prediction_preview(predictions: DataFrame, key: str, rows: int) -> DataFrame:
    """The first rows of a prediction table, as many as the caller shows."""
    return predictions.orderBy(key).limit(rows)


def save_model(run: dict, root: str, dataset_id: str, model_id: str) -> DataFrame:
    """Store a fitted Spark model and its registry row under the shared folder."""
    path = f"{root}/models/{dataset_id}/{model_id}"
    run["model"].write().overwrite().save(path)
    spark = _session()
    row = spark.createDataFrame([(dataset_id, model_id, run["target"], run["best"], path)], "dataset_id string, model_id string, target string, model_type string, path string")
    row = row.withColumn("trained_at", F.current_timestamp())
    row.write.mode("append").parquet(f"{root}/model_registry")
    return row


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def list_models(spark, root: str, dataset_id: str) -> DataFrame:
    """Latest registry row per model of a dataset."""
    rows = spark.read.parquet(f"{root}/model_registry").where(F.col("dataset_id") == dataset_id)
    return rows.groupBy("model_id").agg(F.max_by(F.struct("target", "model_type", "path", "trained_at"), "trained_at").alias("s")).select("model_id", "s.*")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_models(df: DataFrame, targets: list[str], features: list[str], seed: int = 42, **limits) -> tuple[list[dict], DataFrame]:
    """Every supported target of a split input; unsupported ones go to a ledger."""
    kinds = {r["column"]: r for r in detect_target_types(df, targets).collect()}
    runs, ledger = [], []
    for t in targets:
        kind = kinds[t]["type"]
        if kind == "unsupported":
            ledger.append((t, kind, "NOT_SUPPORTED", "constant, empty or non-numeric target"))
            continue
        run = select_model(df, t, [f for f in features if f not in targets], kind, seed, **limits)
        ledger.append((t, kind, run["status"], run["reason"] or run["best"]))
        runs.append(run)
    return runs, df.sparkSession.createDataFrame(ledger, "target string, type string, status string, detail string")


# --- stored one-hidden-layer networks

def score_network(inputs: Column, net: dict) -> Column:
    """min-max in, tanh units, linear out, min-max back, as array expressions on literal weights.

    ``net``: x_offset, x_gain, x_min, b1, w1 (units x inputs), b2, w2 (outputs x units), y_offset, y_gain, y_min.
    """
    lits = lambda values: F.array(*[F.lit(float(v)) for v in values])
    x = F.transform(F.arrays_zip(inputs.alias("v"), lits(net["x_offset"]).alias("o"), lits(net["x_gain"]).alias("g")),
                    lambda s: (s["v"] - s["o"]) * s["g"] + net["x_min"])
    fold = lambda weights, values: F.aggregate(F.zip_with(lits(weights), values, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    hidden = F.array(*[2.0 / (1.0 + F.exp(-2.0 * (fold(w, x) + float(b)))) - 1.0 for w, b in zip(net["w1"], net["b1"])])
    return F.array(*[(fold(w, hidden) + float(b) - net["y_min"]) / float(g) + float(o)
                     for w, b, g, o in zip(net["w2"], net["b2"], net["y_gain"], net["y_offset"])])


def read_network(spark, path: str) -> dict:
    """Weights of a generated network function stored as text (``b1 = [..;..];`` and so on)."""
    import numpy as np

    body = spark.read.text(path, wholetext=True).first()["value"]
    row = spark.createDataFrame([(body,)], "t string")
    grab = lambda name: F.regexp_extract("t", r"(?m)^\s*" + name.replace(".", r"\.") + r"\s*=\s*\[?([^\]\n]*?)\]?;?\s*$", 1)
    names = ["x1_step1.xoffset", "x1_step1.gain", "x1_step1.ymin", "b1", "IW1_1", "b2", "LW2_1", "y1_step1.ymin", "y1_step1.gain", "y1_step1.xoffset"]
    got = row.select(*[grab(n).alias(f"v{i}") for i, n in enumerate(names)]).first()
    m = [np.array([[float(v) for v in line.split()] for line in got[f"v{i}"].rstrip(";").split(";")]) for i in range(len(names))]
    flat = lambda a: a.ravel().tolist()
    units = len(flat(m[3]))
    return {"x_offset": flat(m[0]), "x_gain": flat(m[1]), "x_min": flat(m[2])[0], "b1": flat(m[3]), "w1": m[4].reshape(units, -1).tolist(),
            "b2": flat(m[5]), "w2": m[6].reshape(-1, units).tolist(), "y_min": flat(m[7])[0], "y_gain": flat(m[8]), "y_offset": flat(m[9])}
