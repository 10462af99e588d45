"""Sources, registries, models and anomaly states."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linelens.functions.expr import q, rounded
from linelens.operators import anomaly, features, ml, split
from linelens.plans.catalog.base import H, O, hourly, meta_of, orders, query, r, union_all
from linelens.plans.catalog.causes import Y, _SC, robust_states, state_sql
from linelens.plans.catalog.inspection import _SIMPLE, simple_inspections
from linelens.session import materialize, shared_dir
from linelens.sources import archive, registry, tables
from linelens.sources import views as V
from linelens.sources.versions import VersionedRegistry


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# --- sources and sinks

@query("s1_scan_delimited", f"SELECT event_type, count(*) AS n, {r('sum(value)', 2)} AS total FROM events GROUP BY event_type", digits=2)
def s1(spark, sf):
    """The event table written as TAB-separated text and read back by the delimited scan."""
    path = _folder(spark, "s1") + ".tsv"
    V.table(spark, sf, "events").select("event_id", "event_type", "value").write.options(header=True, sep="\t").csv(path)
    df = tables.scan_delimited(spark, path)
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("s1_parse_errors", "SELECT count(*) AS bad_lines FROM events WHERE event_id % 10 = 0")
def s1_errors(spark, sf):
    """Every tenth number is replaced by text; those lines must show up in the error ledger."""
    path = _folder(spark, "s1e")
    V.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("value").cast("string")).alias("value")).write.options(header=True).csv(path)
    return tables.parse_errors(spark, path, "event_id long, value double").agg(F.count(F.lit(1)).alias("bad_lines"))


@query("s2_scan_table_set", None)
def s2(spark, sf):
    """Every file of the folder is its own table; the ledger says what happened to each."""
    found, ledger = tables.scan_table_set(spark, sf)
    sizes = spark.createDataFrame([(f"{n}.parquet", len(d.columns)) for n, d in found.items()], "file string, columns int")
    return ledger.join(F.broadcast(sizes), "file", "left").select("file", "status", "columns")


@query("s2_archive_members", f"SELECT strftime(ts, '%Y-%m-%d') || '.csv' AS member, 'READ' AS status, count(*) + 1 AS lines, count(value) AS n, {r('sum(value)', 2)} AS total, max(event_type) AS last FROM events GROUP BY 1", digits=2)
def s2_archive(spark, sf):
    """All events as a CSV member a day in four ZIP archives, read back through the archive source, beside the ledger."""
    path = _folder(spark, "s2z")
    events = V.table(spark, sf, "events").select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), "event_id", "event_type", "value")
    archive.write_archives(events, path, "day", ["event_id"], 4)
    lines = archive.archive_lines(spark, path)
    data = archive.archive_rows(lines, "event_id long, event_type string, value double")
    return archive.archive_ledger(lines, path).join(data.groupBy("member").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.max("event_type").alias("last")), "member").select(
        "member", "status", "lines", "n", "total", "last")


@query("s3_file_fingerprint", None)
def s3(spark, sf):
    return tables.fingerprints(spark, sf)


@query("s4_sniff_container", None)
def s4(spark, sf):
    return tables.sniff_containers(spark, sf)


def _inspection_file(spark, sf):
    path = _folder(spark, "s5")
    rows = simple_inspections(spark, sf).select(
        "inspection_id", F.lit(None).cast("string").alias("filename"), "decision", F.col("predicted").cast("string").alias("predicted_class"), "confidence", "anomaly", "novelty",
        F.lit(None).cast("string").alias("novelty_status"), F.timestamp_seconds(F.col("inspection_id") * 60).alias("generated_at"))
    registry.write_inspections(rows, path)
    return path


@query("s5_scan_inspections", f"{_SIMPLE} SELECT inspection_id, decision, {r('confidence')} AS confidence FROM s ORDER BY inspection_id DESC LIMIT 100")
def s5(spark, sf):
    """The newest hundred stored inspections; the limit is the listing's own."""
    return registry.list_recent(registry.scan_inspections(spark, _inspection_file(spark, sf)), "generated_at", 100).select("inspection_id", "decision", "confidence")


@query("s5_scan_all_inspections", f"{_SIMPLE} SELECT inspection_id, decision, {r('confidence')} AS confidence FROM s")
def s5_all(spark, sf):
    """Every stored inspection, read back."""
    return registry.scan_inspections(spark, _inspection_file(spark, sf)).select("inspection_id", "decision", "confidence")


@query("s5_get_inspection", f"{_SIMPLE} SELECT inspection_id, decision, {r('confidence')} AS confidence FROM s WHERE inspection_id = (SELECT max(vec_id) FROM embeddings)")
def s5_get(spark, sf):
    last = V.table(spark, sf, "embeddings").agg(F.max("vec_id").alias("m")).first()["m"]
    return registry.by_id(registry.scan_inspections(spark, _inspection_file(spark, sf)), "inspection_id", last).select("inspection_id", "decision", "confidence")


@query("s7_write_table", "SELECT count(*) AS \"rows\", count(*) AS stored_rows, false AS truncated FROM lineitem UNION ALL SELECT count(*), count(*), false FROM orders")
def s7(spark, sf):
    """A whole parquet table, and a whole CSV export."""
    whole = tables.write_table(V.table(spark, sf, "lineitem"), _folder(spark, "s7") + "/lineitem")
    capped = tables.export_csv(V.table(spark, sf, "orders"), _folder(spark, "s7") + "/orders", ["o_orderkey"])
    return whole.unionByName(capped).select("rows", "stored_rows", "truncated")


@query("s8_registry_upsert", f"SELECT o_custkey AS id, max(o_orderkey) AS stamp, {r('arg_max(o_totalprice::DOUBLE, o_orderkey)', 2)} AS payload FROM orders GROUP BY o_custkey", digits=2)
def s8(spark, sf):
    """Orders as registry versions of a customer's analysis; the newest wins."""
    rows = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("stamp"), F.col("o_totalprice").cast("double").alias("payload"))
    return registry.upsert(rows.where("stamp % 2 = 0"), rows.where("stamp % 2 <> 0"), "id", "stamp")


@query("s8_registry_versions", f"""WITH v AS (SELECT CAST(1 AS INTEGER) AS version, * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, * FROM orders)
  SELECT version, o_custkey AS id, max(o_orderkey) AS stamp, {r('arg_max(o_totalprice::DOUBLE, o_orderkey)', 2)} AS payload FROM v GROUP BY version, o_custkey""", digits=2)
def s8_versions(spark, sf):
    """The same upserts as a versioned table; the first version is read back after the second."""
    rows = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("stamp"), F.col("o_totalprice").cast("double").alias("payload"))
    table = VersionedRegistry(spark, _folder(spark, "s8v"), "id", "stamp", buckets=16)
    table.upsert(rows.where("stamp % 2 = 0"))
    table.upsert(rows.where("stamp % 2 <> 0"))
    return table.read(1).withColumn("version", F.lit(1)).unionByName(table.read(2).withColumn("version", F.lit(2)))


@query("s9_registry_latest", f"SELECT o_orderpriority AS kind, max(o_orderkey) AS stamp, {r('arg_max(o_totalprice::DOUBLE, o_orderkey)', 2)} AS payload FROM orders GROUP BY 1", digits=2)
def s9(spark, sf):
    rows = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("stamp"), F.col("o_totalprice").cast("double").alias("payload"))
    return registry.latest(rows, "kind", "stamp")


@query("s10_deterministic_id", "SELECT o_orderkey, substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus, 'low', '0.1', '42')), 1, 12) AS id FROM orders")
def s10(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select("o_orderkey", registry.analysis_id(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.lit("low"), F.lit("0.1"), F.lit("42")).alias("id"))


@query("s11_class_set_fingerprint", "WITH c AS (SELECT CAST(label AS VARCHAR) AS l, count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS classes, substr(sha256(string_agg(l || ':' || n, ';' ORDER BY l)), 1, 12) AS fingerprint FROM c")
def s11(spark, sf):
    return registry.class_fingerprint(V.table(spark, sf, "embeddings"), "label")


@query("s12_list_recent", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def s12(spark, sf):
    """The newest fifty; the limit is the listing's own."""
    return registry.list_recent(V.table(spark, sf, "orders"), "o_orderdate", 50, "o_orderkey").select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"))


# --- models

_TT = ["l_quantity", "l_linenumber", "quality_flag", "defect_class", "const_label", "l_discount"]


@query("m1_detect_target_type", """WITH t AS (SELECT l_quantity::DOUBLE AS l_quantity, l_linenumber AS l_linenumber, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS quality_flag, l_linenumber AS defect_class, 1 AS const_label, l_discount::DOUBLE AS l_discount FROM lineitem)
  SELECT * FROM (""" + union_all([f"""SELECT '{c}' AS "column", count({c}) AS n_samples, count(DISTINCT {c}) AS n_unique, {str(c in ('quality_flag', 'defect_class', 'const_label')).lower()} AS class_like_name,
   count(*) FILTER (WHERE abs({c} - round_even({c}::DOUBLE, 0)) > 1e-8 + 1e-5 * abs(round_even({c}::DOUBLE, 0))) = 0 AS integer_valued,
   CASE WHEN count(DISTINCT {c}) <= 1 THEN 'unsupported' WHEN {str(c in ('quality_flag', 'defect_class', 'const_label')).lower()} AND count(DISTINCT {c}) = 2 THEN 'binary_classification'
   WHEN {str(c in ('quality_flag', 'defect_class', 'const_label')).lower()} AND count(DISTINCT {c}) BETWEEN 3 AND 12 THEN 'multiclass_classification' ELSE 'regression' END AS type FROM t""" for c in _TT]) + ") q")
def m1(spark, sf):
    t = V.table(spark, sf, "lineitem").select(
        F.col("l_quantity").cast("double").alias("l_quantity"), "l_linenumber", F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("quality_flag"), F.col("l_linenumber").alias("defect_class"),
        F.lit(1).alias("const_label"), F.col("l_discount").cast("double").alias("l_discount"))
    return ml.detect_target_types(t, _TT)


def model_frame(spark, sf):
    df = hourly(spark, sf, True)
    rows = features.project_features(df, features.plan_features(meta_of(df))[0])
    cols = ["Demand", "utilization_mean", "utilization_spread", "queue_load_total"]
    frame = rows.select("Time_Now", *cols, Y, F.when(q(Y) > 700, 1).otherwise(0).alias("quality_pass"))
    return materialize(split.positional_split(frame, ["Time_Now"])), cols


_RUNS: dict[tuple[str, str], tuple] = {}


def hourly_run(spark, sf):
    """(frame, selection run) of the hourly throughput: all candidates at their own size, fitted once for the queries on it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        frame, cols = model_frame(spark, sf)
        _RUNS[key] = (frame, ml.select_model(frame, Y, cols, "regression"))
    return _RUNS[key]


@query("m2_candidates", None)
def m2(spark, sf):
    """Which estimators each target type would get for this input, in order."""
    _, cols = model_frame(spark, sf)
    n = orders(spark, sf).count()
    rows = [(k, p, name) for k in ("regression", "binary_classification", "multiclass_classification") for p, (name, _) in enumerate(ml.candidates(k, n, cols))]
    return spark.createDataFrame(rows, "type string, place int, candidate string")


@query("m3_select_model", None)
def m3(spark, sf):
    return ml.selection_table(spark, hourly_run(spark, sf)[1])


_PRED = "l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE * 1500 AS p"


@query("m4_regression_metrics", f"""WITH d AS (SELECT l_returnflag AS grp, {_PRED} FROM lineitem) SELECT grp, count(*) AS n, {r('avg(abs(y - p))', 2)} AS mae, {r('sqrt(avg((y - p) * (y - p)))', 2)} AS rmse,
  {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2 FROM d GROUP BY grp""")
def m4(spark, sf):
    d = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_quantity").cast("double") * 1500).alias("p"))
    out = ml.regression_metrics(d, F.col("y"), F.col("p"), ["grp"])
    return out.select("grp", "n", rounded(F.col("mae"), 2).alias("mae"), rounded(F.col("rmse"), 2).alias("rmse"), "r2")


_LP = "l_linestatus AS a, CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END AS p"
_CM = f"""WITH d AS (SELECT {_LP} FROM lineitem), t AS (SELECT a, p, count(*) AS n FROM d GROUP BY a, p), k AS (SELECT a AS c, sum(n) AS s FROM t GROUP BY a), g AS (SELECT p AS c, sum(n) AS g FROM t GROUP BY p), h AS (SELECT a AS c, n AS h FROM t WHERE a = p),
  z AS (SELECT c, coalesce(s, 0)::DOUBLE AS s, coalesce(g, 0)::DOUBLE AS g, coalesce(h, 0)::DOUBLE AS h FROM k FULL JOIN g USING (c) LEFT JOIN h USING (c)), m AS (SELECT *, CASE WHEN g > 0 THEN h / g ELSE 0 END AS pr, CASE WHEN s > 0 THEN h / s ELSE 0 END AS rc FROM z)"""


def _confusion(spark, sf):
    d = V.table(spark, sf, "lineitem")
    return ml.confusion(d, F.col("l_linestatus"), F.when(F.col("l_quantity") > 25, "O").otherwise("F"))


@query("m5_classification_metrics", f"{_CM} SELECT CAST(sum(s) AS BIGINT) AS n, {r('sum(h) / sum(s)')} AS accuracy, {r('sum(s * pr) / sum(s)')} AS precision_weighted, {r('sum(s * rc) / sum(s)')} AS recall_weighted, {r('sum(s * CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END) / sum(s)')} AS f1_weighted FROM m")
def m5(spark, sf):
    return ml.classification_metrics(_confusion(spark, sf))


@query("m5_confusion_matrix", f"WITH d AS (SELECT {_LP} FROM lineitem) SELECT a AS actual, p AS predicted, count(*) AS n FROM d GROUP BY a, p")
def m5_matrix(spark, sf):
    return _confusion(spark, sf)


@query("m6_best_by_metric", f"WITH d AS (SELECT l_returnflag AS c, sqrt(avg(pow(l_extendedprice::DOUBLE - 1500 * l_quantity::DOUBLE, 2))) AS v FROM lineitem GROUP BY l_returnflag) SELECT arg_min(c, v) AS candidate, {r('min(v)', 2)} AS \"value\" FROM d", digits=2)
def m6(spark, sf):
    d = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("candidate"), F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_quantity").cast("double") * 1500).alias("p"))
    m = ml.regression_metrics(d, F.col("y"), F.col("p"), ["candidate"])
    return ml.best_by_metric(m.select("candidate", F.ascii("candidate").alias("place"), F.lit("regression").alias("kind"), F.col("rmse").alias("value")))


@query("m7_feature_importance", None)
def m7(spark, sf):
    frame, run = hourly_run(spark, sf)
    return ml.feature_importance(spark, run, frame, "Time_Now")


@query("m8_baseline_compare", None)
def m8(spark, sf):
    """Test metrics of the chosen model beside those of the first candidate."""
    frame, run = hourly_run(spark, sf)
    rows = [(k, float(v["rmse"]), float(v["mae"])) for k, v in (("selected", run["test"]), ("baseline", run["baseline"])) if v]
    return spark.createDataFrame(rows, "model string, rmse double, mae double")


@query("m9_prediction_preview", None)
def m9(spark, sf):
    """All test rows with prediction, residual and anomaly state."""
    frame, run = hourly_run(spark, sf)
    return ml.prediction_table(run, frame, "Time_Now", robust_states(spark, sf))


@query("m10_anomaly_features", f"SELECT c AS feature FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in ['Demand', *V.HOURLY_METRICS])}) v(c) WHERE (SELECT count(*) FROM events) > 0")
def m10(spark, sf):
    found = anomaly.anomaly_features(hourly(spark, sf), [Y])
    return spark.createDataFrame([(c,) for c in found], "feature string")


@query("m11_anomaly_score", None)
def m11(spark, sf):
    """Isolation forest over all order rows; trees grow in parallel on their own samples."""
    df = orders(spark, sf, True).select("row_key", "Demand", *V.ORDER_METRICS)
    return anomaly.detect_anomalies(df, "row_key", [])[0].select("row_key", "anomaly_state", "anomaly_score")


@query("m11_robust_score", f"{state_sql()} SELECT Time_Now, anomaly_state, {r('anomaly_score')} AS anomaly_score FROM s")
def m11_robust(spark, sf):
    return robust_states(spark, sf).select("Time_Now", "anomaly_state", "anomaly_score")


@query("m11_score_percentile", f"{state_sql()}, k AS (SELECT Time_Now, row_number() OVER (ORDER BY raw, Time_Now) - 1 AS i, count(*) OVER () AS n FROM s) SELECT Time_Now, round(i / (n - 1)::DOUBLE * 100, 2) AS percentile FROM k", digits=2)
def m11_percentile(spark, sf):
    df = hourly(spark, sf, True)
    return anomaly.score_percentile(anomaly.robust_score(df, _SC), "Time_Now", "raw_score").select("Time_Now", "percentile")


_DEV = union_all([f"SELECT Time_Now, '{c}' AS feature, abs(coalesce({c}, 0) - (SELECT avg(coalesce({c}, 0)) FROM h)) / (SELECT stddev_pop(coalesce({c}, 0)) FROM h) AS z, {c} AS v FROM a" for c in _SC])


@query("m12_top_deviating_features", f"{state_sql()}, a AS (SELECT * FROM s WHERE anomaly_state = 'ANOMALOUS'), d AS ({_DEV}), k AS (SELECT *, row_number() OVER (PARTITION BY Time_Now ORDER BY z DESC, feature DESC) - 1 AS place FROM d) SELECT Time_Now, CAST(place AS INTEGER) AS place, feature, {r('z', 3)} AS abs_z FROM k WHERE place < 3", digits=3)
def m12(spark, sf):
    df = hourly(spark, sf, True)
    return anomaly.top_deviations(robust_states(spark, sf, df), df, _SC, "Time_Now").select("Time_Now", "place", "feature", "abs_z")


@query("m13_anomaly_summary", f"{state_sql()} SELECT anomaly_state, count(*) AS \"rows\", {r('min(anomaly_score)')} AS score_min, {r('max(anomaly_score)')} AS score_max FROM s GROUP BY anomaly_state")
def m13(spark, sf):
    return anomaly.anomaly_summary(robust_states(spark, sf))


@query("m14_model_registry", None)
def m14(spark, sf):
    """Save, list, load, and score again with the loaded model."""
    frame, run = hourly_run(spark, sf)
    root = _folder(spark, "models")
    ml.save_model(run, root, "demo", "hourly_throughput")
    row = ml.list_models(spark, root, "demo").first()
    again = ml.load_model(row["path"]).transform(frame.where("split = 'test'"))
    return again.agg(F.count(F.lit(1)).alias("scored")).select(F.lit(row["model_id"]).alias("model_id"), F.lit(row["model_type"]).alias("model_type"), "scored")


@query("m15_ml_run", None)
def m15(spark, sf):
    """Every target of the input: a regression, a classification, and one that is refused."""
    frame, cols = model_frame(spark, sf)
    frame = frame.withColumn("const_target", F.lit(1.0))
    return ml.run_models(frame, [Y, "quality_pass", "const_target"], cols)[1]


# weights of the network: the first 31 numbers of the first embedding
_NET = "(SELECT list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings ORDER BY vec_id LIMIT 1)"


@query("m16_mlp_batch_score", f"""WITH n AS {_NET}, x AS (SELECT o_orderkey, (o_totalprice::DOUBLE - 1000) * 0.00001::DOUBLE - 1 AS x FROM orders),
  a AS (SELECT o_orderkey, list_transform(range(1, 11), lambda k: 2 / (1 + exp(-2 * (w[10 + k] * x + w[k]))) - 1) AS h, w FROM x, n)
  SELECT o_orderkey, {r('(list_sum(list_transform(range(1, 11), lambda k: w[20 + k] * h[k])) + w[31] + 1) / 0.5 + 10')} AS score FROM a""")
def m16(spark, sf):
    w = [float(v) for v in V.table(spark, sf, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]]
    net = {"x_offset": [1000.0], "x_gain": [0.00001], "x_min": -1.0, "b1": w[0:10], "w1": [[v] for v in w[10:20]], "b2": [w[30]], "w2": [w[20:30]], "y_offset": [10.0], "y_gain": [0.5], "y_min": -1.0}
    o = V.table(spark, sf, "orders")
    return o.select("o_orderkey", F.get(ml.score_network(F.array(F.col("o_totalprice").cast("double")), net), F.lit(0)).alias("score"))
