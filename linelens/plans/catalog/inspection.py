"""Inspection decisions, files, review, investigations and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import argmax, distance, softmax
from linelens.operators import files, inspect, investigate, review
from linelens.operators.split import seeded_key
from linelens.plans.catalog.base import I, query, r, union_all
from linelens.session import materialize, shared_dir
from linelens.sources import views as V
from linelens.streaming import stream

TEMPERATURE = 4.0


def inputs(spark, sf, keep=False):
    df = V.inspection_inputs(spark, sf)
    return materialize(df) if keep else df


_SOFT = "list_transform(logits, lambda x: exp((x - list_max(logits)) / {t}) )"
_PROB = f"""{I}, e AS (SELECT *, {_SOFT.format(t=TEMPERATURE)} AS ex, {_SOFT.format(t=1.0)} AS er FROM i), p AS (SELECT inspection_id, label, logits, embedding, list_transform(ex, lambda x: x / list_sum(ex)) AS probability,
  list_transform(er, lambda x: x / list_sum(er)) AS raw FROM e), c AS (SELECT *, list_max(probability) AS confidence, list_position(probability, list_max(probability)) - 1 AS predicted FROM p)"""


def scored(spark, sf, keep=False):
    return inspect.probabilities(inputs(spark, sf, keep), TEMPERATURE)


@query("v3_softmax", f"{_PROB} SELECT inspection_id, CAST(predicted AS INTEGER) AS predicted, {r('confidence')} AS confidence, {r('raw[predicted + 1]')} AS raw_confidence, CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MODERATE' ELSE 'LOW' END AS confidence_level FROM c")
def v3(spark, sf):
    return scored(spark, sf).select("inspection_id", "predicted", "confidence", "raw_confidence", "confidence_level")


_NLL = "avg(-ln(greatest(least(list_transform(logits, lambda x: exp((x - list_max(logits)) / exp(g.t)))[label + 1] / list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / exp(g.t)))), 1.0), 1e-12)))"


@query("v2_temperature_fit", f"""{I}, g AS (SELECT round(-2 + 0.1 * k, 4)::DOUBLE AS t FROM range(41) z(k)), a AS (SELECT g.t, {_NLL} AS nll FROM i, g GROUP BY g.t), b AS (SELECT arg_min(t, (nll, t)) AS t0 FROM a),
  g2 AS (SELECT DISTINCT round(least(greatest(t0 + 0.01 * (k - 10), -2.0), 2.0), 4)::DOUBLE AS t FROM b, range(21) z(k)), a2 AS (SELECT g.t, {_NLL} AS nll FROM i, g2 g GROUP BY g.t)
  SELECT {r('arg_min(t, (nll, t))', 3)} AS log_temperature, {r('exp(arg_min(t, (nll, t)))', 3)} AS temperature, {r('min(nll)', 3)} AS nll FROM a2""", digits=3)
def v2(spark, sf):
    return inspect.fit_temperature(inputs(spark, sf, True))


@query("v1_classify_embeddings", None)
def v1(spark, sf):
    """Logistic head fitted on four fifths of the embeddings, applied to all of them."""
    df = inputs(spark, sf, True)
    model = inspect.fit_classifier(df.where("inspection_id % 5 <> 0"))
    return inspect.probabilities(inspect.classify(model, df), 1.0).select("inspection_id", "label", "predicted", "confidence", "confidence_level")


_DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_CENT = "u AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS d FROM i), m AS (SELECT label, d, avg(v) AS v FROM u GROUP BY label, d), ce AS (SELECT label AS cl, list(v ORDER BY d) AS ct FROM m GROUP BY label)"
_NOVEL = f"""{_PROB}, {_CENT}, own AS (SELECT cl, {_DIST.format(a='embedding', b='ct')} AS d FROM i JOIN ce ON ce.cl = i.label), sz AS (SELECT cl, count(*) AS n FROM own GROUP BY cl),
  q AS (SELECT c.inspection_id, c.label, c.confidence, c.predicted, ce.cl, {_DIST.format(a='c.embedding', b='ce.ct')} AS d FROM c JOIN ce ON ce.cl = c.predicted),
  nv AS (SELECT q.*, (SELECT count(*) FROM own WHERE own.cl = q.cl AND own.d < q.d)::DOUBLE / sz.n AS novelty FROM q JOIN sz ON sz.cl = q.cl)"""


@query("v5_class_novelty", f"{_NOVEL} SELECT inspection_id, {r('d')} AS class_distance, {r('novelty')} AS novelty, CASE WHEN novelty > 0.99 THEN 'HIGH' ELSE 'NORMAL' END AS novelty_status FROM nv")
def v5(spark, sf):
    rows = scored(spark, sf, True)
    return inspect.class_novelty(rows, rows).select("inspection_id", "class_distance", "novelty", "novelty_status")


@query("v5_class_distances", f"{I}, {_CENT} SELECT i.inspection_id, ce.cl AS class, {r(_DIST.format(a='i.embedding', b='ce.ct'))} AS distance FROM i, ce")
def v5_distances(spark, sf):
    df = inputs(spark, sf, True)
    out = inspect.class_distances(df, inspect.centroids(df))
    return out.select("inspection_id", F.explode("class_distances").alias("s")).select("inspection_id", F.col("s.class").alias("class"), "s.distance")


@query("v4_mahalanobis_percentile", None)
def v4(spark, sf):
    """Two thirds of the normal class fit the reference, the rest gives the distance distribution."""
    df = inputs(spark, sf, True)
    normal = df.where("label = 0")
    hold = F.conv(F.substring(seeded_key(42, F.col("inspection_id")), 1, 4), 16, 10).cast("int") % 3 == 0
    out = inspect.anomaly_percentile(df, normal.where(~hold), normal.where(hold))
    return out.select("inspection_id", "label", "mahalanobis", "anomaly")


@query("v6_feature_space_2d", None)
def v6(spark, sf):
    _, cloud, _ = inspect.feature_space(inputs(spark, sf, True))
    return cloud


def decided(spark, sf):
    rows = scored(spark, sf, True)
    none = F.lit(None).cast("double")
    return inspect.decide(inspect.class_novelty(rows, rows).withColumn("anomaly", none)), rows


_DEC = f"""{_NOVEL}, dd AS (SELECT *, CASE WHEN predicted = 0 THEN CASE WHEN confidence >= 0.8 THEN 'PASS' ELSE 'REVIEW' END ELSE CASE WHEN confidence >= 0.7 AND novelty <= 0.99 THEN 'DEFECT' ELSE 'REVIEW' END END AS decision,
  concat_ws('; ', CASE WHEN predicted = 0 AND confidence < 0.8 THEN 'confidence below the pass threshold' END, CASE WHEN predicted <> 0 AND novelty > 0.99 THEN 'novelty above the review gate' END,
  CASE WHEN predicted <> 0 AND confidence < 0.7 THEN 'confidence below the defect threshold' END) AS reasons FROM nv)"""


@query("v7_decision", f"{_DEC} SELECT inspection_id, decision, reasons FROM dd")
def v7(spark, sf):
    return decided(spark, sf)[0].select("inspection_id", "decision", F.array_join("review_reasons", "; ").alias("reasons"))


@query("v8_decision_matrix", f"{_DEC} SELECT CASE WHEN label = 0 THEN 'normal' ELSE 'defective' END AS actual, count(*) FILTER (WHERE decision = 'PASS') AS pass, count(*) FILTER (WHERE decision = 'DEFECT') AS defect, count(*) FILTER (WHERE decision = 'REVIEW') AS review FROM dd GROUP BY 1")
def v8(spark, sf):
    return inspect.decision_matrix(decided(spark, sf)[0])


@query("v8_decision_rates", f"""{_DEC} SELECT count(*) AS n, {r("(count(*) FILTER (WHERE label <> 0 AND decision = 'PASS'))::DOUBLE / count(*) FILTER (WHERE label <> 0)")} AS false_accept_rate,
  {r("(count(*) FILTER (WHERE label = 0 AND decision = 'DEFECT'))::DOUBLE / count(*) FILTER (WHERE label = 0)")} AS false_reject_rate, {r("(count(*) FILTER (WHERE decision = 'REVIEW'))::DOUBLE / count(*)")} AS review_rate FROM dd""")
def v8_rates(spark, sf):
    return inspect.decision_rates(decided(spark, sf)[0])


_BQ = f"""{_DEC}, k AS (SELECT count(*) FILTER (WHERE label <> 0 AND decision = 'DEFECT') AS tp, count(*) FILTER (WHERE label = 0 AND decision = 'PASS') AS tn, count(*) FILTER (WHERE label = 0 AND decision = 'DEFECT') AS fp,
  count(*) FILTER (WHERE label <> 0 AND decision = 'PASS') AS fn, count(*) FILTER (WHERE decision = 'REVIEW') AS rv, count(*) AS n, avg(confidence) AS c FROM dd), z AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS pr, tp::DOUBLE / nullif(tp + fn, 0) AS rc FROM k)
  SELECT tp, tn, fp, fn, {r('fn::DOUBLE / nullif(fn + tn, 0)')} AS escape_rate, {r('fp::DOUBLE / nullif(fp + tp, 0)')} AS overkill_rate, {r('pr')} AS precision, {r('rc')} AS recall, {r('CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) END')} AS f1,
  {r('rv::DOUBLE / n')} AS review_rate, {r('c')} AS avg_confidence FROM z"""


@query("v11_batch_quality", _BQ)
def v11(spark, sf):
    return inspect.batch_quality(decided(spark, sf)[0])


@query("j10_ground_truth_join", f"{_DEC} SELECT inspection_id, decision, CASE WHEN label = 0 THEN 'normal' ELSE 'defect_' || CAST(label AS VARCHAR) END AS ground_truth FROM dd WHERE inspection_id % 10 <> 3")
def j10(spark, sf):
    done, rows = decided(spark, sf)
    folder = F.when(F.col("label") == 0, "normal").otherwise(F.concat(F.lit("defect_"), F.col("label").cast("string")))
    images = rows.select("inspection_id", F.when(F.col("inspection_id") % 10 != 3, folder).alias("class_folder"))
    return inspect.ground_truth_join(done, images).select("inspection_id", "decision", "ground_truth")


# --- files built from document texts: a PNG head whose size depends on the id, then the text

_EXT = "CASE doc_id % 7 WHEN 0 THEN 'csv' WHEN 1 THEN 'bmp' ELSE 'png' END"
_CLS = "CASE WHEN doc_id % 11 = 0 THEN '' WHEN lang = 'en' THEN 'normal/' ELSE 'scratch_' || lang || '/' END"


def file_rows(spark, sf):
    d = V.table(spark, sf, "documents")
    side = F.lpad(F.hex((F.col("doc_id") % 20) + 2), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), side, side))
    broken = F.col("doc_id") % 13 == 0
    name = F.concat(F.expr(_CLS), F.col("doc_id").cast("string"), F.lit("."), F.expr(_EXT))
    return d.select(F.col("doc_id").alias("position"), name.alias("original_name"), F.when(broken, F.encode("text", "UTF-8")).otherwise(F.concat(head, F.encode("text", "UTF-8"))).alias("content"))


_FILES = f"""WITH f AS (SELECT doc_id AS position, ({_CLS}) || CAST(doc_id AS VARCHAR) || '.' || ({_EXT}) AS name, CASE WHEN doc_id % 11 <> 0 THEN replace({_CLS}, '/', '') END AS class_folder, doc_id % 20 + 2 AS side, doc_id % 13 = 0 AS broken,
    text, CASE WHEN doc_id % 7 = 0 THEN 'unsupported' WHEN doc_id % 13 = 0 OR doc_id % 20 + 2 < 8 THEN 'invalid' ELSE 'valid' END AS s0 FROM documents),
  g AS (SELECT *, CASE WHEN s0 = 'valid' AND row_number() OVER (PARTITION BY s0, side, text ORDER BY position) > 1 THEN 'duplicate' ELSE s0 END AS status FROM f)"""


@query("v9_validate_files", f"{_FILES} SELECT position, status, CASE WHEN NOT broken THEN side END AS width, CASE WHEN NOT broken THEN 'PNG' END AS format, class_folder FROM g")
def v9(spark, sf):
    return files.validate_files(file_rows(spark, sf)).select("position", "status", "width", "format", "class_folder")


# heads of three more forms around document texts: JPEG with two segments before its frame, TIFF in both byte
# orders with the size third and fourth, WEBP lossy, lossless and extended; every ninth file is cut inside its head

_SIDES = "doc_id % 400 + 2 AS w, doc_id % 300 + 4 AS h"
_FORM = "doc_id % 6"


def head_rows(spark, sf):
    """position, original_name, content: form doc_id % 6, width doc_id % 400 + 2, height doc_id % 300 + 4."""
    d = V.table(spark, sf, "documents").where("doc_id IS NOT NULL")
    w, h, text = F.col("doc_id") % 400 + 2, F.col("doc_id") % 300 + 4, F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    big = lambda x, n: F.lpad(F.hex(x.cast("long")), 2 * n, "0")
    little = lambda x, n: F.concat(*[F.substring(big(x, n), 2 * (n - k) - 1, 2) for k in range(n)])
    entry = lambda tag, kind, x, put: F.concat(put(F.lit(tag), 2), put(F.lit(kind), 2), put(F.lit(1), 4), put(x, 2) if kind == 3 else put(x, 4), F.lit("0000" if kind == 3 else ""))
    tiff = lambda put, mark: F.concat(F.lit(mark), put(F.lit(14), 4), F.lit("ABCDEFABCDEF"), put(F.lit(4), 2), entry(254, 4, F.lit(0), put), entry(255, 3, F.lit(1), put), entry(256, 3, w, put), entry(257, 4, h, put))
    webp = lambda chunk, body: F.concat(F.lit("52494646"), F.lit("00010000"), F.lit("57454250" + chunk + "40000000"), body)
    packed = (w - 1) + (h - 1) * 16384
    forms = [
        F.concat(F.lit("FFD8FFE00006AABBCCDDFFFFFE0005C0FFC0FFC20011" + "08"), big(h, 2), big(w, 2)),
        tiff(little, "49492A00"), tiff(big, "4D4D002A"),
        webp("56503820", F.concat(F.lit("0000009D012A"), little(w, 2), little(h + 16384, 2))),
        webp("5650384C", F.concat(F.lit("2F"), little(packed, 4))),
        webp("56503858", F.concat(F.lit("00000000"), little(w - 1, 3), little(h - 1, 3)))]
    head = F.get(F.array(*forms), (F.col("doc_id") % 6).cast("int"))
    cut = F.when(F.col("doc_id") % 9 == 0, F.substring(head, 1, 24)).otherwise(F.concat(head, text))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), F.get(F.array(*[F.lit(x) for x in ("jpg", "tif", "tiff", "webp", "webp", "webp")]), (F.col("doc_id") % 6).cast("int")))
    return d.select(F.col("doc_id").alias("position"), name.alias("original_name"), F.unhex(cut).alias("content"))


@query("v9_image_sizes", f"""WITH f AS (SELECT doc_id AS position, {_SIDES}, doc_id % 9 = 0 AS cut, {_FORM} AS k, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
  g AS (SELECT *, CASE WHEN cut OR w < 8 OR h < 8 THEN 'invalid' ELSE 'valid' END AS s0 FROM f)
  SELECT position, CASE WHEN s0 = 'valid' AND row_number() OVER (PARTITION BY s0, k, w, h, text ORDER BY position) > 1 THEN 'duplicate' ELSE s0 END AS status, CASE WHEN cut THEN 'unreadable image' WHEN s0 = 'invalid' THEN 'image too small' END AS reason,
  CASE WHEN NOT cut THEN w END AS width, CASE WHEN NOT cut THEN h END AS height, CASE WHEN k = 0 THEN 'JPEG' WHEN k < 3 THEN 'TIFF' ELSE 'WEBP' END AS format FROM g""")
def v9_sizes(spark, sf):
    """Sizes from JPEG, TIFF and WEBP heads over whole files; copies are told apart by content."""
    out = files.validate_files(head_rows(spark, sf))
    return out.select("position", "status", F.when(F.col("status") != "duplicate", F.col("reason")).alias("reason"), "width", "height", "format")


@query("v10_batch_summary", f"""{_FILES}, c AS (SELECT class_folder, count(*) AS n FROM g WHERE class_folder IS NOT NULL GROUP BY class_folder) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'valid') AS valid, count(*) FILTER (WHERE status = 'invalid') AS invalid,
  count(*) FILTER (WHERE status = 'unsupported') AS unsupported, count(*) FILTER (WHERE status = 'duplicate') AS duplicate, (SELECT count(*) FROM c) AS classes, (SELECT count(*) > 0 FROM c) AS labels_available,
  (SELECT CASE WHEN count(*) = 0 THEN 'NOT_APPLICABLE' WHEN count(*) = 1 OR max(n) <= 4 * min(n) THEN 'BALANCED' ELSE 'IMBALANCED' END FROM c) AS class_balance FROM g""")
def v10(spark, sf):
    return files.batch_summary(files.validate_files(file_rows(spark, sf)))


_PATH = "CASE doc_id % 3 WHEN 0 THEN 'train/' WHEN 1 THEN 'test/' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN 'misc/' WHEN lang = 'en' THEN 'Good/' ELSE 'dent_' || lang || '/' END || CASE WHEN doc_id % 17 = 0 THEN 'mask_' ELSE 'img_' END || CAST(doc_id AS VARCHAR(32)) || CASE doc_id % 7 WHEN 0 THEN '.csv' WHEN 1 THEN '.JPG' ELSE '.png' END"


def path_rows(spark, sf):
    return V.table(spark, sf, "documents").select(F.expr(_PATH.replace("VARCHAR(32)", "STRING")).alias("path"), F.length(F.encode("text", "UTF-8")).cast("long").alias("length"))


_PSQL = f"WITH p AS (SELECT doc_id, {_PATH} AS path, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN lang = 'en' THEN 'Good' ELSE 'dent_' || lang END AS c, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' END AS s FROM documents WHERE doc_id % 7 <> 0)"


@query("s6_scan_binary_labelled", f"{_PSQL} SELECT path, c AS class_folder, s AS split_folder FROM p")
def s6(spark, sf):
    """Class and split folder from the path parts (file names built from the document table)."""
    p = F.col("path")
    rows = path_rows(spark, sf).where(files.suffix_of(p).isin(fixed.IMAGE_SUFFIXES))
    return rows.select("path", files.class_folder(p).alias("class_folder"), files.split_folder(p).alias("split_folder"))


@query("v12_folder_profile", f"""{_PSQL}, k AS (SELECT c, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY c) SELECT CAST(count(*) AS BIGINT) AS image_count, (SELECT count(*) FROM k) AS class_folders, (SELECT min(n) FROM k) AS smallest_class,
  CAST(count(*) FILTER (WHERE c = 'Good') AS BIGINT) AS normal_count, CAST(count(*) FILTER (WHERE c <> 'Good') AS BIGINT) AS defect_count, CAST(count(s) AS BIGINT) AS in_split, CAST(count(*) FILTER (WHERE doc_id % 17 = 0) AS BIGINT) AS masks,
  (SELECT count(*) >= 2 AND min(n) >= 10 FROM k) AS classification, count(*) FILTER (WHERE c = 'Good') >= 20 AS anomaly_detection, count(*) FILTER (WHERE doc_id % 17 = 0) > 0 AS localization FROM p""")
def v12(spark, sf):
    return files.folder_profile(path_rows(spark, sf))


@query("v12_vision_status", f"{_PSQL}, k AS (SELECT c, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY c) SELECT count(*) AS image_count, 'PROFILED' AS status, concat_ws(', ', CASE WHEN (SELECT count(*) >= 2 AND min(n) >= 10 FROM k) THEN 'classification' END, CASE WHEN count(*) FILTER (WHERE c = 'Good') >= 20 THEN 'anomaly_detection' END, CASE WHEN count(*) FILTER (WHERE doc_id % 17 = 0) > 0 THEN 'localization' END) AS supported FROM p")
def v12_status(spark, sf):
    return files.vision_status(files.folder_profile(path_rows(spark, sf)))


_AK = """CASE doc_id % 6 WHEN 0 THEN 'a/instances_' || doc_id || '.json' WHEN 1 THEN 'b/' || doc_id || '.xml' WHEN 2 THEN 'labels/' || doc_id || '.txt' WHEN 3 THEN 'c/mask_' || doc_id || '.png' WHEN 4 THEN 'd' || doc_id || '/metadata.csv' ELSE 'e/' || doc_id || '.md' END"""
_AC = """CASE doc_id % 6 WHEN 0 THEN CASE WHEN doc_id % 4 = 0 THEN '{"images": [], "annotations": [], "n": ' || doc_id || '}' ELSE '{"images": []}' END WHEN 1 THEN CASE WHEN doc_id % 4 = 1 THEN '<annotation><n>' || doc_id || '</n></annotation>' ELSE '<html/>' END ELSE text END"""


@query("v13_annotation_inventory", """SELECT kind, count(*) AS files FROM (SELECT CASE WHEN doc_id % 6 = 0 AND doc_id % 4 = 0 THEN 'coco_json' WHEN doc_id % 6 = 1 AND doc_id % 4 = 1 THEN 'voc_xml' WHEN doc_id % 6 = 2 THEN 'yolo_labels'
  WHEN doc_id % 6 = 3 THEN 'mask' WHEN doc_id % 6 = 4 THEN 'metadata' END AS kind FROM documents) q WHERE kind IS NOT NULL GROUP BY kind""")
def v13(spark, sf):
    d = V.table(spark, sf, "documents")
    return files.annotation_inventory(d.select(F.expr(_AK).alias("path"), F.expr(_AC).alias("content")))


@query("v14_interleave_order", """WITH i AS (SELECT CASE WHEN label = 0 THEN 'normal' ELSE 'defect_' || label END AS c, lpad(CAST(vec_id AS VARCHAR), 8, '0') || '.png' AS name FROM embeddings),
  d AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS turn FROM (SELECT DISTINCT c FROM i WHERE c <> 'normal')), k AS (SELECT count(*) AS n FROM d), t AS (SELECT count(*) AS n FROM i WHERE c <> 'normal'),
  r AS (SELECT i.c, i.name, row_number() OVER (PARTITION BY i.c ORDER BY i.name) - 1 AS rk FROM i),
  s AS (SELECT r.c, r.name, CASE WHEN r.c = 'normal' THEN rk // 2 ELSE rk * k.n + d.turn END AS step, CASE WHEN r.c = 'normal' THEN 1 + rk % 2 ELSE 0 END AS slot FROM r LEFT JOIN d ON d.c = r.c, k),
  w AS (SELECT s.*, c = 'normal' OR step < t.n AS inside FROM s, t)
  SELECT CAST(row_number() OVER (ORDER BY NOT inside, step, slot, name) - 1 AS BIGINT) AS frame, c AS class_folder, name AS original_name, inside AS within_rotation FROM w""")
def v14(spark, sf):
    e = V.table(spark, sf, "embeddings")
    folder = F.when(F.col("label") == 0, "normal").otherwise(F.concat(F.lit("defect_"), F.col("label").cast("string")))
    return inspect.interleave(e.select(folder.alias("class_folder"), F.concat(F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".png")).alias("original_name")))


# --- review

_ACT = "CASE vec_id % 4 WHEN 0 THEN 'confirm_defect' WHEN 1 THEN 'mark_pass' WHEN 2 THEN 'keep_in_review' ELSE 'escalate' END"


def simple_inspections(spark, sf):
    """Decisions from the confidence gate alone."""
    none = F.lit(None).cast("double")
    return inspect.decide(scored(spark, sf).withColumn("anomaly", none).withColumn("novelty", none))


def requests(spark, sf):
    e = V.table(spark, sf, "embeddings")
    first = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("inspection_id"), F.expr(_ACT).alias("action"), F.lit(1).alias("at"))
    second = e.where("vec_id % 9 = 0").select(F.col("vec_id").alias("inspection_id"), F.lit("mark_pass").alias("action"), F.lit(2).alias("at"))
    wrong = e.where("vec_id % 50 = 1").select(F.col("vec_id").alias("inspection_id"), F.lit("delete").alias("action"), F.lit(1).alias("at"))
    unknown = e.where("vec_id % 50 = 2").select((-F.col("vec_id")).alias("inspection_id"), F.lit("mark_pass").alias("action"), F.lit(1).alias("at"))
    return first.unionByName(second).unionByName(wrong).unionByName(unknown)


_SIMPLE = f"{_PROB}, s AS (SELECT inspection_id, label, confidence, CASE WHEN predicted = 0 THEN CASE WHEN confidence >= 0.8 THEN 'PASS' ELSE 'REVIEW' END ELSE CASE WHEN confidence >= 0.7 THEN 'DEFECT' ELSE 'REVIEW' END END AS decision FROM c)"
_REV = f"""{_SIMPLE}, a AS (SELECT vec_id AS inspection_id, {_ACT} AS action, 1 AS seq FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 'mark_pass', 2 FROM embeddings WHERE vec_id % 9 = 0),
  h AS (SELECT *, CASE action WHEN 'confirm_defect' THEN 'DEFECT' WHEN 'mark_pass' THEN 'PASS' WHEN 'keep_in_review' THEN 'REVIEW' ELSE 'ESCALATED' END AS human_decision FROM a),
  l AS (SELECT inspection_id, arg_max(human_decision, seq) AS human_decision, arg_max(action, seq) AS action FROM h GROUP BY inspection_id)"""


@query("h1_record_review", f"""{_REV}, ok AS (SELECT h.inspection_id, h.action, h.human_decision, s.decision AS ai_decision, CAST(NULL AS VARCHAR) AS reason FROM h JOIN s USING (inspection_id))
  SELECT * FROM ok UNION ALL SELECT vec_id, 'delete', NULL, NULL, 'INVALID_REVIEW_ACTION' FROM embeddings WHERE vec_id % 50 = 1 UNION ALL
  SELECT -vec_id, 'mark_pass', NULL, NULL, 'INSPECTION_NOT_FOUND' FROM embeddings WHERE vec_id % 50 = 2""")
def h1(spark, sf):
    good, bad = review.record_review(simple_inspections(spark, sf), requests(spark, sf))
    return good.select("inspection_id", "action", "human_decision", "ai_decision", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("inspection_id", "action", F.lit(None).cast("string").alias("human_decision"), F.lit(None).cast("string").alias("ai_decision"), "reason"))


def reviews(spark, sf):
    return review.record_review(simple_inspections(spark, sf), requests(spark, sf))[0]


@query("h2_review_queue", f"{_REV} SELECT s.inspection_id, {r('confidence')} AS confidence, l.action FROM s LEFT JOIN l USING (inspection_id) WHERE decision = 'REVIEW' AND (human_decision IS NULL OR human_decision = 'REVIEW') ORDER BY s.inspection_id LIMIT 100")
def h2(spark, sf):
    """The oldest hundred open reviews: the limit is the queue's own."""
    return review.review_queue(simple_inspections(spark, sf), reviews(spark, sf)).select("inspection_id", "confidence", "action")


@query("h3_review_stats", f"""{_REV}, j AS (SELECT s.*, coalesce(human_decision <> 'REVIEW', false) AS settled FROM s LEFT JOIN l USING (inspection_id)) SELECT count(*) AS total, count(*) FILTER (WHERE decision <> 'REVIEW') AS auto_resolved,
  count(*) FILTER (WHERE decision = 'REVIEW' AND settled) AS human_reviewed, count(*) FILTER (WHERE decision = 'REVIEW' AND NOT settled) AS pending_review, {r("count(*) FILTER (WHERE decision <> 'REVIEW')::DOUBLE / count(*)")} AS auto_resolved_rate,
  {r("count(*) FILTER (WHERE decision = 'REVIEW' AND settled)::DOUBLE / count(*)")} AS human_review_rate, {r("count(*) FILTER (WHERE decision = 'REVIEW' AND NOT settled)::DOUBLE / count(*)")} AS pending_review_rate,
  count(*) FILTER (WHERE decision = 'PASS') AS pass, count(*) FILTER (WHERE decision = 'DEFECT') AS defect, count(*) FILTER (WHERE decision = 'REVIEW') AS review, {r('avg(confidence)')} AS avg_confidence FROM j""")
def h3(spark, sf):
    return review.review_stats(simple_inspections(spark, sf), reviews(spark, sf))


# --- investigations: a third of the inspections without a dataset, the others on one of two

def inspection_rows(spark, sf):
    none = F.lit(None).cast("double")
    return simple_inspections(spark, sf).select(
        "inspection_id", F.when(F.col("inspection_id") % 3 == 1, "plant_a").when(F.col("inspection_id") % 3 == 2, "plant_b").alias("dataset_id"), "decision", F.col("predicted").alias("predicted_class"),
        "confidence", none.alias("anomaly_score"), none.alias("novelty_score"), F.when(F.col("inspection_id") % 10 == 0, "HIGH").otherwise("NORMAL").alias("novelty_status"),
        (F.col("inspection_id") % 2 == 0).alias("localized"), F.lit(None).cast("string").alias("filename"))


def context(spark, sf):
    """Stored analyses: plant_a is complete, plant_b failed its root cause and has no assumptions. Counts come from the tables."""
    n = V.table(spark, sf, "events").select("event_type").distinct().count()
    return spark.createDataFrame([("plant_a", True, "complete", n, "complete", "click", 5, 100.0, 2, 3), ("plant_b", True, "FAILED", 0, None, None, 0, None, 0, 0)], investigate.CONTEXT)


_STAGES = {  # stage -> status per dataset (none, plant_a, plant_b); the first four depend on the inspection
    "process_correlation": ("DATA_GAP", "PARTIAL", "PARTIAL"), "root_cause": ("DATA_GAP", "COMPLETE", "FAILED"), "bottleneck": ("DATA_GAP", "COMPLETE", "DATA_GAP"),
    "impact": ("DATA_GAP", "COMPLETE", "AWAITING_INPUT"), "what_if": ("DATA_GAP", "COMPLETE", "AWAITING_INPUT"), "recommendation": ("DATA_GAP", "COMPLETE", "DATA_GAP")}
_ST_CASE = "CASE stage WHEN 'received' THEN 'COMPLETE' WHEN 'classifying' THEN 'COMPLETE' WHEN 'localizing' THEN CASE WHEN inspection_id % 2 = 0 THEN 'COMPLETE' ELSE 'DATA_GAP' END WHEN 'checking_robustness' THEN CASE WHEN inspection_id % 10 = 0 OR decision = 'REVIEW' THEN 'REVIEW' ELSE 'COMPLETE' END " + " ".join(
    f"WHEN '{s}' THEN CASE inspection_id % 3 WHEN 1 THEN '{a}' WHEN 2 THEN '{b}' ELSE '{n}' END" for s, (n, a, b) in _STAGES.items()) + " END"
_INV = f"{_SIMPLE}, sg AS (SELECT CAST(u - 1 AS INTEGER) AS position, {investigate.STAGES}[u] AS stage FROM range(1, 11) z(u)), v AS (SELECT s.inspection_id, s.decision, sg.position, sg.stage, {_ST_CASE} AS status FROM s, sg)"


@query("i1_investigation_stages", f"{_INV} SELECT inspection_id, position, stage, status FROM v")
def i1(spark, sf):
    return investigate.stage_rows(investigate.investigate(inspection_rows(spark, sf), context(spark, sf))).select("inspection_id", "position", "stage", "status")


@query("i2_investigation_status", f"""{_INV} SELECT inspection_id, CASE WHEN any_value(decision) = 'REVIEW' THEN 'REVIEW_REQUIRED' WHEN inspection_id % 3 = 0 THEN 'DATA_GAP' WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
  CAST(count(*) FILTER (WHERE status IN ('COMPLETE', 'REVIEW')) AS INTEGER) AS stages_complete, CAST(count(*) FILTER (WHERE status = 'DATA_GAP') AS INTEGER) AS stages_data_gap, CAST(count(*) FILTER (WHERE status = 'AWAITING_INPUT') AS INTEGER) AS stages_awaiting,
  CAST(count(*) FILTER (WHERE status = 'FAILED') AS INTEGER) AS stages_failed, CAST(count(*) FILTER (WHERE status = 'PARTIAL') AS INTEGER) AS stages_partial FROM v GROUP BY inspection_id""")
def i2(spark, sf):
    return investigate.investigate(inspection_rows(spark, sf), context(spark, sf)).select(
        "inspection_id", "status", "stages_complete", "stages_data_gap", "stages_awaiting", "stages_failed", "stages_partial")


_SUF = "CASE WHEN status IN ('COMPLETE', 'REVIEW') THEN stage || '_complete' WHEN status = 'DATA_GAP' THEN stage || '_data_gap' WHEN status = 'AWAITING_INPUT' THEN stage || '_awaiting_input' WHEN status = 'FAILED' THEN stage || '_failed' END"


@query("i3_event_feed", f"""{_INV}, ev AS (SELECT inspection_id, {_SUF} AS type FROM v WHERE position > 3 UNION ALL SELECT inspection_id, unnest(['inspection_completed', 'investigation_triggered']) FROM s
  UNION ALL SELECT inspection_id, 'defect_detected' FROM s WHERE decision = 'DEFECT' UNION ALL SELECT inspection_id, 'review_required' FROM s WHERE decision = 'REVIEW') SELECT inspection_id, type FROM ev WHERE type IS NOT NULL""")
def i3(spark, sf):
    return investigate.event_feed(investigate.investigate(inspection_rows(spark, sf), context(spark, sf))).select("inspection_id", "type")


@query("i4_replay", f"{_INV} SELECT position, stage, status FROM v WHERE inspection_id = (SELECT max(vec_id) FROM embeddings)")
def i4(spark, sf):
    last = V.table(spark, sf, "embeddings").agg(F.max("vec_id").alias("m")).first()["m"]
    return investigate.replay(investigate.investigate(inspection_rows(spark, sf), context(spark, sf)), last).select("position", "stage", "status")


# --- streams: the embeddings as inspections, the events as a timed decision stream

def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("t1_stream_inspections", f"{_SIMPLE} SELECT inspection_id, decision, {r('confidence')} AS confidence FROM s")
def t1(spark, sf):
    """The same decision code on a file stream; every input row arrives in the sink once."""
    src, out, ckpt = (_folder(spark, n) for n in ("t1-in", "t1-out", "t1-ckpt"))
    inputs(spark, sf).select("inspection_id", F.timestamp_seconds(F.col("inspection_id") + 1_000_000_000).alias("ts"), "label", "logits").repartition(4).write.parquet(src)
    live = stream.score(stream.read_inputs(spark, src, files_per_trigger=2), TEMPERATURE)
    stream.run_to_table(live.select("inspection_id", "decision", "confidence"), out, ckpt)
    return spark.read.parquet(out)


_EVD = "CASE WHEN event_type = 'error' THEN 'DEFECT' WHEN value > 60 THEN 'REVIEW' ELSE 'PASS' END"


@query("t1_stream_history", f"""SELECT source, CAST(place AS INTEGER) AS place, inspection_id, decision, confidence FROM (SELECT CAST(user_id AS VARCHAR) AS source, event_id AS inspection_id, {_EVD} AS decision, {r('value')} AS confidence,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= {stream.HISTORY}""")
def t1_history(spark, sf):
    """The last 60 inspections of every source, kept as state over two runs of a stream that sends a tenth of them twice."""
    src, out, ckpt = (_folder(spark, n) for n in ("t1h-in", "t1h-out", "t1h-ckpt"))
    frames = materialize(V.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("inspection_id"),
        F.expr(_EVD).alias("decision"), F.col("value").cast("double").alias("confidence")))
    for part in (frames.where("inspection_id % 3 <> 0"), frames.where("inspection_id % 3 = 0 OR inspection_id % 10 = 1")):
        part.write.mode("append").parquet(src)
        live = spark.readStream.schema(stream.FRAME_SCHEMA).parquet(src)
        with stream.keyed_state(spark):
            stream.run_to_table(stream.source_history(live, late="60 days", idle="60 days"), out, ckpt, mode="update")
    held = stream.newest(spark, out, ["source"])
    return held.select("source", F.posexplode("frames").alias("place", "f")).select(
        "source", (F.col("place") + 1).alias("place"), "f.inspection_id", "f.decision", "f.confidence")


@query("t2_stream_decision_counts", f"SELECT date_trunc('hour', ts) AS window_start, {_EVD} AS decision, count(*) AS n FROM events GROUP BY 1, 2")
def t2(spark, sf):
    """Hourly decision counts from a stream in update mode, merged on read, equal the batch answer."""
    src, out, ckpt = (_folder(spark, n) for n in ("t2-in", "t2-out", "t2-ckpt"))
    ev = V.table(spark, sf, "events").select(F.col("event_id").alias("inspection_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_EVD).alias("decision"))
    ev.repartitionByRange(3, "ts").write.parquet(src)
    live = spark.readStream.schema("inspection_id long, ts timestamp, decision string").option("maxFilesPerTrigger", 1).parquet(src)
    stream.run_to_table(stream.decision_counts(live, late="30 days"), out, ckpt, mode="update")
    return stream.newest(spark, out, ["window_start", "decision"])


@query("t3_stream_auto_investigate", f"{_SIMPLE} SELECT inspection_id, CASE WHEN decision = 'REVIEW' THEN 'REVIEW_REQUIRED' ELSE 'COMPLETE' END AS status FROM s WHERE decision <> 'PASS'")
def t3(spark, sf):
    """Each record is sent twice; every DEFECT or REVIEW opens one investigation."""
    src, out, ckpt = (_folder(spark, n) for n in ("t3-in", "t3-out", "t3-ckpt"))
    rows = inputs(spark, sf).select("inspection_id", F.timestamp_seconds(F.col("inspection_id") + 1_000_000_000).alias("ts"), "label", "logits")
    rows.unionByName(rows).repartition(4).write.parquet(src)
    live = stream.score(stream.unique_inspections(stream.read_inputs(spark, src, files_per_trigger=2)), TEMPERATURE)
    stream.auto_investigate(live, context(spark, sf), "plant_a", out, ckpt).awaitTermination()
    return spark.read.parquet(out).select("inspection_id", "status")


@query("t4_stream_stage_latest", f"{_INV} SELECT inspection_id, CAST(arg_max(stage, position) AS VARCHAR) AS stage, arg_max(status, position) AS status FROM v GROUP BY inspection_id")
def t4(spark, sf):
    """Stage events as newline JSON; the last stage per inspection."""
    src, out, ckpt = (_folder(spark, n) for n in ("t4-in", "t4-out", "t4-ckpt"))
    rows = investigate.stage_rows(investigate.investigate(inspection_rows(spark, sf), context(spark, sf)))
    rows.select("inspection_id", F.col("position").alias("seq"), "stage", "status", F.timestamp_seconds(F.col("position")).alias("at")).repartition(3).write.json(src)
    live = spark.readStream.schema(stream.STAGE_SCHEMA).json(src)
    stream.run_to_table(stream.stage_latest(live), out, ckpt, mode="update")
    return stream.newest(spark, out, ["inspection_id"], "seq").select("inspection_id", "stage", "status")
