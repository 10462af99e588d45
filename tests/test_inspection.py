"""Decisions, files, review, anomaly forest, models, networks, streams and sources."""

import os

import pytest
from pyspark.sql import functions as F

from linelens.operators import anomaly, files, inspect, ml, review
from linelens.sources import registry, tables
from linelens.streaming import stream


def png(w, h, tail=b""):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + tail


def test_batch_of_eight_files(spark):
    rows = [(0, "normal/a.png", png(64, 64, b"1")), (1, "normal/b.png", png(64, 64, b"2")), (2, "scratch/c.png", png(64, 64, b"3")), (3, "scratch/d.png", png(64, 64, b"4")),
            (4, "scratch/e.pdf", b"x"), (5, "scratch/f.png", b"junk"), (6, "normal/g.png", png(4, 64)), (7, "normal/h.png", png(64, 64, b"1"))]
    out = files.validate_files(spark.createDataFrame(rows, "position int, original_name string, content binary"))
    s = files.batch_summary(out).first()
    assert (s["valid"], s["unsupported"], s["invalid"], s["duplicate"], s["classes"], s["class_balance"]) == (4, 1, 2, 1, 2, "BALANCED")
    assert out.where("position = 7").first()["reason"] == "duplicate of normal/a.png"


def test_decision_gates(spark):
    df = spark.createDataFrame([(0, 0.85, 0.5, None), (0, 0.85, 0.995, None), (0, 0.75, 0.5, None), (1, 0.75, None, 0.5), (1, 0.75, None, 0.995), (1, 0.6, None, 0.995)], "predicted int, confidence double, anomaly double, novelty double")
    got = [(r["decision"], len(r["review_reasons"])) for r in inspect.decide(df).collect()]
    assert got == [("PASS", 0), ("REVIEW", 1), ("REVIEW", 1), ("DEFECT", 0), ("REVIEW", 1), ("REVIEW", 2)]


def test_temperature_lowers_overconfidence(spark):
    rows = [([4.0, 0.0], int(i % 3 == 0)) for i in range(300)]
    row = inspect.fit_temperature(spark.createDataFrame(rows, "logits array<double>, label int")).first()
    assert row["temperature"] == pytest.approx(4.0 / 0.6931, rel=0.02)  # odds of 2 to 1


def test_mahalanobis_matches_numpy(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(300, 4))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, embedding array<double>").repartition(4)
    mean, precision = inspect.normal_reference(df)
    cov = np.cov(x, rowvar=False)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(precision, np.linalg.inv(cov + 1e-3 * np.trace(cov) / 4 * np.eye(4)))


def test_review_set(spark):
    ins = spark.createDataFrame([(1, "REVIEW", 0.5), (2, "REVIEW", 0.6), (3, "PASS", 0.9), (4, "DEFECT", 0.8)], "inspection_id long, decision string, confidence double")
    req = spark.createDataFrame([(1, "confirm_defect", 1), (2, "explode", 1)], "inspection_id long, action string, at int")
    good, bad = review.record_review(ins, req)
    s = review.review_stats(ins, good).first()
    assert (s["auto_resolved"], s["human_reviewed"], s["pending_review"], s["auto_resolved_rate"]) == (2, 1, 1, 0.5)
    assert bad.first()["reason"] == "INVALID_REVIEW_ACTION" and [r["inspection_id"] for r in review.review_queue(ins, good).collect()] == [2]


def test_interleave_keeps_every_frame(spark):
    rows = [("normal", f"n{i}") for i in range(5)] + [("dent", f"d{i}") for i in range(4)] + [("crack", "c0")]
    out = inspect.interleave(spark.createDataFrame(rows, "class_folder string, original_name string")).orderBy("frame").collect()
    assert [r["original_name"] for r in out[:6]] == ["c0", "n0", "n1", "d0", "n2", "n3"] and len(out) == 10
    assert {r["original_name"] for r in out if not r["within_rotation"]} == {"d2", "d3"}


def test_forest_finds_the_planted_outliers(spark):
    df = spark.range(500).select("id", *[(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0 + F.when(F.col("id") < 5, 8.0).otherwise(0.0)).alias(c) for s, c in enumerate("abc")], F.lit("x").alias("split"))
    out, info = anomaly.detect_anomalies(df.withColumnRenamed("id", "unit"), "unit", [], trees=50)
    states = {r["unit"]: r["anomaly_state"] for r in out.collect()}
    assert info["features"] == ["a", "b", "c"] and all(states[i] == "ANOMALOUS" for i in range(5)) and len(states) == 500
    assert sum(s == "ANOMALOUS" for s in states.values()) == 10
    assert anomaly.detect_anomalies(df.limit(20), "id", [])[1]["status"] == "NOT_SUPPORTED"


def test_target_types(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("Defect Pass"), (F.col("id") % 4).alias("quality_class"), (F.col("id") % 4).alias("count"), F.lit(1).alias("label"), F.lit("a").alias("grade"))
    got = {r["column"]: r["type"] for r in ml.detect_target_types(df).collect()}
    assert got == {"Defect Pass": "binary_classification", "quality_class": "multiclass_classification", "count": "regression", "label": "unsupported", "grade": "unsupported"}


def test_model_beats_baseline_and_survives_the_registry(spark, tmp_path):
    df = spark.range(240).select("id", (F.col("id") % 12).cast("double").alias("Demand"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("u"), F.when(F.col("id") < 168, "train").when(F.col("id") < 204, "validation").otherwise("test").alias("split"))
    df = df.withColumn("Total parts", 3 * F.col("Demand") - 20 * F.col("u"))
    run = ml.select_model(df, "Total parts", ["Demand", "u"], "regression", forest_trees=5, boost_rounds=3)
    assert run["best"] == "ridge" and run["test"]["rmse"] < run["baseline"]["rmse"] / 5
    top = ml.feature_importance(spark, run).first()
    assert top["factor"] == "Demand" and top["direction"] == "positive_association"
    ml.save_model(run, str(tmp_path), "d", "m")
    again = ml.load_model(ml.list_models(spark, str(tmp_path), "d").first()["path"])
    assert again.transform(df).count() == 240


def test_network_from_text(spark, tmp_path):
    body = "x1_step1.xoffset = 2;\nx1_step1.gain = 0.5;\nx1_step1.ymin = -1;\nb1 = [0.1;-0.2];\nIW1_1 = [0.3;0.4];\nb2 = [0.5;0.6];\nLW2_1 = [1 2;3 4];\ny1_step1.ymin = -1;\ny1_step1.gain = [2;4];\ny1_step1.xoffset = [10;20];\n"
    path = os.path.join(tmp_path, "net.m")
    with open(path, "w") as fh:
        fh.write(body)
    net = ml.read_network(spark, path)
    import math

    x = (6 - 2) * 0.5 - 1
    h = [math.tanh(0.1 + 0.3 * x), math.tanh(-0.2 + 0.4 * x)]
    want = [(0.5 + h[0] + 2 * h[1] + 1) / 2 + 10, (0.6 + 3 * h[0] + 4 * h[1] + 1) / 4 + 20]
    got = spark.createDataFrame([(6.0,)], "v double").select(ml.score_network(F.array("v"), net).alias("y")).first()["y"]
    assert got == pytest.approx(want)


def test_late_rows_are_dropped_and_resends_counted_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    base = 1_700_000_000
    schema = "inspection_id long, ts timestamp, label int, logits array<double>"
    make = lambda rows: spark.createDataFrame(rows, "inspection_id long, s long").select("inspection_id", F.timestamp_seconds("s").alias("ts"), F.lit(0).alias("label"), F.array(F.lit(3.0), F.lit(0.0)).alias("logits"))
    make([(1, base), (2, base + 10), (1, base + 20)]).coalesce(1).write.mode("append").parquet(src)
    run = lambda: stream.run_to_table(stream.score(stream.unique_inspections(stream.read_inputs(spark, src, schema), "10 minutes")).select("inspection_id", "decision"), out, ck)
    run()
    make([(3, base + 7200)]).coalesce(1).write.mode("append").parquet(src)
    run()
    make([(4, base - 7200), (5, base + 7300)]).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r["inspection_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 5]


def test_delimited_text(spark, tmp_path):
    tab = os.path.join(tmp_path, "a.txt")
    with open(tab, "w", encoding="latin-1") as fh:
        fh.write("k\tname\n1\tcafé\n2\tb\n")
    df = tables.scan_delimited(spark, tab)
    assert df.columns == ["k", "name"] and {r["name"] for r in df.collect()} == {"café", "b"}
    empty = os.path.join(tmp_path, "b.csv")
    open(empty, "w").close()
    with pytest.raises(ValueError, match="EMPTY_FILE"):
        tables.scan_delimited(spark, empty)


def test_folder_ledger_and_containers(spark, tmp_path):
    for name, data in (("a.csv", b"x,y\n1,2\n"), ("b.zip", b"PK\x03\x04rest"), ("c.md", b"hi"), ("d.mat", b"MATLAB 5.0 MAT-file".ljust(124) + b"\x00\x01IM")):
        (tmp_path / name).write_bytes(data)
    found, ledger = tables.scan_table_set(spark, str(tmp_path))
    assert set(found) == {"a"} and {r["file"]: r["status"] for r in ledger.collect()} == {"a.csv": "READ", "b.zip": "SKIPPED", "c.md": "SKIPPED", "d.mat": "SKIPPED"}
    kinds = {r["file"]: (r["container"], r["mat_valid"]) for r in tables.sniff_containers(spark, str(tmp_path)).collect()}
    assert kinds["b.zip"][0] == "zip" and kinds["d.mat"] == ("mat", True) and kinds["a.csv"][0] == "text"
    import hashlib

    prints = {r["file"]: r["sha256"] for r in tables.fingerprints(spark, str(tmp_path)).collect()}
    assert prints["a.csv"] == hashlib.sha256(b"x,y\n1,2\n").hexdigest()


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, at int, v string")
    new = spark.createDataFrame([("a", 2, "z")], "id string, at int, v string")
    assert {(r["id"], r["v"]) for r in registry.upsert(old, new, "id", "at").collect()} == {("a", "z"), ("b", "y")}


def jpeg(w, h, before=b"", marker=0xC2):
    return b"\xff\xd8" + before + b"\xff" + bytes([marker]) + b"\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03" + b"\x00" * 20


def tiff(order, entries, mark):
    body = len(entries).to_bytes(2, order) + b"".join(t.to_bytes(2, order) + k.to_bytes(2, order) + (1).to_bytes(4, order) + (v.to_bytes(2, order) + b"\x00\x00" if k == 3 else v.to_bytes(4, order)) for t, k, v in entries)
    return mark + (10).to_bytes(4, order) + b"\x00\x00" + body


def webp(chunk, body):
    return b"RIFF\x00\x01\x00\x00WEBP" + chunk + b"\x40\x00\x00\x00" + body


def test_image_sizes_from_heads(spark):
    little = lambda x, n: x.to_bytes(n, "little")
    segment = b"\xff\xe1\x00\x0a" + b"\xff\xc0\xff\xc0\xff\xc0\xff\xc0"  # frame marks inside a segment are data
    many = b"".join(b"\xff\xe2\x00\x03x" for _ in range(400))
    cases = [
        (jpeg(640, 480), "JPEG", 640, 480), (jpeg(640, 481, segment), "JPEG", 640, 481), (jpeg(65535, 9, many, 0xC0), "JPEG", 65535, 9),
        (jpeg(33, 44, b"\xff\xff\xff\xc4\x00\x04ab\xff\x01"), "JPEG", 33, 44),  # fill bytes, a Huffman table, a mark without length
        (jpeg(33, 44)[:8], "JPEG", None, None), (b"\xff\xd8\xff\xda\x00\x04ab" + jpeg(9, 9), "JPEG", None, None), (b"\xff\xd8\xff\xe0", "JPEG", None, None),
        (b"\xff\xd8\xff\xe0\x00\x04abxx" + jpeg(9, 9), "JPEG", None, None),
        (tiff("little", [(254, 4, 0), (256, 3, 300), (257, 4, 70000)], b"II*\x00"), "TIFF", 300, 70000),
        (tiff("big", [(256, 4, 70001), (257, 3, 301), (258, 3, 8)], b"MM\x00*"), "TIFF", 70001, 301),
        (tiff("big", [(256, 4, 70001), (258, 3, 8)], b"MM\x00*"), "TIFF", 70001, None), (b"II*\x00\xff\xff\xff\xff", "TIFF", None, None), (b"MM\x00*", "TIFF", None, None),
        (webp(b"VP8 ", b"\x10\x00\x00\x9d\x01\x2a" + little(500, 2) + little(400 + 16384, 2)), "WEBP", 500, 400),
        (webp(b"VP8 ", b"\x10\x00\x00\x00\x00\x00" + little(500, 2) + little(400, 2)), "WEBP", None, None),
        (webp(b"VP8L", b"\x2f" + little(499 + (399 << 14), 4)), "WEBP", 500, 400), (webp(b"VP8X", b"\x10\x00\x00\x00" + little(70_000, 3) + little(9, 3)), "WEBP", 70_001, 10),
        (webp(b"VP8X", b"\x10"), "WEBP", None, None), (b"GIF89a" + little(20, 2) + little(30, 2), "GIF", 20, 30), (b"BM" + b"\x00" * 16 + little(20, 4) + little(30, 4), "BMP", 20, 30),
        (png(20, 30)[:20], "PNG", 20, None), (b"", None, None, None), (None, None, None, None), (b"text", None, None, None)]
    rows = [(k, f"{k}.png", c[0]) for k, c in enumerate(cases)]
    out = files.validate_files(spark.createDataFrame(rows, "position int, original_name string, content binary")).collect()
    got = {r.position: (r.format, r.width, r.height) for r in out}
    assert got == {k: c[1:] for k, c in enumerate(cases)}
    status = {r.position: (r.status, r.reason) for r in out}
    assert all(status[k] == (("valid", None) if c[2] and c[3] else ("invalid", "unreadable image")) for k, c in enumerate(cases))
