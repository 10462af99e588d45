"""Planted frames: cleaning, features, stations, inputs and splits."""

import pytest
from pyspark.sql import functions as F

from linelens.operators import align, clean, features, profile, split
from linelens.sources import registry, tables


def profiled(df, key):
    meta = profile.profile(df, "t", [key])
    return meta, profile.Meta.of(meta)


def test_roles_of_a_process_table(spark):
    df = spark.createDataFrame([(i, 4, 0.5, 3.0, f"p{i}.png", 1.0, None) for i in range(20)],
                               "Time_Now int, Demand int, `Press 1 Utilization` double, `Drilling Queue Time` double, image_path string, `Total parts` double, nothing double")
    roles = {r["column"]: (r["role"], r["station"], r["metric"]) for r in profiled(df, "Time_Now")[0].collect()}
    assert roles["Time_Now"][0] == "timestamp" and roles["Demand"][0] == "input_factor"
    assert roles["Press 1 Utilization"] == ("process_metric", "Press_1", "utilization")
    assert roles["Drilling Queue Time"] == ("process_metric", "Drilling", "queue_wait")
    assert roles["image_path"][0] == "image_reference" and roles["Total parts"][0] == "response_candidate" and roles["nothing"][0] == "empty"


def test_date_named_text_is_a_timestamp_only_when_it_parses(spark):
    df = spark.createDataFrame([(i, f"2024-01-{i + 1:02d}", "early") for i in range(9)], "k int, inspection_date string, shift string")
    roles = {r["column"]: r["role"] for r in profiled(df, "k")[0].collect()}
    assert roles["inspection_date"] == "timestamp" and roles["shift"] == "categorical"


def test_samples_find_values_behind_the_head(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") >= 990, F.col("id")).alias("late"))
    got = {r["column"]: r["samples"] for r in profile.samples(df, ["id"]).collect()}
    assert got["id"] == ["0", "1", "2"] and got["late"] == ["990", "991", "992"]


def test_cleaning_reports_every_rule(spark):
    rows = [(i, "bad" if i == 3 else str(i), 50.0 + i, -1.0 if i == 5 else float(i), None, 7.0) for i in range(12)] + [(0, "0", 50.0, 0.0, None, 7.0)]
    df = spark.createDataFrame(rows, "k int, Demand string, A_Util double, A_Queue double, gone double, same double")
    _, meta = profiled(df, "k")
    out, report = clean.clean_table(df, meta)
    told = {(r["rule"], r["column"]): r["count"] for r in report.collect()}
    assert told[("empty_column", "gone")] == 1 and told[("coerced_to_null", "Demand")] == 1
    assert told[("duplicate_rows_removed", None)] == 1 and told[("percent_to_ratio", "A_Util")] == 1
    assert told[("negative_value", "A_Queue")] == 1 and told[("constant_column", "same")] == 1
    assert out.count() == 12 and out.agg(F.max("A_Util")).first()[0] <= 1 and "gone" not in out.columns


def test_single_column_tables_keep_their_duplicates(spark):
    assert clean.dedupe_rows(spark.createDataFrame([(1,), (1,)], "x int")).count() == 2


def test_duplicates_compare_whole_records(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 5.0, "a"), (2, 5.0, "a")], "k int, x double, y string")
    assert clean.dedupe_rows(df).count() == 2  # rows that differ in k are no duplicates
    assert [tuple(r) for r in clean.dedupe_rows(df, row_key="k").collect()] == [(1, 5.0, "a")]  # unless k is an added number


def test_prepare_runs_from_raw_table_to_features(spark):
    from linelens.plans import process as runs

    df = spark.range(60).select(F.col("id").alias("Time_Now"), (F.col("id") % 5).alias("Demand"), (F.col("id") / 100).alias("A_Util"), (F.col("id") / 90).alias("B_Util"), F.col("id").cast("double").alias("Total parts"))
    ready = runs.prepare(df.unionByName(df.limit(3)), "line", "Time_Now", "Time_Now")
    assert ready.df.count() == 60 and ready.order_cols == ["Time_Now"]
    last = ready.df.where("Time_Now = 59").first()
    assert last["A_Util_rolling_mean_20"] == pytest.approx(sum(i / 100 for i in range(40, 60)) / 20) and last["utilization_mean"] == pytest.approx((0.59 + 59 / 90) / 2)
    frame, summary = align.build_model_input(ready.df, ready.meta, "line", keep=["Time_Now"])
    assert summary["status"] == "READY" and "utilization_mean" in summary["predictors"] and frame.count() == 60


def test_empty_tables_are_refused(spark):
    df = spark.createDataFrame([], "a int, b int")
    with pytest.raises(ValueError, match="EMPTY_TABLE"):
        clean.clean_table(df, profile.Meta([]))
    assert profile.empty_guard(df, "t").first()["status"] == "EMPTY_DATASET"


def test_group_features_and_lineage(spark):
    df = spark.createDataFrame([(i, 0.2, 0.6, float(i), None, 0.4) for i in range(60)], "k int, Press1_Util double, Press2_Util double, Press1_Queue double, Press2_Queue double, Blanking_Util double")
    meta = profile.Meta.of(profile.classify_roles(profile.column_facts(df.withColumn("Press2_Queue", F.lit(1.0)))))
    out, lineage = features.build_features(df, meta, "t")
    row = out.orderBy("k").first()
    assert row["Press_utilization_mean"] == pytest.approx(0.4) and row["Press_utilization_spread"] == pytest.approx(0.4)
    assert row["Press_queue_total"] == 0.0 and row["utilization_mean"] == pytest.approx(0.4)
    skipped = {r["feature"]: r["reason"] for r in lineage.where("status = 'skipped'").collect()}
    assert "rolling utilization statistics" in skipped


def test_row_features_of_rows_without_values(spark):
    df = spark.createDataFrame([(None, None), (0.2, None), (0.2, 0.4)], "A_Util double, B_Util double")
    meta = profile.Meta.of(profile.classify_roles(profile.column_facts(df)))
    got = [(r["utilization_mean"], r["utilization_spread"]) for r in features.project_features(df, features.plan_features(meta)[0]).collect()]
    assert got == [(None, None), (0.2, 0.0), (pytest.approx(0.3), pytest.approx(0.2))]


def test_aligned_family_is_fused_by_position_and_never_across_families(spark):
    groups = align.alignment_groups({"Model1Predictors": ("m.mat", 40), "Model1Answer_0": ("m.mat", 40), "Model2PredictorDrilling_0": ("m.mat", 40), "Model2AnswerDrilling": ("m.mat", 40)})
    assert sorted(map(tuple, groups.values())) == [("Model1Answer_0", "Model1Predictors"), ("Model2AnswerDrilling", "Model2PredictorDrilling_0")]
    assert align.fused_name(["Model1Predictors", "Model1Answer_0"], 40) == "Model1" and align.fused_name(["a", "b"], 40) == "fused_40"
    a = spark.createDataFrame([(i, i * 2) for i in range(40)], "k int, p int")
    b = spark.createDataFrame([(i, i * 3.0) for i in range(40)], "k int, y double")
    got = align.align_tables([(a, ["k"]), (b, ["k"])]).collect()
    assert len(got) == 40 and all(r["y"] == r["p"] * 1.5 for r in got)
    with pytest.raises(ValueError, match="ROW_COUNT_MISMATCH"):
        align.align_tables([(a, ["k"]), (b.limit(39), ["k"])])


def test_rows_without_a_key_are_kept(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 40) for i in range(200)], "id int, g int")
    assert split.grouped_split(df, "g", "id", 40).where("split is not null").count() == 200
    files = spark.createDataFrame([(i, "a", None if i == 3 else str(i % 5)) for i in range(20)], "id int, cls string, h string")
    out = split.content_group_split(files, "cls", "h")
    assert out.count() == 20 and out.where("split = 'unsplit'").count() == 1
    new = align.incremental_duplicates(files.limit(0), files, "h", "id")
    assert new.count() == 20 and not new.where("h is null").first()["duplicate"]
    old = spark.createDataFrame([(1, 5, "old"), (2, None, "old"), (3, 7, "old")], "k int, stamp int, v string")
    fresh = spark.createDataFrame([(1, 5, "new"), (2, None, "new"), (4, None, "new")], "k int, stamp int, v string")
    assert {(r["k"], r["v"]) for r in registry.upsert(old, fresh, "k", "stamp").collect()} == {(1, "new"), (2, "new"), (3, "old"), (4, "new")}


def test_asof_never_takes_a_later_reading(spark):
    ins = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00.2"), (2, None, "2024-01-01 10:00:00.2"), (3, "a", None)], "id int, st string, t string").select("id", "st", F.to_timestamp("t").alias("at"))
    pro = spark.createDataFrame([("a", "2024-01-01 10:00:00.1", 1.0), ("a", "2024-01-01 10:00:00.9", 2.0)], "st string, t string, v double").select("st", F.to_timestamp("t").alias("read"), "v")
    got = {r["id"]: (r["process_v"], r["link_status"]) for r in align.asof_link(ins, pro, "st", "at", "read", 3600).collect()}
    assert got == {1: (1.0, "LINKED"), 2: (None, "NOT_AVAILABLE"), 3: (None, "NOT_AVAILABLE")}


def test_model_input_rejections(spark):
    df = spark.createDataFrame([(i, 3, 1.0) for i in range(30)], "k int, Demand int, `Total parts` double")
    _, meta = profiled(df, "k")
    frame, why = align.build_model_input(df.drop("k"), meta, "t")
    assert frame is None and why["status"] == "NOT_SUPPORTED" and why["constants"] == ["Demand"]
    few = spark.createDataFrame([(i, i, float(i) if i < 5 else None) for i in range(30)], "k int, Demand int, `Total parts` double")
    frame, why = align.build_model_input(few.drop("k"), profiled(few, "k")[1], "t")
    assert frame is None and why["status"] == "INSUFFICIENT_DATA"


def test_split_strategies(spark):
    timed = spark.range(300).select(F.col("id").alias("Time_Now"), (F.col("id") * 1.0).alias("x"))
    out, meta = split.compute_split(timed, "Time_Now", [], ["Time_Now"])
    m = meta.first()
    assert (m["strategy"], m["train"], m["validation"], m["test"]) == ("chronological_holdout", 210, 45, 45)
    assert out.where("split = 'train'").agg(F.max("Time_Now")).first()[0] == 209
    long_run = spark.range(60_000).select("id")
    assert split.compute_split(long_run, "id", [], [], sequential=True)[1].first()["strategy"] == "sequential_holdout"
    assert split.compute_split(long_run, "id", [], [])[1].first()["strategy"] == "seeded_random_holdout"
    grouped = spark.range(300).select("id", (F.col("id") % 10).alias("Demand"))
    out, meta = split.compute_split(grouped, "id", ["Demand"], [])
    assert meta.first()["strategy"] == "grouped_holdout"
    assert out.groupBy("Demand").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert {r[0] for r in out.select("split").distinct().collect()} == {"train", "validation", "test"}
    alone = spark.range(200).select("id", F.lit(1).alias("c"))
    out, meta = split.compute_split(alone, "id", ["c"], [])
    again = split.compute_split(alone, "id", ["c"], [])[0]
    assert meta.first()["strategy"] == "seeded_random_holdout" and out.exceptAll(again).isEmpty()
    assert split.compute_split(spark.range(12).select("id"), "id", [], [])[1].first()["status"] == "NOT_APPLICABLE"


@pytest.mark.parametrize("n", [7, 10, 23, 101])
def test_quantile_bins_follow_the_rank_rule(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 3).alias("v"))
    got = [r["bin"] for r in split.quantile_bins(df, "v", "id").orderBy("v", "id").collect()]
    edges = [(n - 1) * k / 5 for k in range(1, 6)]
    assert got == [next(k for k, e in enumerate(edges) if i <= e + 1e-9) for i in range(n)]


def test_content_groups_never_cross_splits_even_when_one_dominates(spark):
    df = spark.range(600).select("id", F.lit("c").alias("cls"), F.when(F.col("id") < 250, "same").otherwise(F.col("id").cast("string")).alias("h"))
    out = split.content_group_split(df, "cls", "h")
    assert out.count() == 600 and out.groupBy("h").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()


def test_station_metrics_pool_columns(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 5.0)], "A_Util double, `A 2 Util` double")
    meta = profile.Meta([type("R", (dict,), {})(ordinal=0, column="A_Util", role="process_metric", station="A", metric="utilization"),
                         type("R", (dict,), {})(ordinal=1, column="A 2 Util", role="process_metric", station="A", metric="utilization")])
    row = features.station_metrics(df, meta).first()
    assert (row["mean"], row["max"], row["samples"]) == (3.0, 5.0, 3) and row["std_pop"] == pytest.approx(1.632993)


def test_asof_link_prefers_the_latest_and_respects_tolerance(spark):
    ins = spark.createDataFrame([(1, "s", "2024-01-01 10:00:00"), (2, "s", "2024-01-01 12:00:00"), (3, "t", "2024-01-01 10:00:00")], "id int, st string, at string").withColumn("at", F.to_timestamp("at"))
    pro = spark.createDataFrame([("s", "2024-01-01 09:30:00", 1.0), ("s", "2024-01-01 09:59:59", 2.0), ("s", "2024-01-01 10:00:01", 3.0)], "st string, read string, v double").withColumn("read", F.to_timestamp("read"))
    for rows in (1, 10):
        got = {r["id"]: (r["process_v"], r["link_status"]) for r in align.asof_link(ins, pro, "st", "at", "read", 3600, group_rows=rows).collect()}
        assert got == {1: (2.0, "LINKED"), 2: (None, "NOT_AVAILABLE"), 3: (None, "NOT_AVAILABLE")}


def test_tables_of_one_name_are_both_read(spark, tmp_path):
    for folder, value in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text(f"x,y\n{value},5\n")
    found, ledger = tables.scan_table_set(spark, str(tmp_path))
    assert sorted(df.first()["x"] for df in found.values()) == [1, 2]
    assert sorted((r["file"], r["status"]) for r in ledger.collect()) == [("a/t.csv", "READ"), ("b/t.csv", "READ")]


def test_a_late_byte_decides_the_encoding(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes(b"x,y\n" + b"1,a\n" * 1500 + b"2,\xe9\n")
    assert tables.scan_delimited(spark, str(tmp_path / "late.csv")).where("x = 2").first()["y"] == "é"


def test_models_are_fitted_on_even_partitions_of_the_rows(spark, monkeypatch):
    """Many narrow rows come as one partition; every one must reach a fit, in partitions that follow from the rows alone."""
    from pyspark.sql import functions as F

    from linelens.operators import ml

    monkeypatch.setattr(ml, "FIT_ROWS", 100)
    seen = []

    class Mean(ml.MeanBaseline):
        def fit(self, train):
            seen.append([[tuple(r) for r in part] for part in train.select("x", "label").rdd.glom().collect()])
            return super().fit(train)

    monkeypatch.setattr(ml, "candidates", lambda kind, *a: [("mean", Mean(False))])
    df = spark.range(1000).select((F.col("id") % 50 * 1.0).alias("x"), (F.col("id") * 1.0).alias("y"), F.when(F.col("id") < 700, "train").when(F.col("id") < 850, "validation").otherwise("test").alias("split"))
    runs = [ml.select_model(some, "y", ["x"], "regression") for some in (df.coalesce(1), df.coalesce(1))]
    sizes = [len(part) for part in seen[0]]
    assert len(sizes) == 10 and max(sizes) <= 100 and sorted(r for part in seen[0] for r in part) == sorted((i % 50 * 1.0, i * 1.0) for i in range(700))
    assert seen[0] == seen[1] and runs[0]["test"] == runs[1]["test"] and runs[0]["counts"] == {"train": 700, "validation": 150, "test": 150}
