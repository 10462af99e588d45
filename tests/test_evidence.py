"""Planted causes, drift, stations, economics, language and recommendations."""

import math

import pytest
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.operators import drift, economics, evidence, flow, language, profile, recommend
from linelens.plans import process as runs
from linelens.session import materialize


def noise(k, seed):
    return (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1000)) / 1000.0 - 0.5) * k


@pytest.fixture(scope="module")
def driver(spark):
    """Total parts = 500 - 400 * Line1_Util + 5 * Demand + noise; Noise_Sensor is unrelated."""
    df = spark.range(800).select("id", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(17)) + 4).cast("double").alias("Demand"),
                                 (F.lit(0.6) + noise(0.6, 2)).alias("Line1_Util"), noise(2.0, 3).alias("Noise_Sensor"))
    return materialize(df.withColumn("Total parts", 500 - 400 * F.col("Line1_Util") + 5 * F.col("Demand") + noise(10.0, 4)))


def test_planted_driver_ranks_first(spark, driver):
    meta = materialize(profile.profile(driver, "t", ["id"]))
    out = runs.root_cause(driver, meta, "Total parts", "id", ["id"], factors=["Demand", "Line1_Util", "Noise_Sensor"])
    found = {r["factor"]: r for r in out["findings"].collect()}
    assert found["Line1_Util"]["rank"] == 1 and found["Line1_Util"]["spearman_r"] < -0.9 and abs(found["Noise_Sensor"]["spearman_r"]) < 0.2
    assert found["Line1_Util"]["mi"] > 2 * found["Line1_Util"]["mi_baseline"] > 0
    for r in found.values():
        assert 0 <= r["evidence_score"] <= 100 and r["explanation"].endswith(fixed.DISCLAIMER)
        assert r["component_anomaly"] is None and r["component_model_contribution"] is None  # missing stays missing
    assert {r["station"] for r in out["stations"].collect()} == {"Line1"}
    told = out["findings"].select("explanation")
    assert language.gate_texts(out["findings"], "factor", "explanation").where("violations > 0").isEmpty() and told.count() == 3


def test_event_rules(spark, driver):
    for bad, text in (({"direction": "up"}, "INVALID_DIRECTION"), ({"quantile": 0.6}, "INVALID_QUANTILE")):
        with pytest.raises(ValueError, match=text):
            evidence.tail_event(driver, "Total parts", **bad)
    with pytest.raises(ValueError, match="INSUFFICIENT_DATA"):
        evidence.tail_event(driver.limit(50), "Total parts")


def test_factor_selection_skips_ids_and_constants(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") * 1.0).alias("a"), F.lit(1.0).alias("b"), F.lit("t").alias("c"), F.col("id").alias("index"), F.col("id").alias("y"))
    factors, excluded = evidence.select_factors(df, "y", [])
    assert factors == ["a"] and set(excluded) == {"row_id", "b", "c", "index", "y"}


def test_spearman_with_gaps_equals_pandas(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 7 != 0, noise(10, 1)).alias("x"), F.round(noise(10, 2)).alias("y"), F.round(noise(4, 3)).alias("z"))
    got = {r["factor"]: r["spearman_r"] for r in evidence.spearman(df, "y", ["x", "z"]).collect()}
    p = df.toPandas()
    for c in ("x", "z"):
        both = p[[c, "y"]].dropna()
        assert got[c] == pytest.approx(both[c].rank().corr(both["y"].rank()), abs=1e-6)


def test_constant_and_empty_factors_are_unavailable_not_errors(spark):
    df = spark.range(300).select("id", F.lit(1.0).alias("flat"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 0, 1.0).alias("one"), (F.col("id") * 1.0).alias("y"))
    flagged, _ = evidence.tail_event(df, "y")
    names = ["flat", "none", "one"]
    assert {r["pearson_r"] for r in evidence.correlations(flagged, "y", names).collect()} == {None}
    assert {r["spearman_r"] for r in evidence.spearman(flagged, "y", names).collect()} == {None}
    assert all(r["mi"] in (None, 0.0) for r in evidence.mutual_information(flagged, "y", names, "id").collect())
    assert {r["z"] for r in evidence.mann_whitney(flagged, names).collect()} <= {None}
    assert {r["standardized_effect"] for r in evidence.group_effect(flagged, names).collect()} == {None, 0.0}
    assert evidence.temporal(flagged, "y", names, ["id"]).count() == 3


def test_onset_needs_five_in_a_row(spark):
    flags = [0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0] + [0] * 240
    df = spark.createDataFrame([(i, float(i % 9), 1.0 - f, bool(f)) for i, f in enumerate(flags)], "k int, x double, y double, _event boolean")
    row = evidence.temporal(df, "y", ["x"], ["k"]).first()
    assert row["event_onset_position"] == 6


def test_drift_step_and_stable_twin(spark):
    step = spark.range(4000).select("id", (F.when(F.col("id") < 2000, 0.5).otherwise(0.9) + noise(0.05, 1)).alias("Line1_Util"), noise(1, 2).alias("calm"))
    got = {r["column"]: r for r in drift.detect_drift(step, ["id"], ["Line1_Util", "calm"]).collect()}
    hit = got["Line1_Util"]
    assert hit["drift_detected"] and hit["direction"] == "increase" and hit["peak_ewma_z"] >= 3 and abs(hit["change_position"] - 1999) <= 1
    assert not got["calm"]["drift_detected"]
    assert drift.drift_status(drift.detect_drift(step.limit(100), ["id"], ["calm"])).first()["status"] == "DRIFT_ANALYSIS_NOT_SUPPORTED"
    assert drift.drift_status(drift.detect_drift(step, [], ["calm"]), False).first()["status"] == "DRIFT_ANALYSIS_NOT_SUPPORTED"


def test_drift_skips_nulls(spark):
    full = spark.range(1500).select("id", noise(1, 5).alias("x"))
    gapped = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, F.col("id") / 2).alias("h"))
    gapped = gapped.join(full.select(F.col("id").alias("h"), "x"), "h", "left").select("id", "x")
    a, b = drift.detect_drift(full, ["id"], ["x"]).first(), drift.detect_drift(gapped, ["id"], ["x"]).first()
    assert a.asDict() == b.asDict()


@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(600).select(F.col("id").alias("Time_Now"), *[(F.lit(u) + noise(0.05, i)).alias(f"Station{s}_Util") for i, (s, u) in enumerate((("A", 0.5), ("B", 0.85), ("C", 0.6)))],
                                 *[(F.lit(w) + noise(1.0, i + 9)).alias(f"Station{s}_Queue") for i, (s, w) in enumerate((("A", 3.0), ("B", 20.0), ("C", 5.0)))])
    return materialize(df.withColumn("Total parts", 100 - 80 * (F.col("StationB_Util") - 0.85)))


def test_planted_station_is_the_constraint(spark, planted):
    meta = profile.Meta.of(profile.classify_roles(profile.column_stats(planted)))
    out = runs.bottleneck(planted, meta)
    ranked = {r["station"]: r for r in out["stations"].collect()}
    assert ranked["StationB"]["rank"] == 1 and out["candidate"].first()["station"] == "StationB"
    assert ranked["StationA"]["cycle_time_pressure"] is None and ranked["StationA"]["root_cause_evidence"] is None and ranked["StationA"]["anomaly_evidence"] is None
    impact = out["impact"].where("station = 'StationB'").first()
    assert impact["status"] == "OBSERVED_COMPARISON" and impact["constrained_mean"] < impact["unconstrained_mean"]
    assert {r["status"] for r in out["blocking"].collect()} == {"NOT_SUPPORTED"}


def test_flow_sequences(spark):
    assert flow.known_sequence(["Drilling", "Milling", "Assembly"], ["Assembly", "Drilling", "x"]) == ["Drilling", "Assembly"]
    assert flow.suffix_sequence(["Press2", "Press10", "Press1", "Paint"]) == ["Press1", "Press2", "Press10"]
    assert flow.infer_sequence(spark, ["a", "b"]) is None


def economy(spark, **given):
    rows = [("d", f, str(v), 1) for f, v in given.items()]
    accepted = economics.validate_assumptions(spark.createDataFrame(rows, "dataset_id string, field string, raw string, at int"))
    return economics.assumption_wide(economics.merge_assumptions(accepted))


def test_baseline_and_missing_inputs(spark):
    wide = economy(spark, contribution_margin_per_unit=25, working_hours_per_day=8, working_days_per_month=22, currency="eur")
    full = economics.baseline_economics(wide.withColumn("throughput_per_hour", F.lit(100.0))).first()
    assert (full["daily_contribution"], full["monthly_contribution"], full["currency"]) == (20_000.0, 440_000.0, "EUR")
    none = economics.baseline_economics(wide.withColumn("throughput_per_hour", F.lit(None).cast("double"))).first()
    assert none["baseline_status"] == "NOT_AVAILABLE" and none["daily_missing"] == "throughput_per_hour"


def test_a_later_null_clears_a_field(spark):
    rows = [("d", "intervention_cost", "5", 1), ("d", "intervention_cost", None, 2)]
    merged = economics.merge_assumptions(economics.validate_assumptions(spark.createDataFrame(rows, "dataset_id string, field string, raw string, at int"))).first()
    assert merged["value"] is None and merged["source"] == "NOT_PROVIDED"


def test_utilization_cut_never_moves_throughput(spark):
    base = economics.baseline_economics(economy(spark, contribution_margin_per_unit=2, working_hours_per_day=8).select("*", F.lit(10.0).alias("throughput_per_hour"), F.lit(0.9).alias("current_utilization")))
    todo = spark.createDataFrame([("d", "utilization_reduction", 0.1, None), ("d", "throughput_scaling", 0.1, "data")], "dataset_id string, scenario_type string, change double, scaling_basis string")
    got = {r["scenario_type"]: r for r in economics.scenario_delta(economics.run_scenarios(todo, base)).collect()}
    assert got["utilization_reduction"]["scenario_utilization"] == pytest.approx(0.81) and got["utilization_reduction"]["units_delta"] == 0.0
    assert got["throughput_scaling"]["scenario_status"] == "NOT_SUPPORTED"
    assert economics.sensitivity(base, "demand_uplift", [0.01 * k for k in range(1, 31)]).count() == 30


@pytest.mark.parametrize("text,count", [
    ("This will fix it", 1), ("It is not guaranteed", 0), ("guaranteed savings", 2), ("Never in my life; this is definitely so", 1), ("It will definitely work", 2),
    ("no guaranteed result", 0), ("ensures a reduction", 1), ("never ensures a reduction", 0), ("ensures an increase", 1), ("not yet a proven cause", 0), ("not a word more than sixteen characters: proven cause", 1), ("", 0), (None, 0)])
def test_language_gate(spark, text, count):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert language.gate_texts(df, "id", "t").first()["violations"] == count


def test_gate_rejects_control_and_empty_evidence(spark):
    schema = "dataset_id string, rule string, action_type string, target string, station string, title string, why string, evidence array<struct<statement:string,detail:string>>, evidence_quality string, limitations array<string>, data_requirement boolean"
    df = spark.createDataFrame([("d", "r", "STOP_LINE", "t", None, "x", "y", [], "LIMITED_EVIDENCE", [], False), ("d", "r", "REVIEW", "t", None, "x", "will save money", [("a", "b")], "INSUFFICIENT_EVIDENCE", [], False)], schema)
    first, second = (r["errors"] for r in language.validate(df).orderBy(F.desc("action_type")).collect())
    assert len(first) == 2 and len(second) == 2


def test_priority(spark):
    row = spark.range(1).select(recommend.priority(F.lit("HIGH_EVIDENCE"), F.lit(True), F.lit(None).cast("boolean"), F.lit(True)).alias("p")).first()
    assert row["p"] == 12.0


def test_spearman_joins_rows_once_to_the_target_ranks(spark, monkeypatch):
    """One join for all factors, by the target alone; before, every (factor, x, y) pair was joined twice."""
    keys, attach = [], evidence.attach
    monkeypatch.setattr(evidence, "attach", lambda rows, lookup, on, **how: keys.append(on) or attach(rows, lookup, on, **how))
    df = spark.range(300).select(F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("a"), (F.col("id") * 7 % 11).alias("b"), F.lit(None).cast("long").alias("c"), (F.col("id") * 13 % 97 * 1.0).alias("y"))
    got = {r["factor"]: (r["n"], r["spearman_r"]) for r in evidence.spearman(df, "y", ["a", "b", "c"]).collect()}
    p = df.toPandas()
    assert keys == [["y"]] and set(got) == {"a", "b"}
    for c in "ab":
        both = p[[c, "y"]].dropna()
        assert got[c] == (len(both), pytest.approx(both[c].rank().corr(both["y"].rank()), abs=1e-6))


def test_mutual_information_counts_cells_with_gaps(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 4 != 0, F.col("id") * 7 % 13 * 1.0).alias("a"), F.when(F.col("id") % 9 != 0, F.col("id") * 11 % 17 * 1.0).alias("y"))
    row = evidence.mutual_information(df, "y", ["a"], "id").first()
    p = df.toPandas()
    cut = lambda s: sum((s > e).astype(int) for e in s.quantile([k / 16 for k in range(1, 16)])).where(s.notna())
    both = p.assign(a=cut(p["a"]), y=cut(p["y"]))[["a", "y"]].dropna()
    n = len(both)
    pa, py = both["a"].value_counts() / n, both["y"].value_counts() / n
    want = sum(c / n * math.log(c / n / (pa[a] * py[y])) for (a, y), c in both.value_counts().items())
    assert row["n"] == n and row["mi"] == pytest.approx(want, abs=1e-5)


def test_shared_ranks_give_the_signals_of_separate_ones(spark):
    # ties, gaps in factors and target, a factor without values, signed zeros
    rows = [(i, None if i % 11 == 0 else float(i * 7 % 97), float(i % 5) - 2.0, None if i % 3 == 0 else float(i * i % 101), -0.0 if i % 2 else 0.0, None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double, c double, d double")
    flagged, names = evidence.tail_event(df, "y")[0], ["a", "b", "c", "d"]
    ranks = evidence.factor_ranks(flagged, "y", names)
    read = lambda found: sorted(map(tuple, found.collect()))
    assert read(evidence.spearman(flagged, "y", names, ranks)) == read(evidence.spearman(flagged, "y", names))
    assert read(evidence.mann_whitney(flagged, names, ranks)) == read(evidence.mann_whitney(flagged, names))
    assert read(evidence.mutual_information(flagged, "y", names, "id", ranks=ranks)) == read(evidence.mutual_information(flagged, "y", names, "id"))
    bins = [k / 16 for k in range(1, 16)]
    assert evidence.rank_edges(ranks, "y", 16) == evidence.exact_quantiles(df, {c: bins for c in ["y", *names]})


def test_previous_row_crosses_runs_and_keeps_nulls(spark):
    from linelens.operators.split import with_previous

    df = spark.createDataFrame([(i, None if i % 4 == 0 else i * 10) for i in range(1000)], "id long, v long").repartition(7)
    got = {r["id"]: r["_prev_v"] for r in with_previous(df, ["id"], ["v"]).collect()}
    assert got == {i: None if (i - 1) % 1000 % 4 == 0 else (i - 1) % 1000 * 10 for i in range(1000)}
    assert with_previous(df.where("id = 5"), ["id"], ["v"]).first()["_prev_v"] == 50
    assert with_previous(df.where("id < 0"), ["id"], ["v"]).collect() == []
