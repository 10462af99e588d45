"""End-to-end runs over one process table: prepare, root cause, bottleneck."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.operators import align, clean, drift, evidence, features, flow, profile
from linelens.session import materialize


@dataclass
class Prepared:
    """A cleaned table with features, its column metadata and everything reported on the way."""

    name: str
    df: DataFrame
    meta_df: DataFrame
    meta: profile.Meta
    report: DataFrame
    lineage: DataFrame
    key: str
    order_cols: list[str]


def prepare(df: DataFrame, name: str, key: str, time_column: str | None = None, key_is_added: bool = False) -> Prepared:
    """Profile, clean and derive features; the result is written once and read by everything after.

    ``key`` identifies rows. Say ``key_is_added`` when it is a row number put on by the loader, so
    that two equal records still count as duplicates.
    """
    order = [c for c in dict.fromkeys([time_column, key]) if c]
    source = materialize(df)
    meta_df = materialize(profile.profile(source, name, order))
    meta = profile.Meta.of(meta_df)
    cleaned, report = clean.clean_table(source, meta, key if key_is_added else None)
    time = time_column if time_column in cleaned.columns and features.usable_time(cleaned, [time_column]) else None
    featured, lineage = features.build_features(cleaned, meta, name, time, key if key != time else None)
    return Prepared(name, materialize(featured), meta_df, meta, report, lineage, key, order if time else [])


def root_cause(df: DataFrame, meta_df: DataFrame, target: str, row_key: str, order_cols: list[str] | None = None, direction: str = "low",
               quantile: float = 0.1, responses: list[str] | None = None, states: DataFrame | None = None,
               importance: DataFrame | None = None, factors: list[str] | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """All evidence for one target: findings, stations, drift and event. No sampling."""
    spark = df.sparkSession
    flagged, event = evidence.tail_event(df, target, direction, quantile)
    if factors is None:
        factors, _ = evidence.select_factors(df.drop(row_key) if row_key not in (order_cols or []) else df, target, responses or [])
    ranks = evidence.factor_ranks(flagged, target, factors)  # one ranking for the three rank signals
    # one row per factor in each table below
    signals = evidence.correlations(flagged, target, factors).select("factor", "n", "pearson_r", "pearson_p")
    signals = signals.join(evidence.spearman(flagged, target, factors, ranks).drop("n"), "factor", "left")
    signals = signals.join(evidence.mutual_information(flagged, target, factors, row_key, seed, ranks=ranks).drop("n"), "factor", "left")
    signals = signals.join(evidence.group_effect(flagged, factors).drop("available"), "factor", "left")
    signals = signals.join(evidence.mann_whitney(flagged, factors, ranks), "factor", "left")
    if order_cols:
        t = evidence.temporal(flagged, target, factors, order_cols).drop("n").withColumnRenamed("available", "temporal_available")
        signals = signals.join(t, "factor", "left")
    else:
        signals = signals.select("*", F.lit(False).alias("temporal_available"), F.lit(None).cast("long").alias("change_position"),
                                 F.lit(None).cast("long").alias("event_onset_position"), F.lit(None).cast("boolean").alias("precedes"), F.lit(None).cast("double").alias("persistence"))
    if states is not None:
        e = evidence.anomaly_enrichment(flagged, states, row_key).first()
        known = (bool(e["available"]), e["enrichment"])
    else:
        known = (False, None)
    signals = signals.withColumn("anomaly_available", F.lit(known[0])).withColumn("enrichment", F.lit(known[1]).cast("double"))
    if importance is not None:
        signals = align.attach_importance(signals, importance)
    else:
        signals = signals.withColumn("importance", F.lit(None).cast("double")).withColumn("max_importance", F.lit(None).cast("double"))
    scored = align.attach_columns(evidence.score_factors(signals), meta_df)
    findings = materialize(evidence.explain(evidence.rank_findings(scored), event))
    drifted = drift.detect_drift(df, order_cols or [], factors)
    return {"findings": findings, "stations": evidence.rank_stations(findings),
            "drift": drifted, "drift_status": drift.drift_status(drifted, bool(order_cols)), "event": evidence.event_summary(flagged, event)}


def bottleneck(df: DataFrame, meta: profile.Meta, findings: DataFrame | None = None, outputs: list[str] | None = None, sequence: list[str] | None = None) -> dict[str, DataFrame | None]:
    """Ranked stations, candidate, observed impact, flow nodes and edges."""
    metrics = materialize(features.station_metrics(df, meta))
    stations = flow.attach_root_cause(flow.station_table(metrics), findings)
    ranked = materialize(flow.score_stations(stations))
    by_station = meta.stations()
    utilization = {s: sorted(m["utilization"])[0] for s, m in by_station.items() if m.get("utilization")}
    impact = flow.throughput_impact(df, utilization, outputs if outputs is not None else flow.impact_outputs(df.columns))
    placed = flow.infer_sequence(df.sparkSession, sorted(by_station), sequence)
    return {"stations": ranked, "candidate": flow.pick_candidate(ranked), "impact": impact, "nodes": flow.flow_nodes(ranked, placed),
            "edges": flow.flow_edges(placed) if placed is not None else None, "metrics": metrics,
            "what_if": flow.what_if_inputs(ranked, impact), "blocking": flow.blocking_starvation(df.sparkSession, placed is not None)}
