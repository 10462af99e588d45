"""Bottleneck evidence per station, observed throughput impact, flow sequence and timeline."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import at_most, finite, is_numeric, known_count, q, rounded, row_sum, stack_rows, weighted_score
from linelens.operators.features import base_name
from linelens.operators.ordered import exact_quantiles, with_row_index

PRESSURES = [("utilization", "utilization_pressure"), ("queue_wait", "queue_pressure"), ("cycle_time", "cycle_time_pressure"),
             ("throughput", "throughput_constraint")]
IMPACT_ROWS = 30


def high_tie_rank(value: Column, keys: list[str] | None = None) -> Column:
    """Share of the other values at or below this one; ties take their highest place; alone it is 1."""
    upto = W.partitionBy(*(keys or [])).orderBy(value.asc_nulls_last()).rangeBetween(W.unboundedPreceding, W.currentRow)
    n = F.count(value).over(W.partitionBy(*(keys or [])))
    return F.when(value.isNotNull(), F.when(n <= 1, 1.0).otherwise((F.count(value).over(upto) - 1) / (n - 1)))


def station_table(metrics: DataFrame) -> DataFrame:
    """One row per station: mean of each tracked metric and the largest sample count."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    counted = F.col("metric").isin([m for m, _ in PRESSURES])
    return metrics.groupBy("station").agg(
        *[pick(m, "mean").alias(f"{m}_mean") for m in fixed.TRACKED_METRICS],
        *[pick(m, "max").alias(f"{m}_max") for m in fixed.TRACKED_METRICS],
        *[pick(m, "samples").alias(f"{m}_samples") for m in fixed.TRACKED_METRICS],
        F.coalesce(F.max(F.when(counted, F.col("samples"))), F.lit(0)).alias("samples"))


def attach_root_cause(stations: DataFrame, findings: DataFrame | None) -> DataFrame:
    """Best score and factor, all factors by rank and the largest enrichment per station (findings: one row per column)."""
    if findings is None:
        return stations.select("*", F.lit(None).cast("double").alias("rca_score"), F.lit(None).cast("string").alias("rca_factor"),
                               F.lit(None).cast("string").alias("rca_factors"), F.lit(None).cast("double").alias("enrichment"))
    scored = F.when(F.col("evidence_score").isNotNull(), F.struct("evidence_score", -F.col("rank")))
    names = F.transform(F.sort_array(F.collect_list(F.struct("rank", "factor"))), lambda s: s["factor"])
    per = findings.where("station is not null").groupBy("station").agg(
        F.max("evidence_score").alias("rca_score"), F.max_by("factor", scored).alias("rca_factor"),
        F.array_join(names, ", ").alias("rca_factors"), F.max("enrichment").alias("enrichment"))
    return stations.join(F.broadcast(per), "station", "left")


def attach_drift(station_columns: DataFrame, drift: DataFrame) -> DataFrame:
    """(station, metric, column) rows whose column drifted. ``station_columns`` has an array ``columns``."""
    rows = station_columns.select("station", "metric", F.explode("columns").alias("column"))
    return rows.join(F.broadcast(drift.where("drift_detected").select("column", "peak_ewma_z", "direction", "change_position")), "column")


def score_stations(stations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pressure components, weighted score, consistency, quality, rank and status per station.

    ``stations`` comes from station_table + attach_root_cause: one row per station.
    """
    part = {}
    for metric, name in PRESSURES:
        rank = high_tie_rank(F.col(f"{metric}_mean"), keys)
        part[name] = 1.0 - rank if metric == "throughput" else rank
    part["root_cause_evidence"] = at_most(F.col("rca_score") / 100.0, 1.0)
    part["anomaly_evidence"] = at_most(F.col("enrichment") / 3.0, 1.0)
    with_parts = stations.select("*", *[c.alias(n) for n, c in part.items()])
    cols = {n: F.col(n) for n in part}
    score, available = weighted_score(cols, fixed.STATION_WEIGHTS)
    listed = F.filter(F.array(*cols.values()), lambda x: x.isNotNull())
    high = F.size(F.filter(listed, lambda x: x >= 0.5))
    scored = with_parts.select("*", score.alias("evidence_score"), available.alias("available_components"), high.alias("_high"))
    share = F.greatest(F.col("_high"), F.col("available_components") - F.col("_high")) / F.col("available_components")
    scored = scored.withColumn("consistency", F.when(F.col("evidence_score").isNotNull(), F.round(share, 4)))
    n_stations = F.count(F.lit(1)).over(W.partitionBy(*(keys or [])))
    scored = scored.withColumn("evidence_quality", evidence_quality(
        F.col("evidence_score"), F.col("available_components"), F.col("consistency"), F.col("samples"), n_stations == 1))
    fallback = 100.0 * row_sum(list(cols.values())) / F.greatest(known_count(list(cols.values())), F.lit(1))
    order = W.partitionBy(*(keys or [])).orderBy(
        F.col("evidence_score").isNull(), F.coalesce("evidence_score", fallback).desc_nulls_last(), "station")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    out = ranked.withColumn("status", station_status(F.col("rank"), F.col("evidence_score"), F.col("evidence_quality")))
    return out.select(*[F.round(F.col(c), 4).alias(c) if c in part else F.col(c) for c in out.columns if c != "_high"])


def evidence_quality(score: Column, components: Column, consistency: Column, samples: Column, single: Column) -> Column:
    return (F.when(score.isNull(), "INSUFFICIENT_EVIDENCE")
            .when(single | (samples < 200), "LIMITED_EVIDENCE")
            .when((components >= 4) & (consistency >= 0.75), "HIGH_EVIDENCE")
            .when((components >= 3) & (consistency >= 0.6), "MODERATE_EVIDENCE")
            .otherwise("LIMITED_EVIDENCE"))


def station_status(rank: Column, score: Column, quality: Column) -> Column:
    good = quality.isin("HIGH_EVIDENCE", "MODERATE_EVIDENCE")
    return (F.when(score.isNull(), "INSUFFICIENT_EVIDENCE")
            .when((rank == 1) & good & (score >= 40), "CANDIDATE_BOTTLENECK")
            .when(score >= 40, "POSSIBLE_CONTRIBUTOR").otherwise("NOT_CONSTRAINED"))


def pick_candidate(ranked: DataFrame) -> DataFrame:
    """The best-ranked station that may be the constraint, with the components that speak for it."""
    hit = ranked.where(F.col("status").isin("CANDIDATE_BOTTLENECK", "POSSIBLE_CONTRIBUTOR"))
    best = hit.agg(F.min_by(F.struct(*[F.col(c) for c in ranked.columns]), "rank").alias("s"))
    names = list(fixed.STATION_WEIGHTS)
    why = F.array_compact(F.array(*[F.when(F.col(f"s.{n}").isNotNull(), F.concat(F.lit(f"{n}: "), F.format_number(F.col(f"s.{n}"), 4))) for n in names]))
    gone = F.array_compact(F.array(*[F.when(F.col(f"s.{m}_mean").isNull(), F.lit(m)) for m, _ in PRESSURES], F.lit("capacity")))
    found = F.col("s").isNotNull()
    return best.select(
        F.col("s.station").alias("station"), F.col("s.evidence_score").alias("evidence_score"), F.col("s.evidence_quality").alias("evidence_quality"),
        F.coalesce("s.status", F.lit("NO_CANDIDATE_WITH_SUFFICIENT_EVIDENCE")).alias("status"),
        F.when(found, F.array_join(why, "; ")).otherwise("").alias("why"),
        F.when(found, F.array_join(gone, ", ")).otherwise("").alias("unavailable_metrics"))


def throughput_impact(df: DataFrame, utilization: dict[str, str], outputs: list[str]) -> DataFrame:
    """Observed mean output above and below the 75th utilization percentile, per station and output.

    An observed comparison, not a prediction. One scan for all stations and outputs.
    """
    spark = df.sparkSession
    schema = ("station string, output_column string, status string, threshold double, constrained_mean double, unconstrained_mean double, "
              "difference double, relative_difference double, constrained_rows long, unconstrained_rows long")
    outputs = [c for c in outputs if c in df.columns and is_numeric(df.schema[c].dataType)]
    pairs = [(s, c) for s, c in utilization.items() if c in df.columns]
    if not outputs or not pairs:
        return spark.createDataFrame([(s, None, "NOT_AVAILABLE_FROM_DATASET", *[None] * 7) for s in utilization], schema)
    columns = sorted({c for _, c in pairs})
    cuts = exact_quantiles(df, {c: [0.75] for c in columns})
    aggs = []
    for i, (s, c) in enumerate(pairs):
        u, cut = finite(q(c)), F.lit(cuts[c][0])
        aggs.append(F.count(u).alias(f"u{i}"))
        for j, o in enumerate(outputs):
            for k, cond in (("a", u >= cut), ("b", u < cut)):
                v = F.when(cond, finite(q(o)))
                aggs += [F.avg(v).alias(f"m{k}{i}_{j}"), F.count(v).alias(f"n{k}{i}_{j}")]
    rows = stack_rows(df.agg(*aggs), [
        {"station": F.lit(s), "output_column": F.lit(o), "threshold": F.lit(cuts[c][0]).cast("double"), "u": F.col(f"u{i}"),
         "ma": F.col(f"ma{i}_{j}"), "mb": F.col(f"mb{i}_{j}"), "na": F.col(f"na{i}_{j}"), "nb": F.col(f"nb{i}_{j}")}
        for i, (s, c) in enumerate(pairs) for j, o in enumerate(outputs)])
    ok = (F.col("u") >= 2 * IMPACT_ROWS) & (F.col("na") >= IMPACT_ROWS) & (F.col("nb") >= IMPACT_ROWS)
    diff = F.col("ma") - F.col("mb")
    when = lambda c: F.when(ok, c)
    return rows.select(
        "station", "output_column", F.when(ok, "OBSERVED_COMPARISON").otherwise("INSUFFICIENT_DATA").alias("status"),
        rounded(F.col("threshold")).alias("threshold"), when(rounded(F.col("ma"))).alias("constrained_mean"),
        when(rounded(F.col("mb"))).alias("unconstrained_mean"), when(rounded(diff)).alias("difference"),
        when(F.when(F.col("mb") != 0, rounded(diff / F.col("mb")))).alias("relative_difference"),
        F.col("na").alias("constrained_rows"), F.col("nb").alias("unconstrained_rows"))


def impact_outputs(columns: list[str]) -> list[str]:
    return [c for c in columns if any(h in c.lower() for h in fixed.IMPACT_OUTPUT_HINTS)]


# --- flow sequence

def known_sequence(sequence: list[str] | None, stations: list[str]) -> list[str] | None:
    """The stations of a stated sequence that the data has; None with fewer than two."""
    present = [s for s in sequence or [] if s in stations]
    return present if len(present) >= 2 else None


def suffix_sequence(stations: list[str]) -> list[str] | None:
    """Order by numeric suffix inside a shared base name, where at least two stations have one."""
    groups: dict[str, list[tuple[int, str]]] = {}
    for s in stations:
        base = base_name(s)
        if base != s:
            groups.setdefault(base, []).append((int(re.sub(r"^\D+", "", s) or 0), s))
    ordered = [s for base in sorted(groups) for _, s in sorted(groups[base], key=lambda t: t[0])]
    return ordered if len(ordered) >= 2 else None


def infer_sequence(spark, stations: list[str], sequence: list[str] | None = None) -> DataFrame | None:
    """(pos, station) from a stated sequence or from numeric suffixes; None when neither applies."""
    order = known_sequence(sequence, stations) or suffix_sequence(stations)
    return spark.createDataFrame(list(enumerate(order)), "pos int, station string") if order else None


def flow_edges(sequence: DataFrame) -> DataFrame:
    """Neighbours in sequence order (one row per station, so one window)."""
    nxt = F.lead("station").over(W.orderBy("pos"))
    return sequence.select("pos", F.col("station").alias("from_station"), nxt.alias("to_station")).where("to_station is not null")


def flow_nodes(stations: DataFrame, sequence: DataFrame | None) -> DataFrame:
    """Stations with their place; outside the sequence the place is null."""
    if sequence is None:
        return stations.select("station", F.lit(None).cast("int").alias("pos"), F.lit("PARTIALLY_SUPPORTED").alias("flow_status"))
    return stations.select("station").join(F.broadcast(sequence), "station", "left").withColumn("flow_status", F.lit("SUPPORTED"))


def blocking_starvation(spark, ordered: bool) -> DataFrame:
    reason = ("only totals are recorded, not each unit's way in and out" if ordered else "no defensible station ordering")
    return spark.createDataFrame([(k, "NOT_SUPPORTED", reason) for k in ("blocking", "starvation")], "kind string, status string, reason string")


def outside_sequence(stations: DataFrame, sequence: DataFrame) -> DataFrame:
    return stations.select("station").join(F.broadcast(sequence), "station", "left_anti")


def compare_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, place) of each distinct value: BOTH (intersect), LEFT or RIGHT (except). A null is a value like any other."""
    a, b = left.select(key), right.select(key)
    return a.intersect(b).withColumn("place", F.lit("BOTH")).unionByName(a.subtract(b).withColumn("place", F.lit("LEFT"))).unionByName(
        b.subtract(a).withColumn("place", F.lit("RIGHT")))


# --- timeline

def timeline_columns(columns: list[str], stations: list[str]) -> list[tuple[str, str, str]]:
    """(station, metric, column): for every station each metric that has a matching column."""
    found = []
    for s in stations:
        for metric, _, aliases in fixed.TIMELINE_ALIASES:
            hit = next((c for a in aliases for c in columns if s.lower() in c.lower() and a in c.lower()), None)
            if hit:
                found.append((s, metric, hit))
    return found


def timeline_bins(df: DataFrame, order_cols: list[str], picked: list[tuple[str, str, str]], bins: int = 48) -> DataFrame:
    """Mean of each picked column per run of consecutive rows, about ``bins`` of them."""
    bins = max(1, int(bins))
    columns = sorted({c for _, _, c in picked})
    indexed = with_row_index(df.select(*[q(c) for c in dict.fromkeys([*order_cols, *columns])]), order_cols)
    n = df.count()
    wide = indexed.groupBy(F.floor(F.col("row_index") / max(1, n // bins)).cast("int").alias("bin")).agg(
        *[F.avg(finite(q(c))).alias(f"m{i}") for i, c in enumerate(columns)], *[F.count(finite(q(c))).alias(f"n{i}") for i, c in enumerate(columns)])
    long = stack_rows(wide, [{"station": F.lit(s), "metric": F.lit(m), "column": F.lit(c), "value": F.col(f"m{columns.index(c)}"), "n": F.col(f"n{columns.index(c)}")}
                             for s, m, c in picked], keep=["bin"])
    enough = long.groupBy("station", "column").agg(F.sum("n").alias("_total")).where(F.col("_total") >= bins).select("station", "column")
    return long.where("value is not null").join(F.broadcast(enough), ["station", "column"]).select(
        "station", "metric", "column", "bin", F.round("value", 4).alias("value"))


def drift_markers(drift: DataFrame, rows: int, bins: int) -> DataFrame:
    """Bin of the change point of every column that drifted."""
    return drift.where("drift_detected").select(
        "column", F.round(F.col("change_position") / max(rows, 1) * bins).cast("int").alias("bin"), "direction", "peak_ewma_z")


def event_markers(flagged: DataFrame, event_col: str, order_cols: list[str], bins: int) -> DataFrame:
    """Bins that hold at least one event row."""
    n = flagged.count()
    indexed = with_row_index(flagged.select(*[q(c) for c in order_cols], q(event_col)), order_cols)
    hit = indexed.where(q(event_col)).select(F.floor(F.col("row_index") / max(1, n // bins)).cast("int").alias("bin"))
    return hit.distinct()


def what_if_inputs(ranked: DataFrame, impact: DataFrame) -> DataFrame:
    """Current metrics of the candidate and its observed outputs, as input for the economics."""
    candidate = pick_candidate(ranked).where("station is not null").select("station")
    current = ranked.join(F.broadcast(candidate), "station").select(
        "station", F.col("utilization_mean").alias("current_utilization"), F.col("queue_wait_mean").alias("current_queue"),
        F.col("cycle_time_mean").alias("current_cycle_time"))
    observed = impact.where("status = 'OBSERVED_COMPARISON'").select("station", "output_column", "constrained_mean", "unconstrained_mean")
    return current.join(F.broadcast(observed), "station", "left")
