"""Stations, flow, timeline, economics and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import rounded
from linelens.operators import anomaly, drift, economics, evidence, features, flow, profile, recommend
from linelens.operators.language import gate_texts
from linelens.plans import process as runs
from linelens.plans.catalog.base import H, O, hourly, meta_of, orders, query, r, sql_metric, union_all
from linelens.plans.catalog.causes import DRIFT_COLUMNS, EV, FACTORS, QUICK, Y, _DRIFT, drift_sql, quick_findings, robust_states, state_sql
from linelens.session import materialize
from linelens.sources import views as V


# --- station scores

@query("b1_percentile_rank_high_ties", f"""WITH s AS (SELECT s_nationkey AS k, count(*) AS n, round(avg(s_acctbal::DOUBLE), 2) AS v FROM supplier GROUP BY s_nationkey)
  SELECT k, {r('(count(*) OVER (ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)::DOUBLE / (count(*) OVER () - 1)')} AS rank_n,
  {r('(count(*) OVER (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)::DOUBLE / (count(*) OVER () - 1)')} AS rank_v FROM s""")
def b1(spark, sf):
    per = V.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("s_acctbal").cast("double")), 2).alias("v"))
    return per.select("k", flow.high_tie_rank(F.col("n")).alias("rank_n"), flow.high_tie_rank(F.col("v")).alias("rank_v"))


# station-like rows per brand, with gaps and ties, so that every branch is hit
_BRAND = """SELECT p_brand AS station, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE round(avg(p_size), 0) / 50 END AS utilization_mean, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE round(avg(p_retailprice), 0) END AS queue_wait_mean,
  CASE WHEN count(*) % 5 = 0 THEN NULL ELSE round(max(p_retailprice), 0) END AS cycle_time_mean, CASE WHEN count(*) % 2 = 0 THEN NULL ELSE round(min(p_retailprice), 0) END AS throughput_mean,
  CASE WHEN count(*) % 7 = 0 THEN NULL ELSE (count(*) % 100) END AS rca_score, CASE WHEN count(*) % 6 = 0 THEN NULL ELSE (count(*) % 5) END AS enrichment, count(*) * 3 AS samples FROM part GROUP BY p_brand"""
_PR = "(count({c}) OVER (ORDER BY {c} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)::DOUBLE / (count({c}) OVER () - 1)"
_BS = f"""WITH b AS ({_BRAND}), c AS (SELECT *, {', '.join(f"CASE WHEN {m}_mean IS NOT NULL THEN {'1 - ' if m == 'throughput' else ''}{_PR.format(c=m + '_mean')} END AS {n}" for m, n in flow.PRESSURES)},
  CASE WHEN rca_score IS NOT NULL THEN least(rca_score / 100.0::DOUBLE, 1) END AS root_cause_evidence, CASE WHEN enrichment IS NOT NULL THEN least(enrichment / 3.0::DOUBLE, 1) END AS anomaly_evidence FROM b),
  d AS (SELECT *, {' + '.join(f'CASE WHEN {n} IS NULL THEN 0 ELSE 1 END' for n in fixed.STATION_WEIGHTS)} AS k, {' + '.join(f'coalesce({n} * {w}::DOUBLE, 0)' for n, w in fixed.STATION_WEIGHTS.items())} AS top,
    {' + '.join(f'CASE WHEN {n} IS NULL THEN 0 ELSE {w}::DOUBLE END' for n, w in fixed.STATION_WEIGHTS.items())} AS bottom, {' + '.join(f'CASE WHEN {n} >= 0.5 THEN 1 ELSE 0 END' for n in fixed.STATION_WEIGHTS)} AS high,
    {' + '.join(f'coalesce({n}, 0)' for n in fixed.STATION_WEIGHTS)} AS plain FROM c),
  e AS (SELECT *, CASE WHEN k >= 2 THEN round(100 * top / bottom, 3) END AS score, CASE WHEN k >= 2 THEN round(greatest(high, k - high)::DOUBLE / k, 4) END AS consistency, count(*) OVER () = 1 AS single FROM d),
  f AS (SELECT *, CASE WHEN score IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN single OR samples < 200 THEN 'LIMITED_EVIDENCE' WHEN k >= 4 AND consistency >= 0.75 THEN 'HIGH_EVIDENCE' WHEN k >= 3 AND consistency >= 0.6 THEN 'MODERATE_EVIDENCE' ELSE 'LIMITED_EVIDENCE' END AS quality FROM e),
  g AS (SELECT *, row_number() OVER (ORDER BY score IS NULL, coalesce(score, 100 * plain / greatest(k, 1)) DESC, station) AS rank FROM f),
  s AS (SELECT *, CASE WHEN score IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN rank = 1 AND quality IN ('HIGH_EVIDENCE', 'MODERATE_EVIDENCE') AND score >= 40 THEN 'CANDIDATE_BOTTLENECK' WHEN score >= 40 THEN 'POSSIBLE_CONTRIBUTOR' ELSE 'NOT_CONSTRAINED' END AS status FROM g)"""


def brand_scores(spark, sf):
    b = V._run(spark, _BRAND, sf, "part")
    none = F.lit(None).cast("double")
    return flow.score_stations(b.select("*", none.alias("wip_storage_mean")))


@query("b2_station_score", f"{_BS} SELECT station, {r('score', 3)} AS evidence_score, CAST(k AS INTEGER) AS available_components FROM s", digits=3)
def b2(spark, sf):
    return brand_scores(spark, sf).select("station", "evidence_score", "available_components")


@query("b3_consistency", f"{_BS} SELECT station, {r('consistency')} AS consistency FROM s")
def b3(spark, sf):
    return brand_scores(spark, sf).select("station", "consistency")


@query("b4_evidence_quality", f"{_BS} SELECT quality AS evidence_quality, count(*) AS stations FROM s GROUP BY quality")
def b4(spark, sf):
    return brand_scores(spark, sf).groupBy("evidence_quality").agg(F.count(F.lit(1)).alias("stations"))


@query("b5_station_status", f"{_BS} SELECT station, status FROM s")
def b5(spark, sf):
    return brand_scores(spark, sf).select("station", "status")


def _station_sql(name: str, cte: str, t: str, columns: list[str]) -> str:
    """Full ranking of a view's stations from utilization, queue and cycle time alone."""
    rows = union_all([f"SELECT '{sql_metric(c)[0]}', '{sql_metric(c)[1]}', {c} FROM {t} WHERE {c} IS NOT NULL" for c in columns])
    w = {"utilization": 0.28, "queue_wait": 0.24, "cycle_time": 0.14}
    pick = ", ".join(f"max(CASE WHEN metric = '{m}' THEN mean END) AS {m}" for m in w)
    comp = ", ".join(f"CASE WHEN {m} IS NOT NULL THEN {_PR.format(c=m)} END AS c_{m}" for m in w)
    return f"""{cte}, l AS (SELECT * FROM ({rows}) q(station, metric, v)), m AS (SELECT station, metric, round(avg(v), 6) AS mean, count(*) AS n FROM l GROUP BY station, metric),
      a AS (SELECT station, {pick}, max(n) AS samples FROM m GROUP BY station), c AS (SELECT *, {comp} FROM a),
      d AS (SELECT *, {' + '.join(f'CASE WHEN c_{m} IS NULL THEN 0 ELSE 1 END' for m in w)} AS k, {' + '.join(f'CASE WHEN c_{m} >= 0.5 THEN 1 ELSE 0 END' for m in w)} AS high,
        round(100 * ({' + '.join(f'coalesce(c_{m} * {x}::DOUBLE, 0)' for m, x in w.items())}) / ({' + '.join(f'CASE WHEN c_{m} IS NULL THEN 0 ELSE {x}::DOUBLE END' for m, x in w.items())}), 3) AS score FROM c),
      e AS (SELECT *, round(greatest(high, k - high)::DOUBLE / k, 4) AS cons, row_number() OVER (ORDER BY score DESC, station) AS rank FROM d),
      f AS (SELECT *, CASE WHEN samples < 200 THEN 'LIMITED_EVIDENCE' WHEN k >= 4 AND cons >= 0.75 THEN 'HIGH_EVIDENCE' WHEN k >= 3 AND cons >= 0.6 THEN 'MODERATE_EVIDENCE' ELSE 'LIMITED_EVIDENCE' END AS quality FROM e),
      {name} AS (SELECT *, CASE WHEN rank = 1 AND quality <> 'LIMITED_EVIDENCE' AND score >= 40 THEN 'CANDIDATE_BOTTLENECK' WHEN score >= 40 THEN 'POSSIBLE_CONTRIBUTOR' ELSE 'NOT_CONSTRAINED' END AS status FROM f)"""


_SH = _station_sql("st", H, "h", V.HOURLY_METRICS)
_SO = _station_sql("st", O, "o", V.ORDER_METRICS)
_OUT = f" SELECT station, {r('score', 3)} AS evidence_score, CAST(k AS INTEGER) AS available_components, {r('cons')} AS consistency, quality AS evidence_quality, CAST(rank AS INTEGER) AS rank, status FROM st"
_COLS = ["station", "evidence_score", "available_components", "consistency", "evidence_quality", "rank", "status"]


def ranked_stations(df):
    """One scan: the column profile gives roles and station metrics at once."""
    metrics = features.station_metrics_from_profile(profile.classify_roles(profile.column_facts(df)))
    return flow.score_stations(flow.attach_root_cause(flow.station_table(metrics), None))


@query("b6_rank_stations", _SH + _OUT)
def b6(spark, sf):
    """Flagship: events to hourly process rows to station metrics to ranked constraint evidence."""
    return ranked_stations(hourly(spark, sf)).select(*_COLS)


@query("b6_rank_stations_orders", _SO + _OUT)
def b6_orders(spark, sf):
    return ranked_stations(orders(spark, sf)).select(*_COLS)


@query("b6_rank_stations_fallback", f"{_BS} SELECT station, CAST(rank AS INTEGER) AS rank FROM s")
def b6_fallback(spark, sf):
    return brand_scores(spark, sf).select("station", "rank")


@query("b7_pick_candidate", f"{_SH} SELECT coalesce((SELECT arg_min(station, rank) FROM st WHERE status IN ('CANDIDATE_BOTTLENECK', 'POSSIBLE_CONTRIBUTOR')), NULL) AS station, (SELECT arg_min(status, rank) FROM st WHERE status IN ('CANDIDATE_BOTTLENECK', 'POSSIBLE_CONTRIBUTOR')) AS status, 'throughput, capacity' AS unavailable_metrics")
def b7(spark, sf):
    return flow.pick_candidate(ranked_stations(hourly(spark, sf, True))).select("station", "status", "unavailable_metrics")


_UT = {s: f"{s}_Util" for s in V.EVENT_STATIONS}
_UO = {f"Line{n}": f"Line{n}_Util" for n in range(1, 8)}


def _impact_sql(cte, t, util):
    parts = []
    for s, c in util.items():
        parts.append(f"SELECT '{s}' AS station, (SELECT quantile_cont({c}, 0.75) FROM {t}) AS cut, avg({Y}) FILTER (WHERE {c} >= (SELECT quantile_cont({c}, 0.75) FROM {t})) AS a, avg({Y}) FILTER (WHERE {c} < (SELECT quantile_cont({c}, 0.75) FROM {t})) AS b, "
                     f"count(*) FILTER (WHERE {c} >= (SELECT quantile_cont({c}, 0.75) FROM {t})) AS na, count(*) FILTER (WHERE {c} < (SELECT quantile_cont({c}, 0.75) FROM {t})) AS nb FROM {t}")
    return (f"{cte}, q AS ({union_all(parts)}) SELECT station, '{Y}' AS output_column, 'OBSERVED_COMPARISON' AS status, {r('cut')} AS threshold, {r('a', 2)} AS constrained_mean, {r('b', 2)} AS unconstrained_mean, "
            f"{r('a - b', 2)} AS difference, na AS constrained_rows, nb AS unconstrained_rows FROM q")


def _impact(df, util):
    out = flow.throughput_impact(df, util, [Y]).drop("relative_difference")
    return out.select("station", "output_column", "status", "threshold", *[rounded(F.col(c), 2).alias(c) for c in ("constrained_mean", "unconstrained_mean", "difference")], "constrained_rows", "unconstrained_rows")


@query("b8_throughput_impact", _impact_sql(H, "h", _UT))
def b8(spark, sf):
    return _impact(hourly(spark, sf, True), _UT)


@query("b8_throughput_impact_orders", _impact_sql(O, "o", _UO))
def b8_orders(spark, sf):
    return _impact(orders(spark, sf, True), _UO)


_SEQ = "(VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase')) q(pos, station)"


def _sequence(spark):
    return spark.createDataFrame([(0, "view"), (1, "click"), (2, "signup"), (3, "purchase")], "pos int, station string")


@query("b9_flow_sequence", f"SELECT s.station, q.pos, 'SUPPORTED' AS flow_status FROM (SELECT DISTINCT event_type AS station FROM events) s LEFT JOIN {_SEQ} ON q.station = s.station")
def b9(spark, sf):
    return flow.flow_nodes(V.table(spark, sf, "events").select(F.col("event_type").alias("station")).distinct(), _sequence(spark))


@query("b9_flow_edges", f"{O}, s AS (SELECT DISTINCT 'Line' || CAST(l_linenumber AS VARCHAR) AS station, l_linenumber AS n FROM lineitem) SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS pos, station AS from_station, lead(station) OVER (ORDER BY n) AS to_station FROM s QUALIFY to_station IS NOT NULL")
def b9_edges(spark, sf):
    """Line1..Line7 have no documented sequence; their numeric suffixes give one."""
    m = meta_of(orders(spark, sf))
    return flow.flow_edges(flow.infer_sequence(spark, sorted(m.stations())))


@query("j13_stations_outside_sequence", f"SELECT DISTINCT event_type AS station FROM events WHERE event_type NOT IN (SELECT station FROM {_SEQ})")
def j13(spark, sf):
    return flow.outside_sequence(V.table(spark, sf, "events").select(F.col("event_type").alias("station")).distinct(), _sequence(spark))


@query("b11_what_if_inputs", f"""{_SH}, cand AS (SELECT arg_min(station, rank) AS s FROM st WHERE status IN ('CANDIDATE_BOTTLENECK', 'POSSIBLE_CONTRIBUTOR')), i AS (SELECT * FROM ({_impact_sql(H, 'h', _UT)}))
  SELECT st.station, {r('st.utilization')} AS current_utilization, {r('st.queue_wait')} AS current_queue, {r('st.cycle_time')} AS current_cycle_time, i.output_column, i.unconstrained_mean FROM st JOIN cand ON cand.s = st.station LEFT JOIN i ON i.station = st.station""")
def b11(spark, sf):
    df = hourly(spark, sf, True)
    out = flow.what_if_inputs(ranked_stations(df), _impact(df, _UT))
    return out.select("station", "current_utilization", "current_queue", "current_cycle_time", "output_column", "unconstrained_mean")


@query("b12_timeline_bins", f"{H}, k AS (SELECT *, (row_number() OVER (ORDER BY Time_Now) - 1) // greatest(1, (SELECT count(*) FROM h) // 48) AS bin FROM h) SELECT * FROM (" + union_all(
    [f"SELECT '{s}' AS station, '{m}' AS metric, '{s}_{x}' AS \"column\", CAST(bin AS INTEGER) AS bin, {r(f'avg({s}_{x})')} AS \"value\" FROM k GROUP BY bin" for s in V.EVENT_STATIONS for m, x in (("utilization", "Util"), ("queue", "Queue"), ("cycle", "Cycle"))]) + ") q WHERE \"value\" IS NOT NULL")
def b12(spark, sf):
    df = hourly(spark, sf, True)
    return flow.timeline_bins(df, ["Time_Now"], flow.timeline_columns(df.columns, V.EVENT_STATIONS), 48)


@query("b13_timeline_markers", f"""{H}, k AS (SELECT {EV.format(t='h')} AS e, (row_number() OVER (ORDER BY Time_Now) - 1) // greatest(1, (SELECT count(*) FROM h) // 48) AS bin FROM h) SELECT DISTINCT CAST(bin AS INTEGER) AS bin FROM k WHERE e""")
def b13(spark, sf):
    ev, _ = evidence.tail_event(hourly(spark, sf, True), Y)
    return flow.event_markers(ev, evidence.EVENT, ["Time_Now"], 48)


@query("b13_drift_markers", f"""{drift_sql(['Time_Now', *DRIFT_COLUMNS])} SELECT t.c AS "column", CAST(round(u.i / (SELECT count(*) FROM h)::DOUBLE * 48) AS INTEGER) AS bin, CASE WHEN t.y > 0 THEN 'increase' ELSE 'decrease' END AS direction, {r('round(abs(t.y), 4)', 3)} AS peak_ewma_z
  FROM t JOIN u USING (c) WHERE t.rk = 1 AND u.rk = 1 AND abs(t.y) >= 3""", digits=3)
def b13_drift(spark, sf):
    df = hourly(spark, sf, True)
    return flow.drift_markers(drift.detect_drift(df, ["Time_Now"], ["Time_Now", *DRIFT_COLUMNS]), df.count(), 48)


@query("b14_bottleneck_run", None)
def b14(spark, sf):
    """Stations ranked with root-cause evidence attached."""
    df = hourly(spark, sf, True)
    return runs.bottleneck(df, meta_of(df), materialize(quick_findings(spark, sf)[0]), outputs=[Y])["stations"]


@query("j8_attach_rca_to_station", f"""{QUICK}, s AS (SELECT DISTINCT event_type AS station FROM events), a AS (SELECT station, max(score) AS best, arg_min(factor, rank) AS f, string_agg(factor, ', ' ORDER BY rank) AS fs FROM k WHERE station IS NOT NULL GROUP BY station)
  SELECT s.station, {r('best', 3)} AS rca_score, f AS rca_factor, fs AS rca_factors FROM s LEFT JOIN a USING (station)""", digits=3)
def j8(spark, sf):
    stations = V.table(spark, sf, "events").select(F.col("event_type").alias("station")).distinct()
    return flow.attach_root_cause(stations, materialize(quick_findings(spark, sf)[0])).select("station", "rca_score", "rca_factor", "rca_factors")


_STATION_OF = ", ".join("('{}', '{}', '{}')".format(c, *sql_metric(c)) for c in V.HOURLY_METRICS)


@query("j9_attach_drift_to_station", f"{_DRIFT} SELECT m.station, m.metric, t.c AS \"column\" FROM t JOIN (VALUES {_STATION_OF}) m(c, station, metric) ON m.c = t.c WHERE t.rk = 1 AND abs(t.y) >= 0.4")
def j9(spark, sf):
    """Station columns joined with the columns that moved by at least 0.4 z."""
    df = hourly(spark, sf, True)
    moved = drift.detect_drift(df, ["Time_Now"], DRIFT_COLUMNS).withColumn("drift_detected", F.col("peak_ewma_z") >= 0.4)
    return flow.attach_drift(profile.station_map(profile.classify_roles(profile.column_facts(df))), moved).select("station", "metric", "column")


# --- economics: assumptions and scenarios are keyed by nation, as if every nation were a plant

_PLANTS = """SELECT 'n' || CAST(s_nationkey AS VARCHAR) AS dataset_id, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM supplier GROUP BY s_nationkey"""
_GIVEN = {  # field -> expression over (n, bal); null means not supplied
    "contribution_margin_per_unit": "CASE WHEN n % 4 = 0 THEN NULL ELSE 25.0 + n % 3 END", "working_hours_per_day": "8.0", "working_days_per_month": "CASE WHEN n % 3 = 0 THEN NULL ELSE 22.0 END",
    "scrap_cost_per_unit": "4.0", "expected_defect_rate": "0.05", "rework_cost_per_unit": "CASE WHEN n % 2 = 0 THEN 3.0 END", "expected_rework_rate": "0.02",
    "downtime_hours_per_day": "CASE WHEN n % 5 = 0 THEN 1.5 END", "downtime_cost_per_hour": "120.0", "intervention_cost": "1000.0 * n"}


def _spark_sql(e: str) -> str:
    return e.replace("::DOUBLE", "")


def plants(spark, sf):
    t = V.table(spark, sf, "supplier")
    return t.groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dataset_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("s_acctbal").cast("double")), 2).alias("bal"))


def assumption_rows(spark, sf):
    """Updates as users would send them, one row per field and plant (text, with a time)."""
    p = plants(spark, sf)
    cells = [F.struct(F.lit(f).alias("field"), F.expr(f"CAST(CAST({e} AS DOUBLE) AS STRING)").alias("raw")) for f, e in _GIVEN.items()]
    cells.append(F.struct(F.lit("currency").alias("field"), F.when(F.col("n") % 7 != 0, F.lit(" eur ")).alias("raw")))
    return p.select("dataset_id", F.explode(F.array(*cells)).alias("s")).select("dataset_id", "s.field", "s.raw", F.lit(1).alias("at"))


def assumptions(spark, sf):
    return economics.merge_assumptions(economics.validate_assumptions(assumption_rows(spark, sf)))


_W = f"WITH p AS (SELECT 'n' || CAST(s_nationkey AS VARCHAR) AS dataset_id, count(*) AS n, round(sum(s_acctbal::DOUBLE), 2) AS bal FROM supplier GROUP BY s_nationkey), w AS (SELECT dataset_id, n, bal, CASE WHEN n % 7 <> 0 THEN 'EUR' END AS currency, " + ", ".join(
    f"CAST({_GIVEN.get(f, 'NULL')} AS DOUBLE) AS {f}" for f in economics.FIELDS) + ", CASE WHEN n % 6 = 0 THEN NULL ELSE bal / 1000 END AS thr, CASE WHEN n % 5 = 0 THEN NULL ELSE 0.8::DOUBLE END AS util FROM p)"
_BASE = _W + ", b AS (SELECT *, round(thr * working_hours_per_day, 6) AS units, round(thr * working_hours_per_day * contribution_margin_per_unit, 6) AS daily, round(thr * working_hours_per_day * contribution_margin_per_unit * working_days_per_month, 6) AS monthly FROM w)"


def baseline(spark, sf):
    wide = economics.assumption_wide(assumptions(spark, sf))
    observed = plants(spark, sf).select("dataset_id", F.when(F.col("n") % 6 != 0, F.col("bal") / 1000).alias("throughput_per_hour"), F.when(F.col("n") % 5 != 0, F.lit(0.8)).alias("current_utilization"))
    return economics.baseline_economics(wide.join(observed, "dataset_id"))


_TRY = [("contribution_margin_per_unit", "bal", "CAST(bal AS VARCHAR)"), ("working_hours_per_day", "n", "CAST(n AS VARCHAR)"), ("unknown_field", "n", "'1'"), ("expected_defect_rate", "x", "'abc'"), ("expected_rework_rate", "nan", "'NaN'"),
        ("baseline_demand", "null", "NULL"), ("currency", "c", "'usd'"), ("currency", "long", "'much too long'")]


@query("e1_validate_assumptions", "WITH p AS (SELECT s_nationkey AS k, count(*) AS n, round(sum(s_acctbal::DOUBLE), 2) AS bal FROM supplier GROUP BY s_nationkey), u AS (" + union_all(
    [f"SELECT k, '{f}' AS field, CAST({raw} AS VARCHAR) AS raw, {bal} AS num FROM p" for f, _, raw, bal in [(*t, "bal" if t[1] == "bal" else "n" if t[1] == "n" and t[0] != "unknown_field" else "NULL") for t in _TRY]]) + """)
  SELECT field, coalesce(reason, 'ok') AS reason, count(*) AS updates FROM (SELECT field, CASE WHEN field = 'unknown_field' THEN 'UNKNOWN_ASSUMPTION' WHEN raw IS NULL THEN NULL WHEN field = 'currency' THEN CASE WHEN length(raw) > 8 THEN 'INVALID_CURRENCY' END
   WHEN raw = 'abc' THEN 'NOT_NUMERIC' WHEN raw = 'NaN' THEN 'NOT_FINITE' WHEN num < 0 THEN 'BELOW_MINIMUM' WHEN field = 'working_hours_per_day' AND num > 24 THEN 'ABOVE_MAXIMUM' END AS reason FROM u) q GROUP BY ALL""")
def e1(spark, sf):
    t = plants(spark, sf)
    cells = [F.struct(F.lit(f).alias("field"), F.expr(raw.replace("VARCHAR", "STRING")).cast("string").alias("raw")) for f, _, raw in _TRY]
    ups = t.select("dataset_id", F.explode(F.array(*cells)).alias("s"), F.lit(1).alias("at")).select("dataset_id", "s.field", "s.raw", "at")
    return economics.validate_assumptions(ups).groupBy("field", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("updates"))


@query("e2_baseline_economics", f"{_BASE} SELECT dataset_id, {r('units', 2)} AS units_per_day, {r('daily', 2)} AS daily_contribution, {r('monthly', 2)} AS monthly_contribution, CASE WHEN daily IS NULL THEN 'NOT_AVAILABLE' ELSE 'CALCULATED' END AS baseline_status, "
       "CASE WHEN daily IS NULL THEN concat_ws(', ', CASE WHEN thr IS NULL THEN 'throughput_per_hour' END, CASE WHEN contribution_margin_per_unit IS NULL THEN 'contribution_margin_per_unit' END, CASE WHEN currency IS NULL THEN 'currency' END) ELSE '' END AS daily_missing FROM b", digits=2)
def e2(spark, sf):
    return baseline(spark, sf).select("dataset_id", "units_per_day", "daily_contribution", "monthly_contribution", "baseline_status", "daily_missing")


_SCN = "(VALUES ('utilization_reduction', 0.1, NULL), ('utilization_reduction', -0.1, NULL), ('throughput_scaling', 0.05, 'user_assumption'), ('throughput_scaling', 0.05, 'data'), ('demand_uplift', 0.2, NULL), ('demand_uplift', 0.99, NULL), ('magic', 0.1, NULL)) v(kind, change, basis)"
_SCENARIOS = [("utilization_reduction", 0.1, None), ("utilization_reduction", -0.1, None), ("throughput_scaling", 0.05, "user_assumption"), ("throughput_scaling", 0.05, "data"), ("demand_uplift", 0.2, None), ("demand_uplift", 0.99, None), ("magic", 0.1, None)]
_RUN = _BASE + f""", q AS (SELECT b.*, v.kind, v.change::DOUBLE AS change, v.basis, (kind = 'utilization_reduction' AND util IS NOT NULL AND change > 0) OR (kind = 'throughput_scaling' AND basis = 'user_assumption' AND thr IS NOT NULL)
    OR (kind = 'demand_uplift' AND abs(change) <= 0.95 AND units IS NOT NULL) AS ok FROM b, {_SCN}),
  z AS (SELECT *, CASE WHEN coalesce(ok, false) THEN CASE WHEN kind = 'demand_uplift' THEN round(units * (1 + change), 6) WHEN kind = 'throughput_scaling' THEN round(thr * (1 + change), 6) * working_hours_per_day ELSE units END END AS su FROM q),
  d AS (SELECT *, round(su - units, 6) AS du, round(round(su - units, 6) * contribution_margin_per_unit, 6) AS dd FROM z),
  c AS (SELECT *, du * expected_defect_rate * scrap_cost_per_unit AS scrap, du * expected_rework_rate * rework_cost_per_unit AS rework, downtime_hours_per_day * downtime_cost_per_hour AS downtime, working_hours_per_day * operating_cost_per_hour AS operating FROM d)"""


def scenario_rows(spark, sf):
    """Seven scenarios per plant."""
    each = F.array(*[F.struct(F.lit(k).alias("scenario_type"), F.lit(c).alias("change"), F.lit(b).cast("string").alias("scaling_basis")) for k, c, b in _SCENARIOS])
    return plants(spark, sf).select("dataset_id", F.inline(each))


def deltas(spark, sf):
    return economics.scenario_delta(economics.run_scenarios(scenario_rows(spark, sf), baseline(spark, sf)))


_KEY = ["dataset_id", "scenario_type", "change", "scaling_basis"]
_KSQL = "dataset_id, kind AS scenario_type, change, basis AS scaling_basis"


@query("e3_scenario", f"{_RUN} SELECT {_KSQL}, CASE WHEN coalesce(ok, false) THEN 'SIMULATED' ELSE 'NOT_SUPPORTED' END AS scenario_status, {r('su', 2)} AS scenario_units_per_day, CASE WHEN ok AND kind = 'utilization_reduction' THEN {r('util * (1 - change)')} END AS scenario_utilization FROM c", digits=2)
def e3(spark, sf):
    return economics.run_scenarios(scenario_rows(spark, sf), baseline(spark, sf)).select(*_KEY, "scenario_status", "scenario_units_per_day", "scenario_utilization")


@query("e4_scenario_delta", f"{_RUN} SELECT {_KSQL}, {r('du')} AS units_delta, {r('dd')} AS daily_delta, {r('round(dd * working_days_per_month, 6)')} AS monthly_delta FROM c")
def e4(spark, sf):
    return deltas(spark, sf).select(*_KEY, "units_delta", "daily_delta", "monthly_delta")


@query("e5_cost_blocks", f"{_RUN} SELECT {_KSQL}, k AS cost, {r('v', 2)} AS \"value\", CASE WHEN v IS NULL THEN 'NOT_AVAILABLE' ELSE 'CALCULATED' END AS status FROM (" + union_all(
    [f"SELECT dataset_id, kind, change, basis, '{k}' AS k, {k} AS v FROM c" for k in ("scrap", "rework", "downtime", "operating")]) + ") q", digits=2)
def e5(spark, sf):
    return economics.cost_blocks(economics.cost_columns(deltas(spark, sf)), _KEY).select(*_KEY, "cost", "value", "status")


_NET = "CASE WHEN dd IS NULL AND scrap IS NULL AND rework IS NULL AND downtime IS NULL AND operating IS NULL THEN NULL ELSE coalesce(dd, 0) - coalesce(scrap, 0) - coalesce(rework, 0) - coalesce(downtime, 0) - coalesce(operating, 0) END"


@query("e6_net_impact", f"{_RUN} SELECT {_KSQL}, {r(_NET, 2)} AS net_daily_impact, CASE WHEN {_NET} IS NULL THEN 'NOT_AVAILABLE' ELSE 'CALCULATED' END AS net_status FROM c", digits=2)
def e6(spark, sf):
    return economics.net_impact(economics.cost_columns(deltas(spark, sf))).select(*_KEY, "net_daily_impact", "net_status")


@query("e7_break_even", f"{_BASE} SELECT dataset_id, {r('CASE WHEN contribution_margin_per_unit > 0 THEN CASE WHEN working_days_per_month > 0 THEN intervention_cost / (contribution_margin_per_unit * working_days_per_month) ELSE intervention_cost / contribution_margin_per_unit END END')} AS break_even_units FROM b")
def e7(spark, sf):
    return economics.break_even(baseline(spark, sf)).select("dataset_id", "break_even_units")


_SWEEP = [-0.5, 0.05, 0.1, 0.15, 0.2, 0.99]


@query("e8_sensitivity", f"""{_BASE}, q AS (SELECT b.*, unnest({_SWEEP})::DOUBLE AS change FROM b), z AS (SELECT *, abs(change) <= 0.95 AND units IS NOT NULL AS ok, units * change AS du FROM q),
  c AS (SELECT *, du * contribution_margin_per_unit AS dd, du * expected_defect_rate * scrap_cost_per_unit AS scrap, du * expected_rework_rate * rework_cost_per_unit AS rework, downtime_hours_per_day * downtime_cost_per_hour AS downtime, NULL AS operating FROM z)
  SELECT dataset_id, change AS parameter_value, CASE WHEN ok THEN 'SIMULATED' ELSE 'NOT_SUPPORTED' END AS status, CASE WHEN ok THEN {r('du', 2)} END AS units_delta, CASE WHEN ok THEN {r(_NET, 2)} END AS net_daily_impact FROM c""", digits=2)
def e8(spark, sf):
    return economics.sensitivity(baseline(spark, sf), "demand_uplift", _SWEEP).select("dataset_id", "parameter_value", "status", "units_delta", "net_daily_impact")


_HAVE = "concat_ws(', ', " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN '{f}' END" for f in economics.FIELDS) + ")"


@query("e9_economics_status", f"{_W} SELECT dataset_id, CASE WHEN n % 9 = 0 THEN 'NOT_ANALYZED' ELSE 'READY' END AS status, n % 9 <> 0 AND thr IS NOT NULL AS throughput_available, {_HAVE} AS supplied, currency FROM w")
def e9(spark, sf):
    seen = plants(spark, sf).where("n % 9 <> 0").select("dataset_id", F.when(F.col("n") % 6 != 0, F.col("bal") / 1000).alias("throughput"))
    return economics.economics_status(assumptions(spark, sf), seen).select("dataset_id", "status", "throughput_available", "supplied", "currency")


@query("j14_missing_vs_supplied", f"{_W} SELECT dataset_id, f AS field FROM w, (VALUES {', '.join(f'({chr(39)}{f}{chr(39)})' for f in economics.FIELDS)}) v(f) WHERE CASE f " + " ".join(f"WHEN '{f}' THEN {f} IS NULL" for f in economics.FIELDS) + " END")
def j14(spark, sf):
    return economics.missing_fields(assumptions(spark, sf))


# --- recommendations: one dataset per nation again, its candidate station the nation name

_CAND = """SELECT 'n' || CAST(n_nationkey AS VARCHAR(32)) AS dataset_id, n_name AS station, CAST((n_nationkey % 5) / 4.0 AS DOUBLE) AS utilization_pressure, CAST((n_nationkey % 4) / 3.0 AS DOUBLE) AS queue_pressure, CAST((n_nationkey % 3) / 2.0 AS DOUBLE) AS cycle_time_pressure,
  CAST(n_regionkey AS DOUBLE) AS utilization_mean, CAST(n_regionkey AS DOUBLE) AS queue_wait_mean, CAST(n_regionkey AS DOUBLE) AS cycle_time_mean, CAST(100 AS BIGINT) AS utilization_samples, CAST(100 AS BIGINT) AS queue_wait_samples, CAST(100 AS BIGINT) AS cycle_time_samples,
  CASE WHEN n_nationkey % 3 = 0 THEN 'HIGH_EVIDENCE' WHEN n_nationkey % 3 = 1 THEN 'MODERATE_EVIDENCE' ELSE 'LIMITED_EVIDENCE' END AS evidence_quality, CASE WHEN n_nationkey % 2 = 0 THEN 'x' END AS rca_factor, CAST(50 AS DOUBLE) AS rca_score FROM nation"""


def candidates(spark, sf):
    return V._run(spark, _CAND, sf, "nation")


def drift_rows(spark, sf):
    """Columns of each nation with a z taken from the customers' balances."""
    c = V.table(spark, sf, "customer")
    return c.groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dataset_id"), F.col("c_mktsegment").alias("column")).agg(
        F.round(F.avg(F.col("c_acctbal").cast("double")) / 1000, 4).alias("peak_ewma_z")).select("*", (F.abs("peak_ewma_z") >= 3).alias("drift_detected"), F.when(F.col("peak_ewma_z") > 0, "increase").otherwise("decrease").alias("direction"))


def rate_rows(spark, sf):
    c = V.table(spark, sf, "customer")
    bad = F.col("c_acctbal").cast("double") > 9500
    return c.groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dataset_id"), F.col("c_mktsegment").alias("source")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("anomalous_rows")).withColumn("anomaly_rate", F.round(F.col("anomalous_rows") / F.col("rows"), 6))


def latest_scenarios(spark, sf):
    n = V.table(spark, sf, "nation").where("n_nationkey % 2 = 0")
    calc = F.col("n_nationkey") % 4 == 0
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dataset_id"), F.col("n_name").alias("station"), F.lit("demand_uplift").alias("scenario_type"), F.lit(0.1).alias("change"),
                    F.when(calc, "CALCULATED").otherwise("NOT_AVAILABLE").alias("delta_status"), F.when(calc, F.lit(12.5)).alias("daily_delta"), F.lit(100.0).alias("throughput_per_hour"))


def dataset_rows(spark, sf):
    return V.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dataset_id"), (F.col("n_nationkey") % 3 == 0).alias("has_image_data"))


def supplied_rows(spark, sf):
    n = V.table(spark, sf, "nation").where("n_nationkey % 5 < 3")
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dataset_id"), F.explode(F.array(*[F.lit(f) for f in ("contribution_margin_per_unit", "working_hours_per_day", "currency")])).alias("field")).select(
        "dataset_id", "field", F.when(F.col("field") != "currency", F.lit(1.0)).alias("value"), F.when(F.col("field") == "currency", "EUR").alias("value_text"))


def produced(spark, sf):
    c, s = candidates(spark, sf), latest_scenarios(spark, sf)
    return recommend.combine([
        recommend.rule_high_utilization(c), recommend.rule_queue(c), recommend.rule_cycle_time(c), recommend.rule_drift(drift_rows(spark, sf)), recommend.rule_anomaly(c, rate_rows(spark, sf)),
        recommend.rule_scenario(s), recommend.rule_gap_economics(dataset_rows(spark, sf), supplied_rows(spark, sf), s), recommend.rule_gap_vision(dataset_rows(spark, sf))])


def finished(spark, sf):
    return recommend.finish(produced(spark, sf), candidates(spark, sf), latest_scenarios(spark, sf))


_N = "'n' || CAST(n_nationkey AS VARCHAR)"
_RULES_SQL = f"""WITH c AS ({_CAND}), dr AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS dataset_id, c_mktsegment AS col, round(avg(c_acctbal::DOUBLE) / 1000, 4) AS z FROM customer GROUP BY ALL),
  an AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS dataset_id, max(k) AS k FROM (SELECT c_nationkey, c_mktsegment, count(*) FILTER (WHERE c_acctbal::DOUBLE > 9500) AS k FROM customer GROUP BY ALL) GROUP BY ALL),
  p AS (SELECT dataset_id, 'high_utilization' AS rule, 1 AS o, 'INVESTIGATE_HIGH_UTILIZATION' AS action_type, station AS target, station, evidence_quality AS ql, false AS gap FROM c WHERE utilization_pressure >= 0.8
   UNION ALL SELECT dataset_id, 'queue_bottleneck', 2, 'INVESTIGATE_QUEUE_BOTTLENECK', station, station, evidence_quality, false FROM c WHERE queue_pressure >= 0.8
   UNION ALL SELECT dataset_id, 'cycle_time', 3, 'INVESTIGATE_CYCLE_TIME', station, station, 'MODERATE_EVIDENCE', false FROM c WHERE cycle_time_pressure >= 0.8
   UNION ALL SELECT dataset_id, 'process_drift', 4, 'INVESTIGATE_PROCESS_DRIFT', arg_max(col, (abs(z), col)), NULL, 'MODERATE_EVIDENCE', false FROM dr WHERE abs(z) >= 3 GROUP BY dataset_id
   UNION ALL SELECT c.dataset_id, 'anomaly_review', 5, 'REVIEW_ANOMALOUS_RECORDS', station, station, 'LIMITED_EVIDENCE', false FROM c JOIN an USING (dataset_id) WHERE k > 0
   UNION ALL SELECT {_N}, 'scenario', 6, 'EVALUATE_CAPACITY_IMPROVEMENT', n_name, n_name, 'MODERATE_EVIDENCE', false FROM nation WHERE n_nationkey % 4 = 0
   UNION ALL SELECT {_N}, 'data_gap_economics', 7, 'REVIEW_DATA_GAP', 'economic_assumptions', NULL, 'INSUFFICIENT_EVIDENCE', true FROM nation WHERE n_nationkey % 5 >= 3 AND n_nationkey % 4 <> 0
   UNION ALL SELECT {_N}, 'data_gap_vision', 8, 'REVIEW_DATA_GAP', 'vision_dataset', NULL, 'INSUFFICIENT_EVIDENCE', true FROM nation WHERE n_nationkey % 3 <> 0),
  s AS (SELECT *, 3.0 * CASE ql WHEN 'HIGH_EVIDENCE' THEN 3 WHEN 'MODERATE_EVIDENCE' THEN 2 WHEN 'LIMITED_EVIDENCE' THEN 1 ELSE 0 END + CASE WHEN station IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN rule = 'scenario' THEN 2 ELSE 0 END AS pr FROM p),
  f AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY pr DESC, action_type, target) AS rank FROM s)"""


def _one(rule: str):
    return f"{_RULES_SQL} SELECT dataset_id, action_type, target, ql AS evidence_quality FROM p WHERE rule = '{rule}'"


_RC = ["dataset_id", "action_type", "target", "evidence_quality"]


@query("q1_rule_high_utilization", _one("high_utilization"))
def q1(spark, sf):
    return recommend.rule_high_utilization(candidates(spark, sf)).select(*_RC)


@query("q2_rule_queue_bottleneck", _one("queue_bottleneck"))
def q2(spark, sf):
    return recommend.rule_queue(candidates(spark, sf)).select(*_RC)


@query("q3_rule_cycle_time", _one("cycle_time"))
def q3(spark, sf):
    return recommend.rule_cycle_time(candidates(spark, sf)).select(*_RC)


@query("q4_rule_drift", _one("process_drift"))
def q4(spark, sf):
    return recommend.rule_drift(drift_rows(spark, sf)).select(*_RC)


@query("q5_rule_anomaly_review", _one("anomaly_review"))
def q5(spark, sf):
    return recommend.rule_anomaly(candidates(spark, sf), rate_rows(spark, sf)).select(*_RC)


@query("q6_rule_scenario", _one("scenario"))
def q6(spark, sf):
    return recommend.rule_scenario(latest_scenarios(spark, sf)).select(*_RC)


@query("q7_rule_gap_economics", _one("data_gap_economics"))
def q7(spark, sf):
    return recommend.rule_gap_economics(dataset_rows(spark, sf), supplied_rows(spark, sf), latest_scenarios(spark, sf)).select(*_RC)


@query("q8_rule_gap_vision", _one("data_gap_vision"))
def q8(spark, sf):
    return recommend.rule_gap_vision(dataset_rows(spark, sf)).select(*_RC)


# claims are planted around every document text: a positive, a negated and a distant-negation one
_CLAIM = "CASE doc_id % 4 WHEN 0 THEN 'This will fix it. ' WHEN 1 THEN 'It is not guaranteed. ' WHEN 2 THEN 'Never mind the long story here, it is definitely so. ' ELSE '' END"
_TEXTS = f"SELECT doc_id, {_CLAIM} || text AS text FROM documents"


def _gate_sql() -> str:
    """Each phrase: all matches minus those with a negation in the 16 characters before (checked piece by piece)."""
    parts = []
    for i, p in enumerate(fixed.FORBIDDEN_PHRASES):
        neg = " OR ".join("contains(pre, '{}')".format(n.replace("'", "''")) for n in fixed.NEGATIONS)
        parts.append(f"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, right(array_to_string(list_transform(range(1, k + 1), lambda j: pieces[j] || CASE WHEN j < k THEN hits[j] ELSE '' END), ''), 16) AS pre
          FROM (SELECT doc_id, hits, pieces, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(low, '{p}') AS hits, regexp_split_to_array(low, '{p}') AS pieces FROM t) WHERE len(hits) > 0)) WHERE NOT ({neg}) GROUP BY doc_id""")
    return f"WITH t AS (SELECT doc_id, lower(text) AS low FROM ({_TEXTS})), v AS ({union_all(parts)}), s AS (SELECT doc_id, sum(n) AS n FROM v GROUP BY doc_id) SELECT t.doc_id, CAST(coalesce(s.n, 0) AS INTEGER) AS violations FROM t LEFT JOIN s USING (doc_id)"


@query("q9_language_gate", _gate_sql())
def q9(spark, sf):
    """Every document text in full, with a planted claim in front."""
    docs = V._run(spark, _TEXTS, sf, "documents")
    return gate_texts(docs, "doc_id", "text").select("doc_id", "violations")


@query("q10_priority", f"{_RULES_SQL} SELECT dataset_id, rule, {r('pr')} AS priority FROM s")
def q10(spark, sf):
    return finished(spark, sf).select("dataset_id", "rule", "priority")


@query("q11_dedupe_rank", f"{_RULES_SQL} SELECT dataset_id, action_type, target, CAST(rank AS INTEGER) AS rank FROM f")
def q11(spark, sf):
    """Every rule is sent twice; the second copy must be recognised."""
    twice = produced(spark, sf)
    done = recommend.finish(twice.unionByName(twice), candidates(spark, sf), latest_scenarios(spark, sf))
    return done.where("rank is not null").select("dataset_id", "action_type", "target", "rank")


@query("q12_rule_trace", f"{_RULES_SQL}, g AS (SELECT {_N} AS dataset_id, u AS rule FROM nation, (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in recommend.RULES)}) v(u)) SELECT g.dataset_id, g.rule, CASE WHEN p.rule IS NULL THEN 'NOT_ACTIVATED' ELSE 'ACTIVATED' END AS state FROM g LEFT JOIN p USING (dataset_id, rule)")
def q12(spark, sf):
    return recommend.rule_trace(finished(spark, sf), dataset_rows(spark, sf))


@query("q12_decision_summary", f"""{_RULES_SQL} SELECT dataset_id, count(*) AS recommendations, max(CASE WHEN rank = 1 THEN action_type END) AS top_action, max(CASE WHEN rank = 1 THEN target END) AS top_target,
  coalesce(string_agg(CASE WHEN gap THEN target END, ', ' ORDER BY target), '') AS data_gaps, CAST(0 AS BIGINT) AS rejected FROM f GROUP BY dataset_id""")
def q12_summary(spark, sf):
    return recommend.decision_summary(finished(spark, sf))


@query("q13_recommendation_evidence", f"{_RULES_SQL} SELECT action_type, CAST(sum(CASE WHEN rule = 'scenario' THEN 2 WHEN rule = 'high_utilization' AND CAST(substr(dataset_id, 2) AS INTEGER) % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS entries FROM p GROUP BY action_type")
def q13(spark, sf):
    return recommend.recommendation_evidence(finished(spark, sf)).groupBy("action_type").agg(F.count(F.lit(1)).alias("entries"))


@query("j13_compare_sets", """WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey AS id FROM orders) SELECT id, 'BOTH' AS place FROM (SELECT id FROM a INTERSECT SELECT id FROM b)
  UNION ALL SELECT id, 'LEFT' FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'RIGHT' FROM (SELECT id FROM b EXCEPT SELECT id FROM a)""")
def j13_sets(spark, sf):
    """Customers in credit beside customers with orders."""
    return flow.compare_sets(V.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")),
                             V.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")
