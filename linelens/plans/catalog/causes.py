"""Root-cause evidence and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.operators import align, anomaly, drift, evidence, information, profile
from linelens.plans import process as runs
from linelens.plans.catalog.base import H, O, ORDER_COLUMNS, hourly, meta_of, orders, query, r, sql_metric, union_all
from linelens.session import materialize
from linelens.sources import views as V

Y = "throughput_units"
FACTORS = ["Demand", *V.HOURLY_METRICS]
ORDER_FACTORS = ["Demand", *V.ORDER_METRICS]
EV = f"({Y} <= (SELECT quantile_cont({Y}, 0.1) FROM {{t}}))"


def long_sql(cte: str, t: str, factors: list[str], key: str) -> str:
    """l(factor, k, x, y, e): the long form the checks work on."""
    rows = [f"SELECT '{c}', {key}, CAST({c} AS DOUBLE), {Y}, {EV.format(t=t)} FROM {t}" for c in factors]
    return f"{cte}, l AS (SELECT * FROM ({union_all(rows)}) q(factor, k, x, y, e))"


LH = long_sql(H, "h", FACTORS, "Time_Now")
LO = long_sql(O, "o", ORDER_FACTORS, "row_key")
_RANK = "rank() OVER (PARTITION BY factor ORDER BY {c}) + (count(*) OVER (PARTITION BY factor, {c}) - 1) / 2.0::DOUBLE"


def flagged(spark, sf):
    return evidence.tail_event(hourly(spark, sf, True), Y)[0]


def flagged_orders(spark, sf):
    return evidence.tail_event(orders(spark, sf, True), Y)[0]


def _target_rows(spark, sf):
    parts = []
    for name, mode, df in (("process_hourly", "model_input", hourly(spark, sf, True)), ("process_orders", "process_table", orders(spark, sf, True))):
        meta = profile.classify_roles(profile.column_stats(df))
        parts.append(meta.select(F.lit(name).alias("input"), F.lit(mode).alias("mode"), "column", "role", "nonnull", "unique", "ordinal", "min", "max", "mean",
                                 F.col("dtype").rlike("int|double|float").alias("numeric")))
    return align.union_profiles(parts)


_TARGET_COLUMNS = ["row_key", "Demand", *V.ORDER_METRICS, Y]
_TARGETS_SQL = f"""WITH h AS ({V.PROCESS_HOURLY}), o AS ({V.PROCESS_ORDERS}), t AS ({union_all(
    [f"SELECT '{Y}' AS target, 'process_hourly' AS input, 'model_input' AS mode, count({Y}) AS n, min({Y})::DOUBLE AS lo, max({Y})::DOUBLE AS hi, avg({Y}) AS mu FROM h"]
    + [f"SELECT '{c}', 'process_orders', 'process_table', count({c}), min({c})::DOUBLE, max({c})::DOUBLE, avg({c}) FROM o" for c in _TARGET_COLUMNS])})
  SELECT CAST(row_number() OVER (ORDER BY mode <> 'model_input', input, target) AS INTEGER) AS rank, target, input, mode, n AS rows_with_target, {r('lo')} AS target_min, {r('hi')} AS target_max, {r('mu')} AS target_mean FROM t WHERE n >= 100 AND lo < hi"""


@query("r1_discover_targets", _TARGETS_SQL)
def r1(spark, sf):
    return evidence.discover_targets(_target_rows(spark, sf))


@query("r2_resolve_target", f"WITH t AS ({_TARGETS_SQL}) SELECT target, input, mode, 'processed_data' AS artifact FROM t WHERE target = '{Y}' ORDER BY mode <> 'model_input' LIMIT 1")
def r2(spark, sf):
    rows = _target_rows(spark, sf)
    hit = evidence.resolve_target(evidence.discover_targets(rows), Y)
    return evidence.choose_source(hit, rows.select("input", "column")).select("target", "input", "mode", "artifact")


@query("r3_tail_event", f"""WITH o AS ({V.PROCESS_ORDERS}), c AS (SELECT quantile_cont({Y}, 0.1) AS lo, quantile_cont({Y}, 0.9) AS hi FROM o)
  SELECT '{Y}' AS target, 'low' AS direction, 0.1::DOUBLE AS quantile, {r('any_value(lo)')} AS threshold, count(*) FILTER (WHERE {Y} <= lo) AS event_rows, count(*) FILTER (WHERE NOT {Y} <= lo) AS non_event_rows FROM o, c
  UNION ALL SELECT '{Y}', 'high', 0.1::DOUBLE, {r('any_value(hi)')}, count(*) FILTER (WHERE {Y} >= hi), count(*) FILTER (WHERE NOT {Y} >= hi) FROM o, c""")
def r3(spark, sf):
    df = orders(spark, sf, True)
    return evidence.event_summary(*evidence.tail_event(df, Y, "low", 0.1)).unionByName(evidence.event_summary(*evidence.tail_event(df, Y, "high", 0.1)))


@query("r4_select_factors", f"SELECT c AS factor, CAST(row_number() OVER () - 1 AS INTEGER) AS place FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in ['row_key', *ORDER_FACTORS])}) v(c) WHERE (SELECT count(*) FROM lineitem) > 0")
def r4(spark, sf):
    factors, _ = evidence.select_factors(orders(spark, sf), Y, [Y])
    return spark.createDataFrame([(c, i) for i, c in enumerate(factors)], "factor string, place int")


def _corr(long: str) -> str:
    return f"{long} SELECT factor, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n, {r('corr(x, y)')} AS pearson_r FROM l GROUP BY factor"


@query("r5_pearson", _corr(LH))
def r5(spark, sf):
    return evidence.correlations(flagged(spark, sf), Y, FACTORS).select("factor", "n", "pearson_r")


@query("r5_pearson_orders", _corr(LO))
def r5_orders(spark, sf):
    return evidence.correlations(orders(spark, sf), Y, ORDER_FACTORS).select("factor", "n", "pearson_r")


def _spear(long: str, d: int = 4) -> str:
    return (f"{long}, p AS (SELECT * FROM l WHERE x IS NOT NULL AND y IS NOT NULL), k AS (SELECT factor, {_RANK.format(c='x')} AS rx, {_RANK.format(c='y')} AS ry FROM p) "
            f"SELECT factor, count(*) AS n, {r('corr(rx, ry)', d)} AS spearman_r FROM k GROUP BY factor")


@query("r6_spearman", _spear(LH))
def r6(spark, sf):
    return evidence.spearman(hourly(spark, sf, True), Y, FACTORS).select("factor", "n", "spearman_r")


@query("r6_spearman_orders", _spear(LO))
def r6_orders(spark, sf):
    return evidence.spearman(orders(spark, sf, True), Y, ORDER_FACTORS).select("factor", "n", "spearman_r")


# the same p by its finite series over the degrees of freedom: odd or even ones have their own
_T_SERIES = """CASE WHEN abs({r}) >= 1 THEN 0.0 WHEN {n} % 2 = 0
  THEN 1 - abs({r}) * list_sum(list_transform(range(({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2 + k * ln(1 - {r} * {r}))))
  ELSE 1 - 2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum(list_transform(range(({n} - 3) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + ln(pi()) / 2 - ln(2) + (k + 0.5) * ln(1 - {r} * {r})))), 0)) END"""


def _p_of(long: str, corr: str, source: str, name: str) -> str:
    p = _T_SERIES.format(r="c", n="n")
    return f"{long}{source}, g AS (SELECT factor, count(*) FILTER (WHERE {corr[1]} IS NOT NULL AND {corr[2]} IS NOT NULL) AS n, corr({corr[1]}, {corr[2]}) AS c FROM {corr[0]} GROUP BY factor) SELECT factor, n, {r('c')} AS {name}_r, {r(p)} AS {name}_p FROM g"


_RANKED = f", p AS (SELECT * FROM l WHERE x IS NOT NULL AND y IS NOT NULL), k AS (SELECT factor, {_RANK.format(c='x')} AS rx, {_RANK.format(c='y')} AS ry FROM p)"


@query("r5_pearson_p", _p_of(LH, ("l", "x", "y"), "", "pearson"))
def r5_p(spark, sf):
    """Correlations and their exact two-sided p by Student's t."""
    return evidence.correlations(flagged(spark, sf), Y, FACTORS).select("factor", "n", "pearson_r", "pearson_p")


@query("r5_pearson_p_orders", _p_of(LO, ("l", "x", "y"), "", "pearson"))
def r5_p_orders(spark, sf):
    return evidence.correlations(orders(spark, sf), Y, ORDER_FACTORS).select("factor", "n", "pearson_r", "pearson_p")


@query("r6_spearman_p", _p_of(LH, ("k", "rx", "ry"), _RANKED, "spearman"))
def r6_p(spark, sf):
    return evidence.spearman(hourly(spark, sf, True), Y, FACTORS).select("factor", "n", "spearman_r", "spearman_p")


@query("r6_spearman_p_orders", _p_of(LO, ("k", "rx", "ry"), _RANKED, "spearman"))
def r6_p_orders(spark, sf):
    return evidence.spearman(orders(spark, sf), Y, ORDER_FACTORS).select("factor", "n", "spearman_r", "spearman_p")


_EDGES = "[" + ", ".join(f"{k / 16}" for k in range(1, 16)) + "]"


def _mi(cte: str, t: str, factors: list[str], key: str) -> str:
    bins = lambda c: f"CASE WHEN {c} IS NOT NULL THEN list_sum(list_transform((SELECT quantile_cont({c}::DOUBLE, {_EDGES}) FROM {t}), lambda e: ({c} > e)::INTEGER)) END"
    wide = ", ".join(f"{bins(c)} AS {c}" for c in factors)
    rows = union_all([f"SELECT '{c}', 0, {c}, yb FROM w UNION ALL SELECT '{c}', 1, {c}, bp FROM w" for c in factors])
    return f"""{cte}, b AS (SELECT md5(concat(CAST({key} AS VARCHAR), '|42')) AS h, {bins(Y)} AS yb, {wide} FROM {t}),
      w AS (SELECT *, CASE WHEN row_number() OVER g = 1 THEN last_value(yb) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lag(yb) OVER g END AS bp FROM b WINDOW g AS (ORDER BY h)),
      t AS (SELECT f, s, x, b, count(*) AS n FROM ({rows}) q(f, s, x, b) WHERE x IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
      m AS (SELECT f, s, n, sum(n) OVER (PARTITION BY f, s) AS tot, sum(n) OVER (PARTITION BY f, s, x) AS px, sum(n) OVER (PARTITION BY f, s, b) AS py FROM t),
      z AS (SELECT f, s, sum(n::DOUBLE / tot * ln(n::DOUBLE * tot / (px::DOUBLE * py))) AS mi, any_value(tot) AS n FROM m GROUP BY f, s)
      SELECT f AS factor, CAST(max(CASE WHEN s = 0 THEN n END) AS BIGINT) AS n, {r('max(CASE WHEN s = 0 THEN mi END)')} AS mi, {r('max(CASE WHEN s = 1 THEN mi END)')} AS mi_baseline FROM z GROUP BY f"""


@query("r7_mutual_information", _mi(H, "h", FACTORS, "Time_Now"))
def r7(spark, sf):
    return evidence.mutual_information(hourly(spark, sf, True), Y, FACTORS, "Time_Now")


@query("r7_mutual_information_orders", _mi(O, "o", ORDER_FACTORS, "row_key"))
def r7_orders(spark, sf):
    return evidence.mutual_information(orders(spark, sf, True), Y, ORDER_FACTORS, "row_key")


@query("r7_neighbour_information", None)
def r7_neighbours(spark, sf):
    """By nearest neighbours over every hour; all-pairs comparisons are no SQL twin, tests hold it against one."""
    return information.neighbour_information(hourly(spark, sf, True), Y, FACTORS, "Time_Now")


@query("r7_neighbour_information_orders", None)
def r7_neighbours_orders(spark, sf):
    """The same over every order, whose discounts and quantities repeat many times."""
    return information.neighbour_information(orders(spark, sf, True), Y, ORDER_FACTORS, "row_key")


def _effect(long: str, d: int = 6) -> str:
    r = lambda e, n: f"(round(round(CAST({e} AS DOUBLE), 6), {n}) + CAST(0 AS DOUBLE))"  # the operator reports 6 digits
    return f"""{long}, a AS (SELECT factor, avg(x) FILTER (WHERE e) AS ma, avg(x) FILTER (WHERE NOT e) AS mb, var_samp(x) FILTER (WHERE e) AS va, var_samp(x) FILTER (WHERE NOT e) AS vb,
      count(x) FILTER (WHERE e) AS na, count(x) FILTER (WHERE NOT e) AS nb FROM l GROUP BY factor),
      s AS (SELECT *, na >= 10 AND nb >= 10 AS ok, sqrt((va + vb) / 2) AS p FROM a)
      SELECT factor, na AS event_n, nb AS non_event_n, CASE WHEN ok THEN {r('ma', d)} END AS event_mean, CASE WHEN ok THEN {r('mb', d)} END AS non_event_mean,
      CASE WHEN ok THEN {r('ma - mb', d)} END AS difference, CASE WHEN ok THEN {r('CASE WHEN p > 0 THEN (ma - mb) / p ELSE 0 END', d)} END AS standardized_effect FROM s"""


@query("r8_group_effect", _effect(LH), digits=6)
def r8(spark, sf):
    return evidence.group_effect(flagged(spark, sf), FACTORS).drop("available")


@query("r8_group_effect_orders", _effect(LO, 4))
def r8_orders(spark, sf):
    return evidence.group_effect(flagged_orders(spark, sf), ORDER_FACTORS).drop("available")


def _u(long: str) -> str:
    return f"""{long}, p AS (SELECT * FROM l WHERE x IS NOT NULL), k AS (SELECT factor, e, x, {_RANK.format(c='x')} AS rx FROM p),
      t AS (SELECT factor, sum(n::DOUBLE * n * n - n) AS ties FROM (SELECT factor, x, count(*) AS n FROM p GROUP BY factor, x) GROUP BY factor),
      g AS (SELECT factor, count(*) FILTER (WHERE e)::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(rx) FILTER (WHERE e) AS r1 FROM k GROUP BY factor),
      u AS (SELECT factor, n1, n - n1 AS n2, n, r1 - n1 * (n1 + 1) / 2 AS u, ties FROM g JOIN t USING (factor)),
      z AS (SELECT *, sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS s FROM u)
      SELECT factor, CASE WHEN n1 >= 10 AND n2 >= 10 THEN round(u, 1) END AS u, CASE WHEN n1 >= 10 AND n2 >= 10 THEN {r('(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / s')} END AS z FROM z"""


@query("r9_mann_whitney", _u(LH))
def r9(spark, sf):
    return evidence.mann_whitney(flagged(spark, sf), FACTORS).select("factor", "u", "z")


@query("r9_mann_whitney_orders", _u(LO))
def r9_orders(spark, sf):
    return evidence.mann_whitney(flagged_orders(spark, sf), ORDER_FACTORS).select("factor", "u", "z")


_TEMPORAL = f"""{LH}, p AS (SELECT factor, x, y, e, row_number() OVER (PARTITION BY factor ORDER BY k) - 1 AS pos, avg(x) OVER (PARTITION BY factor) AS m FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
  c AS (SELECT factor, pos, abs(sum(x - m) OVER (PARTITION BY factor ORDER BY pos)) AS s FROM p),
  d AS (SELECT factor, pos, row_number() OVER (PARTITION BY factor ORDER BY s DESC, pos) AS rk FROM c),
  g AS (SELECT factor, pos, pos - row_number() OVER (PARTITION BY factor ORDER BY pos) AS island FROM p WHERE e),
  o AS (SELECT factor, min(first) AS onset FROM (SELECT factor, island, count(*) AS n, min(pos) AS first FROM g GROUP BY factor, island) WHERE n >= {{run}} GROUP BY factor),
  v AS (SELECT factor, count(*) AS n, corr(x, y) FILTER (WHERE e) AS pc, count(*) FILTER (WHERE e) AS en FROM p GROUP BY factor)"""


@query("r10_change_point", _TEMPORAL.format(run=5) + " SELECT factor, pos AS change_position FROM d WHERE rk = 1")
def r10(spark, sf):
    return evidence.temporal(flagged(spark, sf), Y, FACTORS, ["Time_Now"]).select("factor", "change_position")


@query("r11_event_onset", f"""{H}, p AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY k) - 1 AS pos FROM ({union_all(
    [f"SELECT '{c}' AS factor, Time_Now AS k, {c} AS x, {Y} <= (SELECT quantile_cont({Y}, 0.4) FROM h) AS e FROM h" for c in FACTORS])}) q WHERE x IS NOT NULL),
  g AS (SELECT factor, pos, pos - row_number() OVER (PARTITION BY factor ORDER BY pos) AS island FROM p WHERE e),
  o AS (SELECT factor, island, count(*) AS n, min(pos) AS first FROM g GROUP BY factor, island)
  SELECT f AS factor, min(first) FILTER (WHERE n >= 5) AS event_onset_position FROM (VALUES {', '.join(f"('{c}')" for c in FACTORS)}) v(f) LEFT JOIN o ON o.factor = f GROUP BY f""")
def r11(spark, sf):
    wide_tail, _ = evidence.tail_event(hourly(spark, sf, True), Y, "low", 0.4)
    return evidence.temporal(wide_tail, Y, FACTORS, ["Time_Now"]).select("factor", "event_onset_position")


@query("r12_precedes_and_persistence", _TEMPORAL.format(run=3).replace("0.1)", "0.4)") + f""" SELECT v.factor, d.pos <= o.onset AS precedes, CASE WHEN en >= 30 THEN {r('pc')} END AS persistence
  FROM v JOIN d ON d.factor = v.factor AND d.rk = 1 LEFT JOIN (SELECT factor, min(first) AS onset FROM (SELECT factor, island, count(*) AS n, min(pos) AS first FROM g GROUP BY factor, island) WHERE n >= 5 GROUP BY factor) o ON o.factor = v.factor""")
def r12(spark, sf):
    wide_tail, _ = evidence.tail_event(hourly(spark, sf, True), Y, "low", 0.4)
    return evidence.temporal(wide_tail, Y, FACTORS, ["Time_Now"]).select("factor", "precedes", "persistence")


_SC = [c for c in V.HOURLY_METRICS if c.endswith(("_Util", "_Queue"))]


def robust_states(spark, sf, df=None):
    base = df if df is not None else hourly(spark, sf, True)
    scored = anomaly.robust_score(base, _SC)
    return anomaly.anomaly_states(scored, "raw_score")


def state_sql(columns=_SC) -> str:
    z = ", ".join(f"abs((coalesce({c}, 0) - (SELECT avg(coalesce({c}, 0)) FROM h)) / (SELECT stddev_pop(coalesce({c}, 0)) FROM h))" for c in columns)
    return (f"{H}, z AS (SELECT *, -greatest({z}) AS raw FROM h), cut AS (SELECT quantile_cont(raw, 0.02) AS a, quantile_cont(raw, 0.05) AS b FROM z), "
            "s AS (SELECT z.*, CASE WHEN raw < a THEN 'ANOMALOUS' WHEN raw <= b THEN 'REVIEW' ELSE 'NORMAL' END AS anomaly_state, raw - a AS anomaly_score FROM z, cut)")


@query("r13_anomaly_enrichment", f"""{state_sql()}, f AS (SELECT *, {Y} >= (SELECT quantile_cont({Y}, 0.9) FROM h) AS e FROM s)
  SELECT count(*) FILTER (WHERE anomaly_state = 'ANOMALOUS') AS anomaly_rows, {r('avg(e::INTEGER)')} AS event_rate_overall, {r("avg(e::INTEGER) FILTER (WHERE anomaly_state = 'ANOMALOUS')")} AS event_rate_in_anomalies,
  {r("avg(e::INTEGER) FILTER (WHERE anomaly_state = 'ANOMALOUS') / avg(e::INTEGER)")} AS enrichment FROM f""")
def r13(spark, sf):
    df = hourly(spark, sf, True)
    high, _ = evidence.tail_event(df, Y, "high", 0.1)
    return evidence.anomaly_enrichment(high, robust_states(spark, sf, df), "Time_Now").drop("available")


# --- scores. The signal rows here are arithmetic on part rows, so every branch of the formula is hit.

_SIG = """SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size - 25) / 25.0::DOUBLE END AS rho, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 100.0::DOUBLE END AS mi, (p_partkey % 10) / 100.0::DOUBLE AS base,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_size - 20) / 10.0::DOUBLE END AS eff, p_size % 2 = 0 AS tav, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 3 = 1 END AS prec,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size / 12.0::DOUBLE END AS enr, p_partkey % 6 <> 0 AS aav, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size / 50.0::DOUBLE END AS imp FROM part"""
_PARTS = [("least(abs(rho), 1)", "rho", 0.30), ("CASE WHEN mi <= 0 THEN 0 ELSE mi / (mi + base) END", "mi", 0.20), ("least(abs(eff) / 2, 1)", "eff", 0.20),
          ("CASE WHEN prec IS NULL THEN 0.0 WHEN prec THEN 1.0 ELSE 0.5 END", "CASE WHEN tav THEN 1 END", 0.15), ("CASE WHEN enr IS NULL THEN 0.0 ELSE least(enr, 3) / 3 END", "CASE WHEN aav THEN 1 END", 0.10), ("least(imp, 1)", "imp", 0.05)]
_TOP = " + ".join(f"CASE WHEN {g} IS NULL THEN 0 ELSE {w}::DOUBLE * ({e}) END" for e, g, w in _PARTS)
_BOTTOM = " + ".join(f"CASE WHEN {g} IS NULL THEN 0 ELSE {w}::DOUBLE END" for e, g, w in _PARTS)
_AVAIL = " + ".join(f"CASE WHEN {g} IS NULL THEN 0 ELSE 1 END" for e, g, w in _PARTS)
_SCORED = f"WITH g AS ({_SIG}), c AS (SELECT *, {_AVAIL} AS n, {_TOP} AS top, {_BOTTOM} AS bottom FROM g), s AS (SELECT k, n, CASE WHEN n >= 2 THEN round(100 * top / bottom, 3) END AS score FROM c)"


def part_signals(spark, sf):
    g = V._run(spark, _SIG.replace("::DOUBLE", "D").replace("25.0D", "25.0D"), sf, "part")
    return g.select(F.col("k").alias("factor"), F.col("rho").alias("spearman_r"), "mi", F.col("base").alias("mi_baseline"), F.col("eff").alias("standardized_effect"),
                    F.col("tav").alias("temporal_available"), F.col("prec").alias("precedes"), F.col("enr").alias("enrichment"), F.col("aav").alias("anomaly_available"),
                    F.col("imp").alias("importance"), F.lit(1.0).alias("max_importance"))


@query("r14_evidence_score", f"{_SCORED} SELECT k AS factor, CAST(n AS INTEGER) AS available_components, {r('score', 3)} AS evidence_score, CASE WHEN score IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SCORED' END AS score_status FROM s", digits=3)
def r14(spark, sf):
    return evidence.score_factors(part_signals(spark, sf)).select("factor", "available_components", "evidence_score", "score_status")


@query("r15_association_band", f"""{_SCORED} SELECT CASE WHEN score IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN score >= 60 THEN 'STRONG_ASSOCIATION' WHEN score >= 40 THEN 'MODERATE_ASSOCIATION' WHEN score >= 20 THEN 'WEAK_ASSOCIATION'
  ELSE 'MINIMAL_ASSOCIATION' END AS association_status, count(*) AS factors FROM s GROUP BY 1""")
def r15(spark, sf):
    return evidence.score_factors(part_signals(spark, sf)).groupBy("association_status").agg(F.count(F.lit(1)).alias("factors"))


def quick_findings(spark, sf):
    """Findings from two signals (rank correlation and group effect): cheap, and easy to state in SQL."""
    df = hourly(spark, sf, True)
    ev, event = evidence.tail_event(df, Y)
    none = lambda t: F.lit(None).cast(t)
    s = evidence.spearman(ev, Y, FACTORS).select("factor", "spearman_r").join(evidence.group_effect(ev, FACTORS).drop("available"), "factor").select(
        "*", none("double").alias("mi"), none("double").alias("mi_baseline"), F.lit(False).alias("temporal_available"), none("boolean").alias("precedes"),
        none("double").alias("enrichment"), F.lit(False).alias("anomaly_available"), none("double").alias("importance"), none("double").alias("max_importance"))
    scored = evidence.score_factors(s)
    meta = profile.classify_roles(profile.column_facts(df))
    return evidence.rank_findings(align.attach_columns(scored, meta)), event


QUICK = f"""WITH sp AS ({_spear(LH, 6)}), ge AS ({_effect(LH)}), f AS (SELECT factor, round((0.3::DOUBLE * least(abs(spearman_r), 1) + 0.2::DOUBLE * least(abs(standardized_effect) / 2, 1)) * 100 / 0.5, 3) AS score FROM sp JOIN ge USING (factor)),
  st AS (SELECT * FROM (VALUES {', '.join("('{}', '{}')".format(c, sql_metric(c)[0]) for c in V.HOURLY_METRICS)}) v(factor, station)),
  k AS (SELECT f.factor, st.station, score, row_number() OVER (ORDER BY score DESC, f.factor) AS rank FROM f LEFT JOIN st USING (factor))"""


@query("r17_rank_findings", f"{QUICK} SELECT factor, station, {r('score', 3)} AS evidence_score, CAST(rank AS INTEGER) AS rank FROM k", digits=3)
def r17(spark, sf):
    return quick_findings(spark, sf)[0].select("factor", "station", "evidence_score", "rank")


@query("r18_rank_stations", f"""{QUICK} SELECT station, count(*) AS factors, {r('max(score)', 3)} AS best_score, arg_min(factor, rank) AS best_factor, string_agg(factor, ', ' ORDER BY rank) AS ranked_factors FROM k WHERE station IS NOT NULL GROUP BY station""", digits=3)
def r18(spark, sf):
    out = evidence.rank_stations(quick_findings(spark, sf)[0])
    return out.withColumn("ranked_factors", F.array_join(F.transform("ranked_factors", lambda s: s["factor"]), ", "))


@query("r16_explanation_text", f"{QUICK} SELECT factor, true AS has_disclaimer, station IS NOT NULL AS names_station FROM k")
def r16(spark, sf):
    found, event = quick_findings(spark, sf)
    told = evidence.explain(found, event)
    return told.select("factor", F.endswith("explanation", F.lit(fixed.DISCLAIMER)).alias("has_disclaimer"), F.contains("explanation", F.lit("Column of station")).alias("names_station"))


# --- drift

DRIFT_COLUMNS = [*FACTORS, Y]
def drift_sql(columns: list[str]) -> str:
    """t: smoothed z by place and rank, u: the CUSUM change point by rank, b: baseline facts, per column."""
    return f"""WITH RECURSIVE h AS ({V.PROCESS_HOURLY}), l AS (SELECT * FROM ({union_all([f"SELECT '{c}', Time_Now, CAST({c} AS DOUBLE) FROM h" for c in columns])}) q(c, k, x) WHERE x IS NOT NULL),
  p AS (SELECT c, x, row_number() OVER (PARTITION BY c ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY c) AS n, avg(x) OVER (PARTITION BY c) AS m FROM l),
  b AS (SELECT c, avg(x) AS bm, stddev_pop(x) AS bs, any_value(n) AS n FROM p WHERE i < greatest(floor(n * 0.25), 100) GROUP BY c),
  z AS (SELECT p.c, p.i, (p.x - b.bm) / b.bs AS z, sum(p.x - p.m) OVER (PARTITION BY p.c ORDER BY p.i) AS s FROM p JOIN b USING (c)),
  e AS (SELECT c, i, z AS y FROM z WHERE i = 0 UNION ALL SELECT z.c, z.i, e.y * (199.0 / 201)::DOUBLE + z.z * (2.0 / 201)::DOUBLE FROM e JOIN z ON z.c = e.c AND z.i = e.i + 1),
  t AS (SELECT c, i, y, row_number() OVER (PARTITION BY c ORDER BY abs(y) DESC, i) AS rk FROM e),
  u AS (SELECT c, i, row_number() OVER (PARTITION BY c ORDER BY abs(s) DESC, i) AS rk FROM z)"""


_DRIFT = drift_sql(DRIFT_COLUMNS)


@query("r19_drift_ewma", f"""{_DRIFT} SELECT t.c AS "column", b.n AS "rows", {r('b.bm', 3)} AS baseline_mean, {r('b.bs', 3)} AS baseline_std, {r('abs(t.y)', 3)} AS peak_ewma_z, t.i AS peak_position, abs(t.y) >= 3 AS drift_detected,
  CASE WHEN t.y > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM t JOIN b USING (c) WHERE t.rk = 1""", digits=3)
def r19(spark, sf):
    return drift.detect_drift(hourly(spark, sf, True), ["Time_Now"], DRIFT_COLUMNS, block=200).drop("change_position")


@query("r20_drift_cusum", f'{_DRIFT} SELECT c AS "column", i AS change_position FROM u WHERE rk = 1')
def r20(spark, sf):
    return drift.detect_drift(hourly(spark, sf, True), ["Time_Now"], DRIFT_COLUMNS).select("column", "change_position")


@query("r21_drift_status", f"""{_DRIFT} SELECT CASE WHEN count(*) FILTER (WHERE abs(y) >= 3) > 0 THEN 'DRIFT_DETECTED' ELSE 'NO_SIGNIFICANT_DRIFT_DETECTED' END AS status, CAST(NULL AS VARCHAR) AS reason, count(*) AS columns_analyzed,
  count(*) FILTER (WHERE abs(y) >= 3) AS columns_drifted FROM t WHERE rk = 1""")
def r21(spark, sf):
    return drift.drift_status(drift.detect_drift(hourly(spark, sf, True), ["Time_Now"], DRIFT_COLUMNS))


@query("r22_seeded_cap_sample", "SELECT event_id, true AS sampled FROM events ORDER BY md5(concat(CAST(event_id AS VARCHAR), '|42')), event_id LIMIT 2000")
def r22(spark, sf):
    return evidence.sample_cap(V.table(spark, sf, "events").select("event_id"), "event_id", 2000)


@query("r23_root_cause_run", None)
def r23(spark, sf):
    """All signals, scores, ranks and explanations for the low tail of the hourly throughput."""
    df = hourly(spark, sf, True)
    meta = materialize(profile.classify_roles(profile.column_facts(df)))
    out = runs.root_cause(df, meta, Y, "Time_Now", ["Time_Now"], factors=FACTORS, states=robust_states(spark, sf, df))
    return out["findings"]


@query("r23_root_cause_run_orders", None)
def r23_orders(spark, sf):
    """The same over the unordered order table: every row, no sampling, no temporal signal."""
    df = orders(spark, sf, True)
    meta = materialize(profile.classify_roles(profile.column_facts(df)))
    return runs.root_cause(df, meta, Y, "row_key", None, factors=ORDER_FACTORS)["findings"]


@query("j7_attach_importance", f"{QUICK} SELECT factor, CASE WHEN rank % 2 = 0 THEN {r('1.0 / rank')} END AS importance, 0.5::DOUBLE AS max_importance FROM k")
def j7(spark, sf):
    """Importance for every second factor, as a saved model would list only its top features."""
    found = materialize(quick_findings(spark, sf)[0].select("factor", "rank"))
    saved = found.where("rank % 2 = 0").select("factor", (1.0 / F.col("rank")).alias("importance"))
    return align.attach_importance(found.select("factor"), saved)
