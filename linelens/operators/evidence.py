"""Root-cause evidence: how each factor goes along with a bad outcome. Association only.

Signals that need no order are one wide aggregation over all factors. Rank signals
aggregate to distinct values before anything is sorted. Ordered signals share one
range-partitioned pass (see ordered.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelens.functions import fixed
from linelens.functions.expr import (
    at_least, at_most, corr_sql, finite, finite_sql, is_numeric, literal, q, rounded, stack_rows, stack_sql, to_long, two_sided_p, weighted_score)
from linelens.functions.tails import correlation_p
from linelens.operators.ordered import attach, average_ranks, cumulative, exact_quantiles, ranked_quantiles, running_sums, with_row_index
from linelens.operators.profile import varying
from linelens.operators.split import seeded_key, with_previous
from linelens.session import materialize

MI_BINS = 16
EVENT = "_event"


# --- targets, events, factors

def discover_targets(columns: DataFrame) -> DataFrame:
    """Targets among column metadata rows.

    ``columns``: input, mode ('model_input' or 'process_table'), column, role, numeric, nonnull,
    unique, ordinal, min, max, mean. Every usable column of every input is listed.
    """
    name = F.col("column")
    usable = columns.where(
        (F.col("nonnull") >= fixed.MIN_TARGET_ROWS) & (F.col("unique") > 1) & F.col("numeric")
        & ~name.rlike("(?i)" + fixed.TARGET_EXCLUDES)
        & ((F.col("mode") != "model_input") | F.col("role").isin(fixed.RESPONSE_ROLES)))
    # the window sees column metadata: one row per column of the inputs
    ordered = usable.withColumn("rank", F.row_number().over(
        W.orderBy((F.col("mode") != "model_input").cast("int"), "input", "column")))
    return ordered.select(
        "rank", F.col("column").alias("target"), "input", "mode", F.col("nonnull").alias("rows_with_target"),
        rounded(F.col("min")).alias("target_min"), rounded(F.col("max")).alias("target_max"), rounded(F.col("mean")).alias("target_mean"))


def resolve_target(targets: DataFrame, target: str, input_name: str | None = None) -> DataFrame:
    """The one row to use for a target name; a model input wins over a plain table."""
    hit = targets.where(F.col("target") == target)
    if input_name:
        hit = hit.where(F.col("input") == input_name)
    return hit.orderBy((F.col("mode") != "model_input").cast("int"), "rank").limit(1)


def choose_source(targets: DataFrame, processed: DataFrame) -> DataFrame:
    """The full processed table where it holds the target, else the narrower model input.

    ``processed``: input, column. One row per column of the stored tables.
    """
    have = processed.select("input", F.col("column").alias("target"), F.lit(True).alias("_have")).distinct()
    return targets.join(have, ["input", "target"], "left").withColumn(
        "artifact", F.when(F.col("_have") | (F.col("mode") == "process_table"), "processed_data").otherwise("model_inputs")).drop("_have")


def tail_event(df: DataFrame, target: str, direction: str = "low", quantile: float = 0.1) -> tuple[DataFrame, dict]:
    """Rows with an ``_event`` flag for the target's low or high tail, and the event's definition."""
    if direction not in ("low", "high"):
        raise ValueError("INVALID_DIRECTION: the event direction is 'low' or 'high'")
    if not 0.01 <= quantile <= 0.4:
        raise ValueError("INVALID_QUANTILE: the event quantile lies between 0.01 and 0.4")
    y = finite(q(target))
    usable = df.agg(F.count(y).alias("n")).first()["n"]
    if usable < fixed.MIN_TARGET_ROWS:
        raise ValueError(f"INSUFFICIENT_DATA: '{target}' has {usable} usable values; {fixed.MIN_TARGET_ROWS} are required")
    p = quantile if direction == "low" else 1 - quantile
    threshold = exact_quantiles(df, {target: [p]})[target][0]
    hit = y <= threshold if direction == "low" else y >= threshold
    flagged = df.withColumn(EVENT, F.coalesce(hit, F.lit(False)))
    sign = "<=" if direction == "low" else ">="
    return flagged, {"target": target, "direction": direction, "quantile": quantile, "threshold": threshold,
                     "definition": f"target {sign} {p:.0%} percentile ({threshold:.6g})"}


def event_summary(flagged: DataFrame, event: dict) -> DataFrame:
    return flagged.agg(F.count_if(F.col(EVENT)).alias("event_rows"), F.count_if(~F.col(EVENT)).alias("non_event_rows")).select(
        F.lit(event["target"]).alias("target"), F.lit(event["direction"]).alias("direction"),
        F.lit(event["quantile"]).alias("quantile"), rounded(F.lit(event["threshold"])).alias("threshold"),
        "event_rows", "non_event_rows")


def select_factors(df: DataFrame, target: str, responses: list[str]) -> tuple[list[str], list[str]]:
    """(factors, excluded): numeric, varying, not a response, id or split column; table order."""
    barred = {target, *responses, *fixed.FACTOR_EXCLUDES, EVENT}
    names = [f.name for f in df.schema if f.name not in barred and "_id" not in f.name.lower() and is_numeric(f.dataType)]
    varies = varying(df, names)
    factors = [c for c in names if c in varies]
    return factors, [c for c in df.columns if c not in factors and c != EVENT]


# --- order-free signals

def correlations(df: DataFrame, y: str, factors: list[str]) -> DataFrame:
    """Pearson r and p per factor over the rows where both are present: one wide scan."""
    yy, aggs = finite_sql(y), []
    for i, c in enumerate(factors):
        x = finite_sql(c)
        px, py = f"CASE WHEN {yy} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {yy} END"
        aggs += [f"count({px}) AS n{i}", f"{corr_sql(x, yy)} AS r{i}", f"(max({px}) > min({px}) AND max({py}) > min({py})) AS v{i}"]
    rows = stack_sql(df.selectExpr(*aggs), [{"factor": literal(c), "n": f"n{i}", "r": f"r{i}", "varies": f"v{i}"} for i, c in enumerate(factors)])
    ok = (F.col("n") >= 30) & F.col("varies")
    return rows.select("factor", "n", ok.alias("available"), F.when(ok, rounded(F.col("r"))).alias("pearson_r"),
                       F.when(ok, rounded(correlation_p(F.col("r"), F.col("n")), 8)).alias("pearson_p"))


@dataclass
class FactorRanks:
    """The distinct values of every factor in order, once for all rank signals of a target.

    ``values``: i (factor number), x, ``n`` rows, ``ny`` rows with a target, ``b`` sum of the target's centred ranks beside
    them, ``e`` events where the rows are flagged, ``before_n`` and ``before_ny`` rows below. ``levels``: the same for
    the target (y, n, before_n). ``spread``: factor, bb.
    """

    factors: list[str]
    values: DataFrame
    levels: DataFrame
    spread: DataFrame

    def label(self) -> Column:
        return F.get(F.array(*[F.lit(c) for c in self.factors]), F.col("i")).alias("factor")


def factor_ranks(df: DataFrame, y: str, factors: list[str]) -> FactorRanks:
    """Ranks of the target and of every factor, exact on all rows.

    The target is ranked once for all factors: a distinct value counts the rows of each factor, so gaps need no
    second ranking. Its ranks are then summed by distinct factor value, and no row is joined to a factor's rank.
    """
    # kept once: the passes below read it
    names = [f"x{i}" for i in range(len(factors))]
    event = F.col(EVENT).cast("int") if EVENT in df.columns else F.lit(None).cast("int")
    base = materialize(df.select(finite(q(y)).alias("y"), event.alias("e"), *[finite(q(c)).alias(n) for c, n in zip(factors, names)]))
    known = base.where("y is not null")
    # of the target: a row a distinct value with its count beside each factor, and its centred rank there
    counts = [f"c{i}" for i in range(len(factors))]
    levels = known.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.count(n).alias(c) for c, n in zip(counts, names)])
    placed = materialize(cumulative(levels, [], ["y"], {c: F.col(c) for c in ["n", *counts]}))
    sizes = placed.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", *counts]]).first()
    centred = lambda c: F.col(f"before_{c}") + (F.col(c) + 1) / 2.0 - (sizes[c] + 1) / 2.0
    y_ranks = placed.select("y", "n", *counts, *[centred(c).alias(f"b{i}") for i, c in enumerate(counts)])
    spread = y_ranks.agg(*[F.sum(F.col(f"c{i}") * F.col(f"b{i}") * F.col(f"b{i}")).alias(f"bb{i}") for i in range(len(factors))])
    spread = stack_rows(spread, [{"factor": F.lit(c), "bb": F.col(f"bb{i}")} for i, c in enumerate(factors)])
    # of a factor: a row a distinct value with the sum of the target's ranks beside it
    ranked = attach(known, y_ranks.select("y", "n", *[f"b{i}" for i in range(len(factors))]), ["y"], total=sizes["n"])
    ranked = ranked.unionByName(base.where("y is null"), allowMissingColumns=True)
    cells = F.arrays_zip(F.array(*names).alias("x"), F.array(*[f"b{i}" for i in range(len(factors))]).alias("b"))
    long = ranked.select("e", F.posexplode(cells).alias("i", "s")).select("i", "s.x", "s.b", "e").where("x is not null")
    freq = long.groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"), F.count("b").alias("ny"), F.sum("b").alias("b"), F.sum("e").alias("e"))
    values = materialize(cumulative(freq, ["i"], ["x"], {"n": F.col("n"), "ny": F.col("ny")}))
    return FactorRanks(factors, values, placed.select("y", "n", "before_n"), spread)


def rank_edges(ranks: FactorRanks, y: str, bins: int) -> dict[str, list[float | None]]:
    """The exact bin edges of target and factors, read off their ranks."""
    both = ranks.levels.select(F.lit(-1).alias("k"), F.col("y").alias("v"), "n", "before_n").unionByName(
        ranks.values.select(F.col("i").alias("k"), F.col("x").alias("v"), "n", "before_n"))
    found = ranked_quantiles(both, [k / bins for k in range(1, bins)])
    none = [None] * (bins - 1)
    return {y: found.get(-1, none)} | {c: found.get(i, none) for i, c in enumerate(ranks.factors)}


def spearman(df: DataFrame, y: str, factors: list[str], ranks: FactorRanks | None = None) -> DataFrame:
    """Average-rank correlation per factor, exact on all rows. ``ranks`` of the same rows may be shared with other signals."""
    ranks = factor_ranks(df, y, factors) if ranks is None else ranks
    per_x = ranks.values.where("ny > 0").select(ranks.label(), "i", F.col("ny").alias("n"), "b", (F.col("before_ny") + (F.col("ny") + 1) / 2.0).alias("avg_rank"))
    held = per_x.groupBy("i").agg(F.sum("n").alias("held"))  # one row a factor
    a = F.col("avg_rank") - (F.col("held") + 1) / 2.0
    sums = per_x.join(F.broadcast(held), "i").select("factor", "n", "b", a.alias("a")).groupBy("factor").agg(
        F.sum("n").alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("n") * F.col("a") * F.col("a")).alias("aa")).join(F.broadcast(ranks.spread), "factor")
    ok = (F.col("n") >= 30) & (F.col("aa") > 0) & (F.col("bb") > 0)
    r = F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))
    return sums.select("factor", "n", F.when(ok, rounded(r)).alias("spearman_r"), F.when(ok, rounded(correlation_p(r, F.col("n")), 8)).alias("spearman_p"))


def _bin_numbers(edges: list[np.ndarray], kept: int):
    """Arrow batches: the first ``kept`` columns as they are, of each other one how many of its edges lie below the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(j) for j in range(kept)]
            for j, cuts in enumerate(edges):
                v = batch.column(kept + j).to_numpy(zero_copy_only=False)
                out.append(pa.array(np.searchsorted(cuts, v, side="left").astype(np.int32), mask=np.isnan(v)))
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:kept], *[f"b_{j}" for j in range(len(edges))]])

    return run


def binned(df: DataFrame, columns: list[str], keep: list[Column], bins: int = MI_BINS, edges: dict[str, list[float | None]] | None = None) -> DataFrame:
    """Equal-frequency bin of each column (``b_<i>``), cut at exact quantiles of the column (``edges``, where they are known)."""
    if edges is None:
        edges = exact_quantiles(df, {c: [k / bins for k in range(1, bins)] for c in columns})
    kept = df.select(*keep).schema
    schema = T.StructType([*kept.fields, *[T.StructField(f"b_{i}", T.IntegerType()) for i in range(len(columns))]])
    cuts = [np.array([e for e in edges[c] if e is not None], dtype=float) for c in columns]
    return df.select(*keep, *[finite(q(c)).alias(f"_x{i}") for i, c in enumerate(columns)]).mapInArrow(_bin_numbers(cuts, len(kept)), schema)


def mutual_information(df: DataFrame, y: str, factors: list[str], row_key: str, seed: int = 42, bins: int = MI_BINS,
                       ranks: FactorRanks | None = None) -> DataFrame:
    """Binned mutual information (nats) of each factor with the target, and the same after re-pairing.

    The estimator counts a bins x bins table; the baseline pairs each row with the target bin of
    another row, taken from the neighbour in seeded random order. Both tables come from one
    aggregation whose size does not depend on the rows. ``ranks`` of the same rows give the bin edges.
    """
    edges = None if ranks is None else rank_edges(ranks, y, bins)
    # kept once: the ordering reads it twice
    narrow = materialize(binned(df, [y, *factors], [seeded_key(seed, q(row_key)).alias("_h")], bins, edges).withColumnRenamed("b_0", "by"))
    paired = with_previous(narrow, ["_h"], ["by"]).withColumnRenamed("_prev_by", "bp")
    # one number a cell (factor, bx, by, bp), a missing bin counting as ``bins``: at most (bins + 1)^3 rows a factor leave a task
    wide = bins + 1
    code = lambda c: F.coalesce(F.col(c), F.lit(bins))
    cells = F.array(*[((F.lit(i).cast("long") * wide + F.col(f"b_{i + 1}")) * wide + code("by")) * wide + code("bp") for i in range(len(factors))])
    counts = paired.select(F.explode(cells).alias("c")).where("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    digit = lambda place: F.floor(F.col("c") / F.lit(wide**place)).cast("int")
    names = F.array(*[F.lit(c) for c in factors])
    table = counts.select(F.get(names, digit(3)).alias("factor"), (digit(2) % wide).alias("bx"), "n", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), (digit(1) % wide).alias("b")), F.struct(F.lit(1).alias("side"), (digit(0) % wide).alias("b")))).alias("t"))
    table = table.where(F.col("t.b") < bins).groupBy("factor", "t.side", "bx", "t.b").agg(F.sum("n").alias("n")).toDF("factor", "side", "bx", "b", "n")
    # at most bins * bins rows per factor and side from here on
    key = ["factor", "side"]
    total = F.sum("n").over(W.partitionBy(*key))
    px, py = F.sum("n").over(W.partitionBy(*key, "bx")), F.sum("n").over(W.partitionBy(*key, "b"))
    terms = table.select(*key, "n", total.alias("total"), px.alias("px"), py.alias("py"))
    mi = F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("px") * F.col("py"))))
    per = terms.groupBy(*key).agg(mi.alias("mi"), F.max("total").alias("total"))
    wide = per.groupBy("factor").agg(
        F.max(F.when(F.col("side") == 0, F.col("mi"))).alias("mi"), F.max(F.when(F.col("side") == 1, F.col("mi"))).alias("base"),
        F.max(F.when(F.col("side") == 0, F.col("total"))).alias("n"))
    ok = F.col("n") >= 30
    return wide.select("factor", "n", F.when(ok, rounded(at_least(F.col("mi"), 0.0))).alias("mi"),
                       F.when(ok, rounded(at_least(F.col("base"), 0.0))).alias("mi_baseline"))


def group_effect(flagged: DataFrame, factors: list[str]) -> DataFrame:
    """Means in and out of the event, difference and standardised effect: one wide scan."""
    aggs = []
    for i, c in enumerate(factors):
        for k, cond in (("a", EVENT), ("b", f"NOT {EVENT}")):
            v = f"CASE WHEN {cond} THEN {finite_sql(c)} END"
            aggs += [f"count({v}) AS n{k}{i}", f"avg({v}) AS m{k}{i}", f"var_samp({v}) AS v{k}{i}"]
    rows = stack_sql(flagged.selectExpr(*aggs), [
        {"factor": literal(c), **{f"{s}{k}": f"{s}{k}{i}" for s in "nmv" for k in "ab"}} for i, c in enumerate(factors)])
    ok = (F.col("na") >= 10) & (F.col("nb") >= 10)
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    diff = F.col("ma") - F.col("mb")
    return rows.select("factor", ok.alias("available"), F.col("na").alias("event_n"), F.col("nb").alias("non_event_n"),
                       F.when(ok, rounded(F.col("ma"))).alias("event_mean"), F.when(ok, rounded(F.col("mb"))).alias("non_event_mean"),
                       F.when(ok, rounded(diff)).alias("difference"),
                       F.when(ok, rounded(F.when(pooled > 0, diff / pooled).otherwise(0.0))).alias("standardized_effect"))


def mann_whitney(flagged: DataFrame, factors: list[str], ranks: FactorRanks | None = None) -> DataFrame:
    """Two-sided U test of event against other rows (tie and continuity corrected normal p). ``ranks`` of the same rows may be shared."""
    if ranks is None:
        long = to_long(flagged.withColumn("_e", F.col(EVENT).cast("int")), factors, ["_e"], "factor", "x")
        per_x = average_ranks(long, ["factor"], "x", {"e": F.col("_e")})
    else:
        per_x = ranks.values.select(ranks.label(), "n", "e", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))
    n, t, e = F.col("n"), F.col("n").cast("double"), F.col("e")
    sums = per_x.groupBy("factor").agg(F.sum(n).alias("n"), F.sum(e).alias("n1"), F.sum(e * F.col("avg_rank")).alias("r1"),
                                       F.sum(t * t * t - t).alias("ties"))
    n1, total = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = total - n1
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1))))
    z = (F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sigma
    ok = (n1 >= 10) & (n2 >= 10)
    out = sums.select("factor", ok.alias("ok"), u1.alias("u"), F.when(sigma > 0, z).alias("z"))
    return out.select("factor", F.when(F.col("ok"), rounded(F.col("u"), 1)).alias("u"), F.when(F.col("ok"), rounded(F.col("z"))).alias("z"),
                      F.when(F.col("ok"), rounded(at_most(two_sided_p(at_least(F.col("z"), 0.0)), 1.0), 8)).alias("p"))


# --- ordered signals

def temporal(flagged: DataFrame, y: str, factors: list[str], order_cols: list[str]) -> DataFrame:
    """Change point of each factor, first sustained event, which came first, and persistence."""
    yy, ev = finite(q(y)), F.col(EVENT)
    cols = [c for c in order_cols]
    narrow = flagged.where(yy.isNotNull() & reduce(lambda a, b: a & b, [q(c).isNotNull() for c in cols])).select(
        *[q(c).alias(f"_o{i}") for i, c in enumerate(cols)], yy.alias("_y"), EVENT, *[finite(q(c)).alias(f"x{i}") for i, c in enumerate(factors)])
    stats_aggs = []
    for i in range(len(factors)):
        ex, ey = f"(CASE WHEN {EVENT} THEN x{i} END)", f"(CASE WHEN {EVENT} AND x{i} IS NOT NULL THEN _y END)"
        stats_aggs += [f"count(x{i}) AS n{i}", f"avg(x{i}) AS m{i}", f"count({ex}) AS en{i}", f"{corr_sql(ex, ey)} AS pc{i}",
                       f"(max({ex}) > min({ex}) AND max({ey}) > min({ey})) AS pv{i}"]
    stats = narrow.selectExpr(*stats_aggs)
    known = stats.first()  # one number per factor
    live = [i for i in range(len(factors)) if known[f"n{i}"] >= 200]
    facts = stack_sql(stats, [{"factor": literal(c), "n": f"n{i}", "en": f"en{i}", "pc": f"pc{i}", "pv": f"pv{i}"} for i, c in enumerate(factors)])
    persistence = F.when((F.col("en") >= 30) & F.col("pv"), rounded(F.col("pc")))
    if not live:
        return facts.select("factor", "n", F.lit(False).alias("available"), F.lit(None).cast("long").alias("change_position"),
                            F.lit(None).cast("long").alias("event_onset_position"), F.lit(None).cast("boolean").alias("precedes"), persistence.alias("persistence"))
    indexed = with_row_index(narrow, [f"_o{i}" for i in range(len(cols))])
    sums = {}
    for i in live:
        x = F.col(f"x{i}")
        sums[f"v{i}"] = x.isNotNull().cast("long")
        sums[f"c{i}"] = F.coalesce(x - F.lit(known[f"m{i}"]), F.lit(0.0))
        sums[f"g{i}"] = (x.isNotNull() & ~ev).cast("long")
    ran = running_sums(indexed, sums)
    change = stack_rows(
        ran.agg(*[F.max_by(F.col(f"v{i}") - 1, F.when(F.col(f"x{i}").isNotNull(), F.struct(F.abs(F.col(f"c{i}")), -F.col(f"v{i}")))).alias(f"p{i}") for i in live]),
        [{"factor": F.lit(factors[i]), "change_position": F.col(f"p{i}")} for i in live])
    onset = event_onset(ran.where(ev), [(factors[i], F.col(f"x{i}").isNotNull(), F.col(f"g{i}"), F.col(f"v{i}") - 1) for i in live])
    joined = facts.join(change, "factor", "left").join(onset, "factor", "left")
    available = F.col("n") >= 200
    return joined.select("factor", "n", available.alias("available"), "change_position", "event_onset_position",
                         F.when(F.col("event_onset_position").isNotNull(), F.col("change_position") <= F.col("event_onset_position")).alias("precedes"),
                         F.when(available, persistence).alias("persistence"))


def event_onset(event_rows: DataFrame, factors: list[tuple[str, Column, Column, Column]], run: int = 5) -> DataFrame:
    """First position of ``run`` consecutive events per factor.

    Events between the same two non-events share the running non-event count, so a run is a
    group; groups aggregate map-side, however long one of them is.
    """
    cells = F.array(*[F.when(valid, F.struct(F.lit(f).alias("factor"), g.alias("island"), p.alias("position"))) for f, valid, g, p in factors])
    long = event_rows.select(F.explode(cells).alias("s")).where("s is not null").select("s.*")
    islands = long.groupBy("factor", "island").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position")).where(F.col("n") >= run)
    return islands.groupBy("factor").agg(F.min("position").alias("event_onset_position"))


def anomaly_enrichment(flagged: DataFrame, states: DataFrame, row_key: str) -> DataFrame:
    """Event rate among ANOMALOUS rows against all rows (an event-level value, not per factor)."""
    joined = flagged.select(q(row_key), EVENT).join(states.select(q(row_key), "anomaly_state"), row_key, "left")
    odd = F.coalesce(F.col("anomaly_state") == "ANOMALOUS", F.lit(False))
    e = F.col(EVENT).cast("double")
    row = joined.agg(F.count_if(odd).alias("anomaly_rows"), F.avg(e).alias("overall"), F.avg(F.when(odd, e)).alias("inside"))
    ok = F.col("anomaly_rows") >= 5
    return row.select("anomaly_rows", ok.alias("available"), F.when(ok, rounded(F.col("overall"))).alias("event_rate_overall"),
                      F.when(ok, rounded(F.col("inside"))).alias("event_rate_in_anomalies"),
                      F.when(ok & (F.col("overall") > 0), rounded(F.col("inside") / F.col("overall"))).alias("enrichment"))


# --- scoring (one row per factor from here on)

def score_factors(signals: DataFrame) -> DataFrame:
    """Weighted evidence score over the available components, band, rank and status.

    Expected columns: factor, spearman_r, mi, mi_baseline, standardized_effect, temporal_available,
    precedes, enrichment, anomaly_available, importance, max_importance.
    """
    mi = at_least(F.col("mi"), 0.0)
    parts = {
        "correlation": at_most(F.abs(F.col("spearman_r")), 1.0),
        "mutual_information": F.when(F.col("mi").isNotNull(), F.when(mi <= 0, 0.0).otherwise(mi / (mi + F.coalesce("mi_baseline", F.lit(0.0))))),
        "group_difference": F.when(F.col("standardized_effect").isNotNull(), at_most(F.abs(F.col("standardized_effect")) / 2.0, 1.0)),
        "temporal": F.when(F.col("temporal_available"), F.when(F.col("precedes").isNull(), 0.0).when(F.col("precedes"), 1.0).otherwise(0.5)),
        "anomaly": F.when(F.col("anomaly_available"), F.coalesce(at_most(F.col("enrichment"), 3.0) / 3.0, F.lit(0.0))),
        "model_contribution": F.when(F.col("max_importance") > 0, at_most(F.col("importance") / F.col("max_importance"), 1.0)),
    }
    score, available = weighted_score(parts, fixed.EVIDENCE_WEIGHTS)
    scored = signals.select("*", score.alias("evidence_score"), available.alias("available_components"),
                            *[rounded(c, 4).alias(f"component_{n}") for n, c in parts.items()])
    return scored.withColumn("score_status", F.when(F.col("evidence_score").isNull(), "INSUFFICIENT_EVIDENCE").otherwise("SCORED")).withColumn(
        "association_status", association_band(F.col("evidence_score")))


def association_band(score: Column) -> Column:
    out = F.when(score.isNull(), "INSUFFICIENT_EVIDENCE")
    for floor, band in fixed.ASSOCIATION_BANDS:
        out = out.when(score >= floor, band)
    return out.otherwise("MINIMAL_ASSOCIATION")


def rank_findings(scored: DataFrame) -> DataFrame:
    """Rank by score (unscored last). One row per factor, that is per column, so one window is fine."""
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("evidence_score"), "factor")))


def rank_stations(ranked: DataFrame) -> DataFrame:
    """Per station: factors, best score and factor, and all its factors by rank."""
    best = F.max_by("factor", F.when(F.col("evidence_score").isNotNull(), F.struct("evidence_score", -F.col("rank"))))
    listed = F.sort_array(F.collect_list(F.struct("rank", "factor", F.col("evidence_score").alias("score"))))
    return ranked.where("station is not null").groupBy("station").agg(
        F.count(F.lit(1)).alias("factors"), F.max("evidence_score").alias("best_score"), best.alias("best_factor"), listed.alias("ranked_factors"))


def explain(ranked: DataFrame, event: dict) -> DataFrame:
    """One readable sentence chain per finding; it always ends with the causation disclaimer."""
    tail, target = event["direction"], event["target"]
    rho = F.col("spearman_r")
    words = F.concat_ws(
        " ",
        F.when(rho.isNotNull(), F.format_string(
            "'%s' moves %s '" + target.replace("%", "%%") + "' (rank correlation %.3f).", F.col("factor"),
            F.when(rho > 0, "with").otherwise("against"), rho)),
        F.when(F.col("standardized_effect").isNotNull(), F.format_string(
            f"Mean {tail}-tail value %.6f against %.6f elsewhere (standardised difference %.3f).",
            F.col("event_mean"), F.col("non_event_mean"), F.col("standardized_effect"))),
        F.when(F.col("temporal_available") & F.col("precedes").isNotNull(), F.when(
            F.col("precedes"), "In record order its shift comes no later than the first sustained event.").otherwise(
            "In record order its shift comes after the first sustained event.")),
        F.when(F.col("enrichment").isNotNull(), F.format_string("Events are %.3f times as frequent in anomaly-flagged rows.", F.col("enrichment"))),
        F.when(F.col("evidence_score").isNotNull(), F.format_string("Evidence score %.3f (%s).", F.col("evidence_score"), F.col("association_status"))),
        F.when(F.col("station").isNotNull(), F.format_string("Column of station '%s'.", F.col("station"))),
        F.lit(fixed.DISCLAIMER))
    return ranked.withColumn("explanation", words)


def sample_cap(df: DataFrame, key: str, cap: int, seed: int = 42) -> DataFrame:
    """A seeded sample of at most ``cap`` rows with a ``sampled`` flag, for callers who ask for one; no run takes it."""
    n = df.count()
    if n <= cap:
        return df.withColumn("sampled", F.lit(False))
    return df.orderBy(seeded_key(seed, q(key)), q(key)).limit(cap).withColumn("sampled", F.lit(True))
