"""Process anomalies: isolation forest as a Spark job, plus a deterministic robust score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelens.functions import fixed
from linelens.functions.expr import finite, is_numeric, q, rounded
from linelens.operators.ordered import exact_quantiles, with_row_index
from linelens.operators.profile import varying

TREES, SAMPLE, CONTAMINATION, REVIEW_SHARE, MIN_ROWS = 200, 256, 0.02, 0.05, 50


def anomaly_features(df: DataFrame, targets: list[str], excludes: list[str] | None = None) -> list[str]:
    """Numeric, varying columns that are no target and whose name holds no excluded token."""
    tokens = fixed.ANOMALY_NAME_EXCLUDES if excludes is None else excludes
    names = [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in targets and not any(t in f.name.lower() for t in tokens)]
    varies = varying(df, names)
    return [c for c in names if c in varies]


def standardized(df: DataFrame, features: list[str]) -> tuple[list[Column], list[tuple[float, float]]]:
    """z columns (missing as 0 before scaling) and the (mean, deviation) behind them."""
    filled = [F.coalesce(finite(q(c)), F.lit(0.0)) for c in features]
    row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(filled)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(filled)]).first()
    facts = [(row[f"m{i}"], row[f"s{i}"] or 1.0) for i in range(len(features))]
    return [(v - F.lit(m)) / F.lit(s) for v, (m, s) in zip(filled, facts)], facts


def _uniform(seed: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, depth value) of one random isolation tree."""
    nodes: list[list] = []

    def build(part: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + _mean_depth(len(part))])
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(0), np.zeros(0))
        free = np.flatnonzero(high > low)
        if depth < limit and len(part) > 1 and len(free):
            f = int(rng.choice(free))
            cut = float(rng.uniform(low[f], high[f]))
            left = part[:, f] <= cut
            nodes[me][:2] = [f, cut]
            nodes[me][2] = build(part[left], depth + 1)
            nodes[me][3] = build(part[~left], depth + 1)
        return me

    build(rows, 0)
    return [tuple(n) for n in nodes]


def _mean_depth(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def fit_forest(df: DataFrame, key: str, features: list[str], seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> dict:
    """Grow each tree on its own seeded sample of at most ``sample`` rows, in parallel tasks.

    Sampling is part of the method. A first seeded draw keeps about 2 * trees * sample rows
    whatever the table size, so only that pool is offered to the trees.
    """
    n = df.count()
    z, facts = standardized(df, features)
    pool_share = min(1.0, 2.0 * trees * sample / max(n, 1))
    pool = df.select(q(key).alias("_k"), F.array(*z).alias("_z")).where(_uniform(seed, F.col("_k")) < pool_share)
    take = min(1.0, 1.5 * sample / max(n * pool_share, 1.0))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _uniform(seed + 1, F.col("_k"), t) < take)  # before any copy is made
    offered = pool.select("_k", "_z", F.explode(drawn).alias("tree"))
    place = F.row_number().over(W.partitionBy("tree").orderBy(F.xxhash64("_k", "tree", F.lit(seed + 2)), "_k"))
    chosen = offered.withColumn("_r", place).where(F.col("_r") <= sample).select("tree", "_k", "_z")
    limit = int(np.ceil(np.log2(sample)))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_k")
        tree = int(part["tree"].iloc[0])
        nodes = _grow(np.stack(part["_z"].to_numpy()), np.random.default_rng(seed * 100_003 + tree), limit)
        frame = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
        frame.insert(0, "node", range(len(frame)))
        frame.insert(0, "rows", len(part))
        frame.insert(0, "tree", tree)
        return frame

    nodes = chosen.groupBy("tree").applyInPandas(grow, "tree int, rows int, node int, feature int, cut double, left int, right int, depth double")
    # at most trees * 2 * sample nodes, whatever the data size
    grown = nodes.orderBy("tree", "node").toPandas()
    return {"features": features, "scale": facts, "nodes": grown, "sample": int(grown.groupby("tree")["rows"].first().max())}


def score_forest(df: DataFrame, model: dict, name: str = "raw_score") -> DataFrame:
    """Isolation score of every row (lower is more unusual), in Arrow batches over a broadcast forest."""
    frame = model["nodes"]
    forest = [(t["feature"].to_numpy(), t["cut"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(), t["depth"].to_numpy())
              for _, t in frame.groupby("tree", sort=True)]
    norm = _mean_depth(model["sample"]) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(z: pd.Series) -> pd.Series:
        if len(z) == 0:
            return pd.Series([], dtype="float64")
        x = np.stack(z.to_numpy())
        total = np.zeros(len(x))
        for feature, cut, left, right, depth in shared.value:
            at = np.zeros(len(x), dtype=int)
            live = np.arange(len(x))
            while len(live):
                f = feature[at[live]]
                live = live[f >= 0]
                f = f[f >= 0]
                go = x[live, f] <= cut[at[live]]
                at[live] = np.where(go, left[at[live]], right[at[live]])
            total += depth[at]
        return pd.Series(-np.power(2.0, -(total / len(shared.value)) / norm))

    z = F.array(*[(F.coalesce(finite(q(c)), F.lit(0.0)) - F.lit(m)) / F.lit(s) for c, (m, s) in zip(model["features"], model["scale"])])
    return df.withColumn(name, score(z))


def anomaly_states(scored: DataFrame, score: str) -> DataFrame:
    """The lowest 2% are ANOMALOUS, up to 5% REVIEW, the rest NORMAL; the score is shifted to its 2% cut."""
    low, review = exact_quantiles(scored, {score: [CONTAMINATION, REVIEW_SHARE]})[score]
    c = q(score)
    return scored.withColumn("anomaly_state", F.when(c < low, "ANOMALOUS").when(c <= review, "REVIEW").otherwise("NORMAL")).withColumn(
        "anomaly_score", c - F.lit(low))


def detect_anomalies(df: DataFrame, key: str, targets: list[str], seed: int = 42, trees: int = TREES) -> tuple[DataFrame | None, dict]:
    """All rows with state and score, and the status of the run."""
    features = anomaly_features(df, [*targets, key])
    n = df.count()
    if len(features) < 2:
        return None, {"status": "NOT_SUPPORTED", "reason": "fewer than 2 usable numeric process features", "features": features}
    if n < MIN_ROWS:
        return None, {"status": "NOT_SUPPORTED", "reason": f"only {n} rows; at least {MIN_ROWS} are required", "features": features}
    from linelens.session import materialize

    # scored once and kept: the state cuts and every later reader use the same scores
    scored = materialize(score_forest(df, fit_forest(df, key, features, seed, trees)))
    return anomaly_states(scored, "raw_score").drop("raw_score"), {"status": "READY", "reason": None, "features": features}


def robust_score(df: DataFrame, features: list[str], name: str = "raw_score") -> DataFrame:
    """Deterministic twin of the forest: minus the largest |z| over the features."""
    z, _ = standardized(df, features)
    return df.withColumn(name, -F.greatest(*[F.abs(c) for c in z]))


def score_percentile(scored: DataFrame, key: str, score: str) -> DataFrame:
    """Place of each score among all scores, 0 to 100."""
    n = scored.count()
    return with_row_index(scored, [score, key]).withColumn("percentile", F.round(F.col("row_index") / max(n - 1, 1) * 100.0, 2)).drop("_part", "_local", "row_index")


def top_deviations(scored: DataFrame, base: DataFrame, features: list[str], key: str) -> DataFrame:
    """The three largest |z| features of every anomalous row."""
    z, _ = standardized(base, features)
    parts = F.array(*[F.struct(F.abs(c).alias("abs_z"), F.lit(f).alias("feature"), q(f).cast("double").alias("value")) for f, c in zip(features, z)])
    rows = scored.where("anomaly_state = 'ANOMALOUS'").select(q(key), "anomaly_score", F.slice(F.sort_array(parts, asc=False), 1, 3).alias("top"))
    return rows.select(key, rounded(F.col("anomaly_score")).alias("score"), F.posexplode("top").alias("place", "t")).select(
        key, "score", "place", "t.feature", F.round("t.abs_z", 3).alias("abs_z"), F.round("t.value", 6).alias("value"))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("anomaly_state").agg(F.count(F.lit(1)).alias("rows"), rounded(F.min("anomaly_score")).alias("score_min"),
                                               rounded(F.max("anomaly_score")).alias("score_max"))
