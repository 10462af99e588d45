"""Ordered scans without a single-task window.

Spark rows have no order, so each operator takes ``order_cols``: the order key plus a
tie-breaker. The rows are range-partitioned once, sorted inside the partitions and
written to the checkpoint folder, which fixes the partition borders. Whatever runs in
order is then computed per partition, plus an offset per partition. The offset table
has as many rows as there are partitions (times keys), so it is safe to broadcast.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelens.functions.expr import count_below, finite, q
from linelens.session import materialize

PART, LOCAL = "_part", "_local"
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def range_runs(df: DataFrame, order_cols: list, parts: int | None = None) -> DataFrame:
    """Sorted runs: adds ``_part`` (run number, runs are in order) and ``_local`` (0-based place in the run)."""
    runs = df.repartitionByRange(*([parts] if parts else []), *order_cols).sortWithinPartitions(*order_cols)
    runs = runs.withColumn("_m", F.monotonically_increasing_id())
    runs = materialize(runs)
    return runs.select(
        *[q(c) for c in df.columns],
        F.shiftright(F.col("_m"), _LOCAL_BITS).cast("int").alias(PART),
        F.col("_m").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias(LOCAL),
    )


def run_offsets(runs: DataFrame, keys: list[str], weights: dict[str, Column]) -> DataFrame:
    """Total of each weight in all earlier runs, per key: one row per (key, run)."""
    totals = runs.groupBy(*keys, PART).agg(*[F.sum(w).alias(name) for name, w in weights.items()])
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*keys, PART, *[
        F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in weights
    ])


def with_row_index(df: DataFrame, order_cols: list, name: str = "row_index") -> DataFrame:
    """Contiguous 0-based row number in the given order."""
    runs = range_runs(df, order_cols)
    offsets = run_offsets(runs, [], {"_off": F.lit(1)})
    return runs.join(F.broadcast(offsets), PART).select(
        *[q(c) for c in df.columns], (F.col("_off") + F.col(LOCAL)).cast("long").alias(name), PART, LOCAL)


def running_sums(indexed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums in run order. ``indexed`` comes from with_row_index/range_runs."""
    prepared = indexed.select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()])
    offsets = run_offsets(prepared, [], {f"_o_{n}": F.col(f"_v_{n}") for n in sums})
    local = W.partitionBy(PART).orderBy(LOCAL).rowsBetween(W.unboundedPreceding, 0)
    summed = prepared.select(
        *[q(c) for c in indexed.columns],
        *[F.coalesce(F.sum(f"_v_{n}").over(local), F.lit(0)).alias(f"_l_{n}") for n in sums])
    return summed.join(F.broadcast(offsets), PART).select(
        *[q(c) for c in indexed.columns], *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def cumulative(df: DataFrame, keys: list[str], order_cols: list[str], weights: dict[str, Column]) -> DataFrame:
    """Exclusive cumulative weights per key in the given order (``before_<name>``).

    The sort key starts with ``keys`` but the work is cut by range, so a key that holds
    most of the rows is spread over many tasks.
    """
    runs = range_runs(df, [*keys, *order_cols])
    offsets = run_offsets(runs, keys, {f"_o_{n}": w for n, w in weights.items()})
    local = W.partitionBy(*keys, PART).orderBy(LOCAL).rowsBetween(W.unboundedPreceding, -1)
    out = runs.select("*", *[F.coalesce(F.sum(w).over(local), F.lit(0)).alias(f"_l_{n}") for n, w in weights.items()])
    return out.join(F.broadcast(offsets), [*keys, PART]).select(
        *[q(c) for c in df.columns],
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(f"before_{n}") for n in weights])


def average_ranks(df: DataFrame, keys: list[str], value: str, extra: dict[str, Column] | None = None,
                  weight: Column | None = None) -> DataFrame:
    """One row per distinct (key, value): count ``n``, 1-based average rank, extra counts.

    Rows may already be counted; ``weight`` is then their count.
    """
    freq = df.groupBy(*keys, value).agg(
        F.sum(F.lit(1) if weight is None else weight).alias("n"), *[F.sum(e).alias(n) for n, e in (extra or {}).items()])
    ranked = cumulative(freq, keys, [value], {"n": F.col("n")})
    return ranked.withColumn("avg_rank", F.col("before_n") + (F.col("n") + 1) / 2.0).drop("before_n")


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], count: str = "n", hot_share: int = 2000,
           total: int | None = None) -> DataFrame:
    """Inner join of rows with a per-key lookup that knows its row count, safe for hot keys.

    A key that holds at least 1/hot_share of all rows is joined by broadcast (there are at most
    ``hot_share`` such keys); every other key is small enough for one shuffle task.
    """
    if total is None:
        total = lookup.agg(F.sum(count).alias("t")).first()["t"] or 0
    values = [c for c in lookup.columns if c not in keys and c != count]
    is_hot = F.col(count) * hot_share >= F.lit(total)
    hot = lookup.where(is_hot).select(*keys, *values, F.lit(True).alias("_hot"))
    cold = lookup.where(~is_hot).select(*keys, *values)
    tagged = rows.join(F.broadcast(hot), keys, "left")
    done = tagged.where(F.col("_hot").isNotNull()).drop("_hot")
    rest = tagged.where(F.col("_hot").isNull()).drop("_hot", *values).join(cold, keys)
    return done.unionByName(rest)


def attach_ranks(rows: DataFrame, ranks: DataFrame, keys: list[str], value: str, name: str, total: int | None = None) -> DataFrame:
    return attach(rows, ranks.select(*keys, value, "n", F.col("avg_rank").alias(name)), [*keys, value], total=total)


def _merged(spans: list[tuple]) -> list[tuple]:
    """Closed ranges in order, those that touch joined."""
    out: list[tuple] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _slot(c: Column, ranges: list[tuple]) -> Column:
    """2j + 1 inside the j-th range, 2j between the ranges before and after it."""
    opened = count_below(c, [a for a, _ in ranges], over=True)
    closed = count_below(c, [b for _, b in ranges])
    return opened + closed


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], slack: float = 0.0005) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of several columns, by one path at every size.

    One scan builds a mergeable sketch per column that brackets each quantile. Another scan counts
    what lies below the brackets and sorts only the values inside them, about 2 * slack of the rows.
    Columns without values give None.
    """
    data = df.select(*[finite(q(c)).alias(c) for c in wanted])
    columns, result = list(wanted), {c: [None] * len(ps) for c, ps in wanted.items()}
    counts = data.agg(*[F.count(q(c)).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    live = [k for k in range(len(columns)) if counts[f"n{k}"]]
    if not live:
        return result
    aggs = []
    for k in live:  # a bracket reaches two rows beyond its quantile at least
        wide = max(slack, 2.0 / counts[f"n{k}"])
        probes = [x for p in wanted[columns[k]] for x in (max(p - wide, 0.0), min(p + wide, 1.0))]
        v = q(columns[k])
        aggs.append(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile_approx(v, probes, 10000).alias("b")).alias(f"s{k}"))
    sketch = data.agg(*aggs).first()
    brackets = []  # column number, place in the request, probability, values, low, high
    for k in live:
        s, n = sketch[f"s{k}"], counts[f"n{k}"]
        wide = max(slack, 2.0 / n)
        for i, p in enumerate(wanted[columns[k]]):
            brackets.append((k, i, p, n, s["lo"] if p - wide <= 0 else s["b"][2 * i], s["hi"] if p + wide >= 1 else s["b"][2 * i + 1]))
    # a column's brackets merge into separate ranges; a value's slot is even outside them and odd inside
    ranges = {k: _merged([(low, high) for kk, _, _, _, low, high in brackets if kk == k]) for k in live}
    placed = F.array(*[F.struct(F.lit(k).alias("k"), _slot(q(columns[k]), ranges[k]).alias("slot"), q(columns[k]).alias("v")) for k in live])
    slots = data.select(F.explode(placed).alias("s")).where("s.v is not null").select("s.k", "s.slot", F.when(F.col("s.slot") % 2 == 1, F.col("s.v")).alias("v"))
    # one scan: a row a slot outside, a row a distinct value inside
    counted = materialize(slots.groupBy("k", "slot", "v").agg(F.count(F.lit(1)).alias("n")))
    outside: dict[int, dict[int, int]] = {}
    for r in counted.where("v is null").collect():  # at most one row a bracket and column
        outside.setdefault(r["k"], {})[r["slot"]] = r["n"]
    below = lambda k, low: sum(n for slot, n in outside.get(k, {}).items() if slot // 2 <= bisect_right([a for a, _ in ranges[k]], low) - 1)
    placed = cumulative(counted.where("v is not null").select("k", "v", "n"), ["k"], ["v"], {"n": F.col("n")})
    wants = []
    for k, _, p, n, low, _ in brackets:
        h, before = (n - 1) * p, -below(k, low)
        wants.append((k, int(h) + before, min(int(h) + 1, n - 1) + before))
    ranks = data.sparkSession.createDataFrame(sorted({(k, at) for k, *ats in wants for at in ats}), "k int, at long")  # two a probe
    near = placed.join(F.broadcast(ranks), "k").where((F.col("before_n") <= F.col("at")) & (F.col("at") < F.col("before_n") + F.col("n")))
    found = {(r["k"], r["at"]): r["v"] for r in near.select("k", "at", "v").collect()}
    for (k, i, p, n, _, _), (_, a, b) in zip(brackets, wants):
        h = (n - 1) * p
        result[columns[k]][i] = found[k, a] + (found[k, b] - found[k, a]) * (h - int(h))
    return result


def ranked_quantiles(placed: DataFrame, ps: list[float]) -> dict[int, list[float]]:
    """Exact linear-interpolation quantiles of every key from its ranked values (k, v, n, before_n): two places a probability are looked up."""
    sizes = {r["k"]: r["total"] for r in placed.groupBy("k").agg(F.sum("n").alias("total")).collect()}  # one row a column
    places = {k: [(int((n - 1) * p), min(int((n - 1) * p) + 1, n - 1)) for p in ps] for k, n in sizes.items()}
    ranks = placed.sparkSession.createDataFrame(sorted({(k, at) for k, ats in places.items() for two in ats for at in two}), "k int, at long")
    near = placed.join(F.broadcast(ranks), "k").where((F.col("before_n") <= F.col("at")) & (F.col("at") < F.col("before_n") + F.col("n")))
    found = {(r["k"], r["at"]): r["v"] for r in near.select("k", "at", "v").collect()}
    between = lambda k, a, b, h: found[k, a] + (found[k, b] - found[k, a]) * (h - int(h))
    return {k: [between(k, a, b, (n - 1) * p) for p, (a, b) in zip(ps, places[k])] for k, n in sizes.items()}


def ewma(rows: DataFrame, columns: dict[str, Column], span: int, index: str = "row_index",
         keys: list[str] | None = None, block: int = 1000) -> DataFrame:
    """Recursive exponential mean (no bias correction) of each expression, in ``index`` order per key.

    y_0 = x_0, y_i = (1-a) y_(i-1) + a x_i with a = 2 / (span + 1). Rows are cut into
    blocks of ``block``; inside a block the recursion is a weighted running sum, and the
    state enters from earlier blocks by an equi-join. State that has decayed below 1e-30
    is left out, hence no scan over all blocks. ``index`` must be contiguous from 0 per
    key and the expressions must not be null.
    """
    keys = keys or []
    alpha = 2.0 / (span + 1.0)
    keep = F.lit(1.0 - alpha)
    reach = max(1, int(-70.0 / (block * math.log(1.0 - alpha))) + 1)
    i = F.col(index)
    base = rows.select("*", F.floor(i / block).cast("long").alias("_b"), (i % block).cast("int").alias("_j"),
                       *[e.alias(f"_x_{n}") for n, e in columns.items()])
    w = W.partitionBy(*keys, "_b").orderBy("_j").rowsBetween(W.unboundedPreceding, 0)
    gain = F.when(i == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    local = base.select(
        *[q(c) for c in rows.columns], "_b", "_j",
        *[(F.pow(keep, F.col("_j")) * F.sum(gain * F.col(f"_x_{n}") * F.pow(keep, -F.col("_j"))).over(w)).alias(f"_y_{n}")
          for n in columns])
    ends = local.where(F.col("_j") == block - 1).select(*keys, "_b", *[F.col(f"_y_{n}").alias(f"_e_{n}") for n in columns])
    carried = ends.select(F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_k"), "*").select(
        *keys, (F.col("_b") + F.col("_k")).alias("_b"),
        *[(F.col(f"_e_{n}") * F.pow(keep, (F.col("_k") - 1) * block)).alias(f"_e_{n}") for n in columns],
    ).groupBy(*keys, "_b").agg(*[F.sum(f"_e_{n}").alias(f"_e_{n}") for n in columns])
    return local.join(carried, [*keys, "_b"], "left").select(
        *[q(c) for c in rows.columns],
        *[(F.col(f"_y_{n}") + F.coalesce(F.col(f"_e_{n}") * F.pow(keep, F.col("_j") + 1), F.lit(0.0))).alias(n) for n in columns])


def rolling_mean(indexed: DataFrame, columns: dict[str, str], rows: int = 20, block: int = 100_000) -> DataFrame:
    """Mean over the current and the previous ``rows - 1`` rows, per output name -> source column.

    The last ``rows - 1`` rows of each block are also sent to the next block, where they
    only feed the frame.
    """
    # a tail row appears a second time, in the next block, and is dropped after the window
    base = indexed.select(*[q(c) for c in indexed.columns], F.floor(F.col("row_index") / block).cast("long").alias("_b"))
    tail = (F.col("row_index") % block) >= block - (rows - 1)
    spread = base.select("*", F.explode(F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_up"))
    w = W.partitionBy("_t").orderBy("row_index").rowsBetween(-(rows - 1), 0)
    framed = spread.withColumn("_t", F.col("_b") + F.col("_up"))
    return framed.select("*", *[F.avg(finite(q(src))).over(w).alias(out) for out, src in columns.items()]).where(
        F.col("_up") == 0).drop("_up", "_t", "_b")


def share_below(queries: DataFrame, reference: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Share of the key's reference values strictly below each query value.

    One sorted union instead of a broadcast reference list, so neither side needs to be small.
    """
    both = queries.select(*[q(c) for c in queries.columns], F.lit(0).alias("_ref")).unionByName(
        reference.select(*[q(c) for c in keys], q(value), F.lit(1).alias("_ref")), allowMissingColumns=True)
    placed = cumulative(both, keys, [value, "_ref"], {"ref": F.col("_ref")})
    size = reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))  # one row per class
    joined = placed.where(F.col("_ref") == 0).join(size, keys, "left")
    return joined.select(*[q(c) for c in queries.columns], (F.col("before_ref") / F.col("_size")).alias(name))
