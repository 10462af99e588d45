"""Mutual information by nearest neighbours, on all rows, without comparing all pairs.

Rows collapse to distinct weighted points, so a value that a third of the rows hold is one coordinate. Points are cut
into strips by x and cells by y, both of even size; in a cell, leaves of a few points stand in for a tree, and a point is
compared with those its radius reaches. A point whose radius stays in its cell is done; the others, near a border, visit
the cells that can hold a nearer point. Rows inside the radius along one axis are
counted by cumulative sums, of a list of values where an axis has few, among the neighbours in sorted runs otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelens.functions.expr import at_least, finite, q, rounded
from linelens.operators.ordered import cumulative
from linelens.operators.split import seeded_key, with_previous
from linelens.session import materialize

NEIGHBOURS = 3
CELL = 4000
LEAF = 32
FEW_VALUES = 4096
_SLICE = 512


def digamma(n: Column) -> Column:
    """Digamma of a positive number: six steps of the recurrence, then the asymptotic series (error below 1e-9)."""
    z = n + F.lit(6.0)
    low = reduce(lambda a, b: a + b, [F.lit(1.0) / (n + F.lit(float(j))) for j in range(6)])
    s = F.lit(1.0) / (z * z)
    tail = s * (F.lit(1 / 12) - s * (F.lit(1 / 120) - s * (F.lit(1 / 252) - s * F.lit(1 / 240))))
    return F.ln(z) - F.lit(0.5) / z - tail - low


class _Leaves:
    """Points of a cell in leaves of a few neighbours, each with its box."""

    def __init__(self, x, y, w):
        n = len(x)
        strips = max(1, int(np.sqrt(n / LEAF)))
        per = -(-n // (strips * LEAF)) * LEAF
        strip = np.empty(n, dtype=np.int64)
        strip[np.lexsort((y, x))] = np.arange(n) // per
        order = np.lexsort((x, y, strip))
        filled = lambda v, empty: np.concatenate([v[order], np.full(-n % LEAF, empty, dtype=v.dtype)]).reshape(-1, LEAF)
        self.x, self.y, self.w = filled(x, np.inf), filled(y, np.inf), filled(w, 0)
        self.of = np.empty(n, dtype=np.int64)
        self.of[order] = np.arange(n) // LEAF
        top = lambda v: np.where(np.isinf(v), -np.inf, v).max(axis=1)
        self.box = self.x.min(axis=1), top(self.x), self.y.min(axis=1), top(self.y)

    def distances(self, x, y, leaf, k: int):
        """Distances (max-norm) and weights of the k + 1 nearest points of a leaf to each (x, y), in no order."""
        d = np.maximum(np.abs(x[:, None] - self.x[leaf]), np.abs(y[:, None] - self.y[leaf]))
        at = np.argpartition(d, min(k, LEAF - 1), axis=1)[:, :k + 1]
        return np.take_along_axis(d, at, axis=1), np.take_along_axis(self.w[leaf], at, axis=1)

    def nearest(self, x, y, r, k: int):
        """Distances and weights of the k + 1 nearest points up to r from each (x, y), in order; infinity and 0 where there are fewer."""
        ds, ws = np.full((len(x), k + 1), np.inf), np.zeros((len(x), k + 1), dtype=np.int64)
        x0, x1, y0, y1 = self.box
        for a in range(0, len(x), _SLICE):
            part = slice(a, a + _SLICE)
            qx, qy, qr = x[part], y[part], r[part]
            of, leaf = np.nonzero((x0 <= (qx + qr)[:, None]) & (x1 >= (qx - qr)[:, None]) & (y0 <= (qy + qr)[:, None]) & (y1 >= (qy - qr)[:, None]))
            d, w = self.distances(qx[of], qy[of], leaf, k)
            of, d, w = np.repeat(of, d.shape[1]), d.ravel(), w.ravel()
            inside = (d <= qr[of]) & (w > 0)
            of, d, w = of[inside], d[inside], w[inside]
            order = np.lexsort((d, of))
            of, d, w = of[order], d[order], w[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            first = place <= k
            ds[a + of[first], place[first]] = d[first]
            ws[a + of[first], place[first]] = w[first]
        return ds, ws


def _kth(ds, ws, k: int):
    """Distance at which k rows besides the row itself are reached. The row is no neighbour; its copies are, at distance 0."""
    enough = np.cumsum(ws, axis=1) - 1 >= k
    return np.where(enough.any(axis=1), ds[np.arange(len(ds)), enough.argmax(axis=1)], np.inf)


def _in_cell(k: int, walls: dict):
    """Radius of every point among its cell's points; where that reaches beyond the cell, also the nearest so far and the strips to visit."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (cell[c].to_numpy() for c in ("x", "y", "w"))
        ask = np.flatnonzero(w <= k)  # the others have k copies
        r = np.zeros(len(x))
        ds, ws, strips = (np.full(len(x), None, dtype=object) for _ in range(3))
        if len(ask):
            leaves = _Leaves(x, y, w)
            qx, qy = x[ask], y[ask]
            d, u = leaves.distances(qx, qy, leaves.of[ask], k)
            order = np.argsort(d, axis=1, kind="stable")
            bound = _kth(np.take_along_axis(d, order, axis=1), np.take_along_axis(u, order, axis=1), k)
            near, rows = leaves.nearest(qx, qy, bound, k)
            qr = _kth(near, rows, k)
            r[ask] = qr
            own, sx0, sx1, sy0, sy1 = walls[int(cell["g"].iloc[0])]
            meets = (sx0 < (qx + qr)[:, None]) & (sx1 > (qx - qr)[:, None]) & (sy0 < (qy + qr)[:, None]) & (sy1 > (qy - qr)[:, None])
            # the other cells of the own strip lie below and above this one
            meets[:, own == int(cell["strip"].iloc[0])] = ((qy - qr < y.min()) | (qy + qr > y.max()))[:, None]
            for i in np.flatnonzero(meets.any(axis=1)):
                some = rows[i] > 0
                ds[ask[i]], ws[ask[i]], strips[ask[i]] = near[i][some], rows[i][some], own[meets[i]]
        return pd.DataFrame({"id": cell["id"], "g": cell["g"], "strip": cell["strip"], "cell": cell["cell"], "x": x, "y": y, "w": w, "r": r, "ds": ds, "ws": ws, "strips": strips})

    return run


def _visit(k: int):
    def run(visits: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        if not len(visits) or not len(cell):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "ds": pd.Series(dtype=object), "ws": pd.Series(dtype=object)})
        near, rows = _Leaves(*(cell[c].to_numpy() for c in ("x", "y", "w"))).nearest(*(visits[c].to_numpy() for c in ("x", "y", "r")), k)
        some = rows > 0
        hit = np.flatnonzero(some.any(axis=1))
        return pd.DataFrame({"id": visits["id"].to_numpy()[hit], "ds": pd.Series([near[i][some[i]] for i in hit], dtype=object), "ws": pd.Series([rows[i][some[i]] for i in hit], dtype=object)})

    return run


def _with_strip(borders: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            strip = np.zeros(len(b), dtype=np.int32)
            for g in b["g"].unique():
                at = np.flatnonzero(b["g"] == g)
                strip[at] = np.searchsorted(borders[g], b["x"].to_numpy()[at], side="right") - 1
            yield b.assign(strip=strip)

    return run


def _cells(points: DataFrame, size: int) -> DataFrame:
    """Strips along x and, in each, cells of even size along y: ``size`` to twice as many points a cell.

    A value of x is in one strip, however many points have it, so strips of a column of few values do not touch.
    """
    groups = points.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))  # two rows a factor
    strips = at_least(F.floor(F.sqrt(F.col("_n") / size)), 1)
    values = points.groupBy("g", "x").agg(F.count(F.lit(1)).alias("p"))
    placed = cumulative(values, ["g"], ["x"], {"p": F.col("p")}).join(F.broadcast(groups), "g").withColumn(
        "strip", F.floor(F.col("before_p") * strips / F.col("_n")).cast("int"))
    # one row a strip, of which there are as many as the square root of the points
    borders: dict = {}
    for g, x in placed.groupBy("g", "strip").agg(F.min("x").alias("x")).select("g", "x").orderBy("g", "x").collect():
        borders.setdefault(g, []).append(x)
    # written before it is dealt by range, which reads its input twice
    rows = materialize(points.mapInPandas(_with_strip({g: np.array(x) for g, x in borders.items()}), "g int, x double, y double, w long, id long, strip int"))
    runs = cumulative(rows, ["g", "strip"], ["y", "x"], {"p": F.lit(1)})
    of = runs.groupBy("g", "strip").agg(F.count(F.lit(1)).alias("_n"))
    cells = at_least(F.floor(F.col("_n") / size), 1)
    return materialize(runs.join(F.broadcast(of), ["g", "strip"]).withColumn(
        "cell", F.floor(F.col("before_p") * cells / F.col("_n")).cast("int")).drop("before_p", "_n"))


def _radii(cells: DataFrame, k: int) -> DataFrame:
    """(id, g, x, y, w, r, kp): distance of the k-th nearest other row, and the rows that reach it (copies where r is 0)."""
    key = ["g", "strip", "cell"]
    boxes = cells.groupBy(*key).agg(*[f(c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, 0), (F.max, 1))])
    shelves = boxes.groupBy("g", "strip").agg(*[f(c + n).alias(f"s{c}{n}") for c in "xy" for f, n in ((F.min, "0"), (F.max, "1"))],
                                              F.collect_list(F.struct("cell", "x0", "x1", "y0", "y1")).alias("cells"))
    shelves = materialize(shelves)
    # one row a strip, of which there are as many as the square root of the cells
    walls: dict = {}
    for s in shelves.select("g", "strip", "sx0", "sx1", "sy0", "sy1").collect():
        walls.setdefault(s["g"], []).append(s[1:])
    walls = {g: (np.array([s[0] for s in rows]), *(np.array([s[j] for s in rows]) for j in range(1, 5))) for g, rows in walls.items()}
    local = materialize(cells.groupBy(*key).applyInPandas(
        _in_cell(k, walls), "id long, g int, strip int, cell int, x double, y double, w long, r double, ds array<double>, ws array<long>, strips array<int>"))
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    # only cells that can hold a point nearer than r
    border = local.where("strips IS NOT NULL")
    touched = border.select("id", "g", "x", "y", "r", F.col("strip").alias("_s"), F.col("cell").alias("_c"), F.explode("strips").alias("strip"))
    visits = touched.join(shelves.select("g", "strip", "cells"), ["g", "strip"]).select(
        "id", "g", "x", "y", "r", "strip", F.explode(F.filter("cells", lambda b: (b["x0"] < x + r) & (b["x1"] > x - r) & (b["y0"] < y + r) & (b["y1"] > y - r)
                                                              & ~((F.col("strip") == F.col("_s")) & (b["cell"] == F.col("_c"))))["cell"]).alias("cell"))
    found = visits.groupBy(*key).cogroup(cells.groupBy(*key)).applyInPandas(_visit(k), "id long, ds array<double>, ws array<long>")
    near = F.flatten(F.collect_list(F.arrays_zip("ds", "ws")))
    best = border.select("id", "ds", "ws").unionByName(found).groupBy("id").agg(F.sort_array(near).alias("near"))
    start = F.struct(F.lit(-1).cast("long").alias("seen"), F.lit(None).cast("double").alias("r"))
    reach = F.aggregate("near", start, lambda s, e: F.struct(
        (s["seen"] + e["ws"]).alias("seen"), F.when(s["r"].isNull() & (s["seen"] + e["ws"] >= k), e["ds"]).otherwise(s["r"]).alias("r")))["r"]
    done = border.select("id", "g", "x", "y", "w").join(best.select("id", reach.alias("r")), "id")
    return local.where("strips IS NULL").select("id", "g", "x", "y", "w", "r").unionByName(done).withColumn(
        "kp", F.when(F.col("r") == 0, F.col("w")).otherwise(F.lit(k)))


def _counted(few: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, c in enumerate("xy"):
                n, known = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=bool)
                for g in b["g"].unique():
                    if (g, i) in few:
                        values, sums = few[g, i]
                        at = np.flatnonzero(b["g"] == g)
                        v, r = b[c].to_numpy()[at], b["r"].to_numpy()[at]
                        edge = _edge(v, r)
                        n[at] = sums[np.searchsorted(values, v + edge, side="right")] - sums[np.searchsorted(values, v - edge, side="left")]
                        known[at] = True
                b[f"n{c}"] = pd.array(n, dtype="Int64")
                b.loc[~known, f"n{c}"] = pd.NA
            yield b

    return run


def _in_runs(piece_rows: int):
    """Counts along an axis for the points whose reach stays inside a piece of a sorted run; null for the others."""

    def pieces(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= piece_rows:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if n:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            key, v, w, r = (b["g"] * 2 + b["axis"]).to_numpy(), *(b[c].to_numpy() for c in ("v", "w", "r"))
            edge = _edge(v, r)
            low, high = v - edge, v + edge
            n, known = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=bool)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(b)]
            for at in map(slice, cuts[:-1], cuts[1:]):
                of = v[at]
                sums = np.concatenate([[0], np.cumsum(w[at])])
                n[at] = sums[np.searchsorted(of, high[at], side="right")] - sums[np.searchsorted(of, low[at], side="left")]
                known[at] = (low[at] > of[0]) & (high[at] < of[-1])  # equal values may lie beyond the ends
            yield b.assign(n=pd.arrays.IntegerArray(n, ~known))

    return run


def _edge(v, r):
    """The k-th neighbour lies on the border itself, and is not inside: rounding must not let it in."""
    return np.maximum(r - 1e-12 * (np.abs(v) + r), 0.0)


def _within(radii: DataFrame, few_values: int = FEW_VALUES, piece_rows: int = 1 << 18) -> DataFrame:
    """(g, w, n), a row for each axis of a point: rows nearer than r along it, the row itself included; equal ones where r is 0.

    An axis of at most ``few_values`` values is a list in every task. The others are sorted, and a point is counted among
    its neighbours in the sorted run; one whose reach leaves the piece of the run asks in a second sorted pass.
    """
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(c).alias("v")) for i, c in enumerate("xy")])).alias("a")
    weights = materialize(radii.select("g", "w", axes).groupBy("g", "a.axis", "a.v").agg(F.sum("w").alias("w")))
    short = weights.groupBy("g", "axis").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= few_values)
    few: dict = {}
    for g, axis, v, w in weights.join(F.broadcast(short), ["g", "axis"]).select("g", "axis", "v", "w").collect():  # few_values rows a factor, side and axis at most
        few.setdefault((g, axis), []).append((v, w))
    few = {key: (np.array([v for v, _ in sorted(rows)]), np.cumsum([0] + [w for _, w in sorted(rows)])) for key, rows in few.items()}
    counted = materialize(radii.select("id", "g", "x", "y", "w", "r").mapInPandas(_counted(few), "id long, g int, x double, y double, w long, r double, nx long, ny long"))
    listed = counted.select("g", "w", F.explode(F.array("nx", "ny")).alias("n")).where("n IS NOT NULL")
    open_axes = F.explode(F.filter(F.array(*[F.when(F.col(f"n{c}").isNull(), F.struct(F.lit(i).alias("axis"), F.col(c).alias("v"))) for i, c in enumerate("xy")]), lambda a: a.isNotNull())).alias("a")
    rest = counted.where("nx IS NULL OR ny IS NULL").select("id", "g", "w", "r", open_axes).select("id", "g", "a.axis", "a.v", "w", "r")
    order = ["g", "axis", "v"]
    runs = materialize(rest.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _in_runs(piece_rows), "id long, g int, axis int, v double, w long, r double, n long"))
    values = weights.join(F.broadcast(short), ["g", "axis"], "left_anti").select(
        "g", "axis", "v", F.lit(1).alias("turn"), "w", F.lit(None).cast("long").alias("id"), F.lit(0).alias("sign"), F.lit(None).cast("long").alias("rows"))
    edge = at_least(F.col("r") - F.lit(1e-12) * (F.abs("v") + F.col("r")), 0.0)  # as above
    probe = F.explode(F.array(F.struct((F.col("v") - edge).alias("v"), F.lit(0).alias("turn"), F.lit(-1).alias("sign")),
                              F.struct((F.col("v") + edge).alias("v"), F.lit(2).alias("turn"), F.lit(1).alias("sign")))).alias("p")
    probes = runs.where("n IS NULL").select("g", "axis", "id", F.col("w").alias("rows"), probe).select(
        "g", "axis", "p.v", "p.turn", F.lit(0).cast("long").alias("w"), "id", "p.sign", "rows")
    below = cumulative(values.unionByName(probes), ["g", "axis"], ["v", "turn"], {"w": F.col("w")}).where("id IS NOT NULL")
    asked = below.groupBy("g", "axis", "id").agg(F.first("rows").alias("w"), F.sum(F.col("before_w") * F.col("sign")).alias("n"))
    return listed.unionByName(runs.where("n IS NOT NULL").select("g", "w", "n")).unionByName(asked.select("g", "w", "n"))


def neighbour_information(df: DataFrame, y: str, factors: list[str], row_key: str, k: int = NEIGHBOURS, seed: int = 42, cell: int = CELL) -> DataFrame:
    """(factor, n, mi, mi_baseline) in nats: nearest-neighbour estimate over the rows where both values are present.

    Both axes are scaled by their column's deviation. Per row: digamma(k) + digamma(n) - digamma(nx) - digamma(ny), where
    nx and ny count the rows inside the distance to its k-th nearest other row; a row with k copies counts its copies
    and equals instead (the estimate for mixtures of discrete and continuous values). The baseline gives each row the
    target of another row, the neighbour in seeded random order. Negative estimates are 0. Under 30 rows, or where a
    side does not vary, both are null.
    """
    columns = [y, *factors]
    facts = df.agg(*[F.stddev_pop(finite(q(c))).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    varies = lambda i: bool(facts[f"s{i}"])
    live = [i for i in range(1, len(columns)) if varies(i) and varies(0)]
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)][1:], "i int, factor string")
    if not live:
        return names.select("factor", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mi"), F.lit(None).cast("double").alias("mi_baseline"))
    scaled = [(finite(q(columns[i])) / F.lit(facts[f"s{i}"])).alias(f"v{i}") for i in [0, *live]]
    paired = with_previous(df.select(*scaled, seeded_key(seed, q(row_key)).alias("_h")), ["_h"], ["v0"])
    sides = [F.struct(F.lit(2 * i + side).alias("g"), F.col(f"v{i}").alias("x"), F.col(c).alias("y")) for i in live for side, c in ((0, "v0"), (1, "_prev_v0"))]
    # zero has one sign, so that equal values are one point
    points = paired.select(F.explode(F.array(*sides)).alias("p")).select("p.g", (F.col("p.x") + 0.0).alias("x"), (F.col("p.y") + 0.0).alias("y")).where(
        "x IS NOT NULL AND y IS NOT NULL").groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    points = materialize(points.withColumn("id", F.monotonically_increasing_id()))
    sizes = points.groupBy("g").agg(F.sum("w").alias("n"))
    enough = points.join(F.broadcast(sizes.where("n >= 30").select("g")), "g", "left_semi")
    radii = materialize(_radii(_cells(enough, cell), k))
    # a sum over the points and one over their axes, which therefore need not meet again
    counts = radii.select("g", "w", F.col("kp").alias("n"), F.lit(1).alias("sign")).unionByName(_within(radii).select("g", "w", "n", F.lit(-1).alias("sign")))
    terms = counts.groupBy("g").agg(F.sum(F.col("sign") * F.col("w") * digamma(F.col("n"))).alias("t"))
    per = sizes.join(terms, "g", "left").withColumn("mi", F.when(F.col("t").isNotNull(), at_least(F.col("t") / F.col("n") + digamma(F.col("n")), 0.0)))
    side = lambda c, s: F.max(F.when(F.col("g") % 2 == s, F.col(c)))
    wide = per.groupBy(F.floor(F.col("g") / 2).cast("int").alias("i")).agg(side("n", 0).alias("n"), side("mi", 0).alias("mi"), side("mi", 1).alias("base"))
    return names.join(wide, "i", "left").select("factor", F.coalesce("n", F.lit(0)).alias("n"), rounded(F.col("mi")).alias("mi"), rounded(F.col("base")).alias("mi_baseline"))
