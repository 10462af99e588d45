"""Approximate nearest neighbours by cross-polytope hashing.

Largest inner product is nearest direction among vectors of like length: vectors are classed by length, a class
for each factor of sqrt 2 (length 1 in the middle of one), and a query looks into every class. In each class, whatever
its size, each of TABLES tables turns the directions by three rounds of random signs and a fast Hadamard transform and
assigns a vector to the nearest signed axis; a query looks into the PROBES cells of each table whose axes lie nearest
to it. Vectors found are ranked by exact inner products in double precision.

Equal vectors are hashed once: a distinct vector carries its k + 1 smallest ids, which is all that ties to
smaller ids can need. Cells are cut into blocks of at most BLOCK vectors and chunks of at most BLOCK queries,
so no task grows with a cell, and each block returns k candidates a query. A query that has found fewer than
k looks into all cells of the first table, that is at every vector. Classes are few (a
double has about 4,200), so their counts are broadcast.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
with null vec_id; of several rows with one vec_id the least vector counts; only vectors of the query's
dimension are candidates; extra columns are dropped; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linelens.llm.common import table
from linelens.session import materialize

NAME = "op1_nearest_neighbours"
K = 20
TABLES = 12
PROBES = 24
BLOCK = 2048
SEED = 20240601


def rotations(dim: int, tables: int, seed: int = SEED):
    """Signs of each table's three rounds, for the next power of two that holds the dimension and one more."""
    import numpy as np

    size = 1
    while size < dim + 1:
        size *= 2
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(tables, 3, size))


def hadamard(x):
    """Fast Walsh-Hadamard transform of each row, in place on a copy, scaled to keep lengths."""
    import numpy as np

    x, h, size = x.copy(), 1, x.shape[1]
    while h < size:
        y = x.reshape(len(x), size // (2 * h), 2, h)
        a, b = y[:, :, 0, :] + y[:, :, 1, :], y[:, :, 0, :] - y[:, :, 1, :]
        y[:, :, 0, :], y[:, :, 1, :] = a, b
        h *= 2
    return x / np.sqrt(size)


def rotated(vectors, signs):
    for s in signs:
        vectors = hadamard(vectors * s)
    return vectors


def cells_of(vectors, tables: int, probes: int):
    """Per row and table the ``probes`` nearest signed axes, nearest first: shape (rows, tables, probes); -1 fills what there is not."""
    import numpy as np

    signs = rotations(vectors.shape[1], tables)
    full = np.zeros((len(vectors), signs.shape[2]))
    full[:, : vectors.shape[1]] = vectors
    out = np.full((len(vectors), tables, probes), -1, dtype=np.int32)
    n = min(probes, 2 * full.shape[1])
    for t in range(tables):
        turned = rotated(full, signs[t])
        both = np.concatenate([turned, -turned], axis=1)
        out[:, t, :n] = np.argmax(both, axis=1)[:, None] if probes == 1 else np.argsort(-both, axis=1, kind="stable")[:, :n]
    return out


def _matrix(column) -> "np.ndarray":  # noqa: F821
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def length_class(v: Column) -> Column:
    """2 log2 of a vector's length, rounded; scaled by the largest component, so no square over- or underflows."""
    most = F.array_max(F.transform(v, F.abs))
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))
    return F.floor(2 * F.log2(most) + F.log2(squares) + 0.5).cast("int")


def _hash(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """Adds ``cells``: tables x probes cell numbers of the vectors' directions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            lengths = np.asarray(b.column("dim").to_pylist())
            for dim in np.unique(lengths):
                part = b.filter(pa.array(lengths == dim))
                x = _matrix(part.column("v"))
                x = x / np.abs(x).max(1, keepdims=True)
                cells = cells_of(x / np.sqrt((x * x).sum(1, keepdims=True)), tables, probes).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(cells), pa.list_(pa.int32()))], schema=pa.schema([*part.schema, ("cells", pa.list_(pa.int32()))]))

    kinds = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)
    return vectors.mapInArrow(add, f"{kinds}, cells array<int>")


def _block_best(k: int):
    """For one block of a cell: the k best vectors of each query in its chunk, packed in one row a query."""

    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        import numpy as np

        kind = pa.schema([("q", pa.int64()), ("found", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
        if not queries.num_rows or not vectors.num_rows:
            return kind.empty_table()
        q, x = (_matrix(t.column("v").combine_chunks()) for t in (queries, vectors))
        ids = vectors.column("rep").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        s = q @ x.T
        n = min(k, len(ids))
        top = np.argsort(-s, axis=1, kind="stable")[:, :n] if n == len(ids) else _top(s, n)
        return pa.Table.from_arrays([queries.column("q"), pa.array(list(ids[top]), pa.list_(pa.int64())), pa.array(list(np.take_along_axis(s, top, 1)), pa.list_(pa.float64()))], schema=kind)

    return best


def _top(s, n: int):
    """Columns of the n largest of each row, ties to the left, largest first."""
    import numpy as np

    edge = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
    out = np.empty((len(s), n), dtype=np.int64)
    for i, row in enumerate(s):
        c = np.flatnonzero(row >= edge[i, 0])
        out[i] = c[np.argsort(-row[c], kind="stable")][:n]
    return out


def _candidates(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """q, rep, score for the k best vectors of every block that a query looks into."""
    on = ["dim", "t", "length", "cell"]
    sizes = index.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    chunks = probes.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    plan = materialize(sizes.join(chunks, on))
    left = probes.join(plan, on).select(*on, "q", "v", F.pmod(F.hash("q"), F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = index.join(plan, on).select(*on, "rep", "v", F.pmod(F.hash("rep"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    key = [*on, "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block_best(k), "q long, found array<long>, scores array<double>")
    return found


def nearest(embeddings: DataFrame, is_query: Column, k: int = K, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for every query row."""
    v = F.col("embedding").cast("array<double>")
    usable = F.size("v") > 0
    fine = usable & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine)
    rows = materialize(rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("content", F.md5(F.to_json("v"))))
    # distinct vectors and their k + 1 smallest ids; row limits apply before the shuffle, so no group is gathered whole
    firsts = rows.select("content", "vec_id", F.row_number().over(Window.partitionBy("content").orderBy("vec_id")).alias("n")).where(F.col("n") <= k + 1)
    members = materialize(firsts.groupBy("content").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    distinct = rows.join(members.select(F.col("rep").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("rep"), F.size("v").alias("dim"), "v")
    hashed = materialize(_hash(distinct.withColumn("length", length_class(F.col("v"))), tables, 1))
    place = lambda t, length, cell: F.struct(t.cast("int").alias("t"), length.cast("int").alias("length"), cell.cast("int").alias("cell"))
    places = F.transform("cells", lambda c, t: place(t, F.col("length"), c))
    index = hashed.select("rep", "dim", "v", F.explode(places).alias("p")).select("rep", "dim", "v", "p.*")
    queries = materialize(_hash(rows.where(is_query).select(F.col("vec_id").alias("q"), F.size("v").alias("dim"), "v"), tables, probes))
    classes = hashed.groupBy("dim").agg(F.collect_set("length").alias("lengths"))
    near = F.flatten(F.transform("lengths", lambda n: F.transform("cells", lambda c, i: place(F.floor(i / probes), n, c))))
    asked = queries.join(F.broadcast(classes), "dim").select("q", "dim", "v", F.explode(near).alias("p")).select("q", "dim", "v", "p.*")
    found = materialize(_candidates(index, asked, k + 1))
    # queries that met fewer than k other rows: every cell of table 0 and of the small classes
    listed = found.select("q", F.explode("found").alias("rep")).distinct().join(members, "rep")
    known = listed.groupBy("q").agg(F.sum(F.size(F.filter("ids", lambda i: i != F.col("q")))).alias("n"))
    few = queries.select("q", "dim", "v").join(known.where(F.col("n") >= k), "q", "left_anti")
    once = index.where(F.col("t") == 0)
    cells = materialize(once.select("dim", "t", "length", "cell").distinct())
    every = materialize(few.join(cells, "dim").select("q", "dim", "v", "t", "length", "cell"))
    found = found.unionByName(_candidates(once, every, k + 1))
    pairs = found.select("q", F.explode(F.arrays_zip("found", "scores")).alias("x")).groupBy("q", F.col("x.found").alias("rep")).agg(F.max("x.scores").alias("score"))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = pairs.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    spread = best.join(members.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("q"))
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours of every row whose vec_id is divisible by 20, among all other rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = None
