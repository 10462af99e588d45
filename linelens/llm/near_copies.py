"""Near-duplicate detection by BagMinHash signatures, banding, and exact multiset overlap.

A document is the multiset of its five-word shingles (lower case, words split at white space; a shorter text
is one shingle). Its signature has one component per hash: every shingle with weight w owns a Poisson process
over the weights (0, w], cut into the dyadic levels (0, 1], (1, 2], (2, 4], ...; a level's process has the
rate of its length, each of its points falls on one unit of weight inside the level (points above w are
thinned out) and on one component, and a component keeps the earliest point of all shingles. Two components
are equal with the probability of the weighted Jaccard similarity. Points are drawn in time order and only up
to the time by which all components have one, so long documents need less than one point per shingle.

Documents with equal words are one node. Signatures are cut into BANDS bands of ROWS components; nodes equal
in a band meet. Nothing is paired inside a bucket: its smallest node is its star, every node joins the stars
of its buckets once, and a star's nodes are compared in chunks of at most CHUNK, exactly, by one product of
their shingle-occurrence matrix; a chunk returns a spanning forest of its links of similarity THRESHOLD or
more. Stars with several chunks whose nodes are still of different classes are compared chunk by chunk, across
classes only. So all nodes that share a bucket are compared unless they are already in one class, whatever
the bucket's size, and links grow with the nodes, not with their pairs. Classes come from alternating star
contraction of the links on the executors.

At 30 bands of 6, two documents of similarity 0.8 meet in a band with probability 0.9999.

Defined cases: null text is empty; documents without words form one class; doc_id may be null or repeated:
each row has its class, whose id is the smallest doc_id in it (null if it has none); extra columns are
dropped; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.llm.common import as_row, bounded_batches, from_row, table
from linelens.llm.components import components
from linelens.session import materialize

NAME = "op8_near_copies"
SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 6
CHUNK = 256

_GOLDEN = 0x9E3779B97F4A7C15


def mix64(x):
    """A bijection on unsigned 64-bit integers that spreads every bit (array in, array out)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[str], known: dict[str, int], n: int = SHINGLE):
    """64-bit hashes of all shingles in order; one for a text shorter than a shingle, none without words."""
    import numpy as np

    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = mix64(h * np.uint64(_GOLDEN) + w[k : len(w) - n + 1 + k])
    return h


def signatures(hashes, weights, starts, m: int):
    """BagMinHash signatures: ``starts`` are the borders of documents in the element arrays; float64 (docs, m)."""
    import numpy as np

    docs = len(starts) - 1
    sig = np.full((docs, m), np.inf)
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(docs), sizes)
    total = np.bincount(doc, weights=weights, minlength=docs)
    horizon = np.where(total > 0, m * (math.log(m) + 4) / np.maximum(total, 1), 0.0)
    open_ = total > 0
    while open_.any():
        chosen = open_[doc]
        _draw(hashes[chosen], weights[chosen], doc[chosen], horizon, sig, m)
        open_ &= np.isinf(sig).any(axis=1)
        horizon = horizon * 2
    return sig


def _draw(hashes, weights, doc, horizon, sig, m: int) -> None:
    """All points of the elements before their documents' horizons, level by level, into ``sig``."""
    import numpy as np

    flat = sig.reshape(-1)
    level = 0
    while len(hashes):
        low, length = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        seed = mix64(hashes + np.uint64((level + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        w, d, until = weights, doc, horizon[doc]
        time, n = np.zeros(len(seed)), 0
        while len(seed):
            n += 1
            r = mix64(seed + np.uint64(n * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
            keep = time <= until
            if not keep.all():
                seed, w, d, until, time, r = seed[keep], w[keep], d[keep], until[keep], time[keep], r[keep]
            place = mix64(r + np.uint64(0xA0761D6478BD642F))
            component = ((place >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            if level < 2:
                np.minimum.at(flat, d * m + component, time)
            else:  # the unit of weight the point falls on; above the element's weight it is thinned out
                inside = low + (place & np.uint64(0xFFFFFFFF)) % np.uint64(length) < w
                np.minimum.at(flat, d[inside] * m + component[inside], time[inside])
        level += 1
        more = weights > (1 << (level - 1))
        hashes, weights, doc = hashes[more], weights[more], doc[more]


def band_hashes(sig, bands: int, rows: int):
    """One 64-bit hash per band of a signature; times are rounded to 32 bits first."""
    import numpy as np

    values = sig.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for k in range(rows):
        h = mix64(h * np.uint64(_GOLDEN) + values[:, :, k])
    return h.view(np.int64)


NODE = "key binary, n long, bands array<long>"


def _nodes(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        known = _Words()
        for b in (b for b in batches if b.num_rows):
            keys, sizes, parts, counts = [], [], [], []
            for text in b.column("text"):
                words = (text.as_py() or "").lower().split()
                keys.append(xxhash.xxh3_128_digest(" ".join(words)))
                values, weight = np.unique(shingles(words, known), return_counts=True)
                sizes.append(int(weight.sum()))
                parts.append(values)
                counts.append(weight)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            sig = signatures(np.concatenate(parts), np.concatenate(counts), starts, bands * rows)
            hashed = [list(h) if n else [] for h, n in zip(band_hashes(sig, bands, rows), sizes)]
            out = [b.column("doc_id"), b.column("th"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "th", "key", "n", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle occurrences of each text: the k-th occurrence of a shingle is an element of its own."""
    import numpy as np

    known = _Words()
    for b in batches:
        out = []
        for text in b.column("text"):
            values, counts = np.unique(shingles((text.as_py() or "").lower().split(), known), return_counts=True)
            nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            out.append(mix64(np.repeat(values, counts) + nth.astype(np.uint64) * np.uint64(_GOLDEN)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.binary())], ["key", "elements"])


def similarities(sets: list):
    """Exact Jaccard similarities between all element sets: the product of their incidence matrix."""
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1 if len(values) else first
    column, owner = column[shared], owner[shared]
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = 8192
    for low in range(0, int(column.max()) + 1 if len(column) else 0, width):
        inside = slice(*np.searchsorted(column, [low, low + width]))
        a = np.zeros((len(sets), width), dtype=np.float32)
        a[owner[inside], column[inside] - low] = 1
        common += a @ a.T
    return common / np.maximum(1, sizes[:, None] + sizes[None, :] - common)


def _forest(keys: list[bytes], links, parent: list[int]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links (pairs of places), given what is joined already."""

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in links:
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((keys[i], keys[j]))
    return out


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _compare(threshold: float, across: bool):
    """Links inside one chunk of a star, or between its two halves and across classes only."""

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        keys = group.column("key").to_pylist()
        sim = similarities([np.frombuffer(x, dtype=np.uint64) for x in group.column("elements").to_pylist()])
        good = np.triu(sim >= threshold - 1e-12, 1)
        if across:
            half, label = np.array(group.column("half").to_pylist()), np.array(group.column("root").to_pylist())
            good &= (half[:, None] != half[None, :]) & (label[:, None] != label[None, :])
        edges = _forest(keys, np.argwhere(good), list(range(len(keys))))
        return pa.Table.from_pylist([{"a": x, "b": y} for x, y in edges], _EDGE)

    return run


def _with_root(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))


def _text_hash(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th (MD5 of the text), class_id, kept_th, kept_id: every row's class and the document that stands for it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(text).alias("th"), text.alias("text"))
    hashed = materialize(d.mapInArrow(_nodes(bands, rows), f"doc_id long, th binary, {NODE}"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))
    nodes = materialize(hashed.groupBy("key").agg(F.min(first).alias("rep"), F.max("n").alias("n"), F.max("bands").alias("bands")))

    # stars: each bucket's smallest node; every node joins the stars of its buckets once
    entries = materialize(nodes.select("key", F.explode("bands").alias("bucket")))
    buckets = entries.groupBy("bucket").agg(F.min("key").alias("star"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "star")
    stars = materialize(entries.join(buckets, "bucket").select("star", "key").distinct())

    # exact sets of the nodes that have met another
    wanted = stars.select("key").distinct().join(nodes.select("key", "rep"), "key").select("key", F.col("rep.th").alias("th"), F.col("rep.doc_id").alias("rep_id"))
    texts = d.join(wanted.withColumnRenamed("th", "rep_th"), (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("key", "text")
    sets = materialize(texts.mapInArrow(_sets, "key binary, elements binary").dropDuplicates(["key"]))

    sizes = stars.groupBy("star").agg(F.count(F.lit(1)).alias("n")).select("star", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    placed = materialize(stars.join(sizes, "star").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")))
    inside = placed.select("star", "chunk", "key")
    heads = placed.where("key = star").select("star", "key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    inside = inside.unionByName(heads.select("star", "chunk", "key")).distinct()
    edges = materialize(inside.join(sets, "key").groupBy("star", "chunk").applyInArrow(_compare(threshold, False), "a binary, b binary"))
    found = materialize(components(edges))

    # stars of several chunks that are still of several classes: chunk by chunk
    large = _with_root(placed.where("chunks > 1"), found)
    mixed = large.groupBy("star").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("star")
    rest = materialize(large.join(mixed, "star").select("star", "chunks", "chunk", "key", "root"))
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    paired = rest.withColumn("other", others).where("other <> chunk").select("star", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), (F.col("chunk") > F.col("other")).alias("half"), "key", "root")
    cross = paired.join(sets, "key").groupBy("star", "low", "high").applyInArrow(_compare(threshold, True), "a binary, b binary")
    found = materialize(components(materialize(edges.unionByName(cross))))

    labelled = _with_root(nodes.select("key", "rep"), found)
    best = labelled.groupBy("root").agg(F.min("rep").alias("kept"))
    label = labelled.join(best, "root").select("key", "kept")
    out = hashed.select("doc_id", "th", "key").join(label, "key")
    return out.select("doc_id", "th", F.col("kept.doc_id").alias("class_id"), F.col("kept.th").alias("kept_th"), F.col("kept.doc_id").alias("kept_id"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their class: one a class, with all columns."""
    kept = materialize(near_copies(docs, threshold).select("kept_th", "kept_id").distinct())
    rows = docs.select(as_row(docs), _text_hash(F.col("text").cast("string")).alias("th"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.join(kept, (F.col("th") == F.col("kept_th")) & F.col("id").eqNullSafe(F.col("kept_id")))
    return from_row(rows.groupBy("kept_th", "kept_id").agg(F.first("_row").alias("_row")), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document."""
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


ORACLE_SQL = None
