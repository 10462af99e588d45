"""SimHash near-duplicates: fingerprints within a few bits of one another, found through BK-trees.

A fingerprint has a bit set if more than half of the document's shingle hashes have it set (XXH64 with seed 42
of the words' lower-case bytes, shingles counted as often as they occur). Documents with equal fingerprints
are one node, so a text with very many copies is one row from here on.

Nodes are dealt to shards. The 64 bits are cut into radius + 2 blocks; two fingerprints within the radius
differ in at most ``radius`` blocks, so they agree in two blocks at least and share the shard of that choice.
Every node is in one shard a choice. A shard with more than TREE nodes is cut once more, by the same rule for
the bits its choice leaves free: at radius 2 such a shard agrees in 48 bits, so it cannot hold more than
65,536 fingerprints however the documents are spread. No group grows with the data beyond that, none is paired,
and nothing is left out.

A shard's nodes come to one task and make a BK-tree: a child hangs on its parent under its integer Hamming
distance to it. Before a node is added it is searched for: at a node at distance d only the edges d - radius to
d + radius are followed, since the distances of everything below another edge differ by more. The tree travels
with its shard; all trees together grow with the data, so they are not broadcast to every executor. Links join
a shard's nodes to the smallest node of their set; at most nodes - 1 links leave a shard. Components are
contracted on the executors.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a text of fewer
words than a shingle is one shingle; doc_id may be null or repeated: a component's id is its smallest doc_id,
null if it has none; extra columns are dropped; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.llm.common import bounded_batches, table
from linelens.llm.components import components
from linelens.operators.ordered import attach
from linelens.session import materialize

NAME = "op13_simhash_components"
SHINGLE = 3
RADIUS = 2
SEED = 42
#: Nodes of a shard that is not cut once more.
TREE = 4096
BITS = 64


def shingle_hashes(text: bytes, n: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle, in order; one for a text with fewer words, none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: only A-Z change, cut at the six ASCII blanks
    if len(words) <= n:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(n)))]


def fingerprint(hashes: list[int]) -> int:
    """The bits that more than half of the hashes have, as an unsigned number."""
    import numpy as np

    counts, block = np.zeros(BITS, dtype=np.int64), 1 << 16
    for k in range(0, len(hashes), block):
        part = np.array(hashes[k : k + block], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _prints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_signed(fingerprint(shingle_hashes(t.as_py() or b"", n))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (fp, a signed long) of every document."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(_prints(shingle), "doc_id long, fp long")


class Tree:
    """A BK-tree of unsigned fingerprints."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def search(self, x: int) -> list[int]:
        """Places of all values within the radius of ``x``."""
        out, todo, r = [], [0] if self.values else [], self.radius
        while todo:
            k = todo.pop()
            d = (x ^ self.values[k]).bit_count()
            if d <= r:
                out.append(k)
            if below := self.children[k]:
                todo.extend(below[e] for e in range(d - r, d + r + 1) if e in below)
        return out

    def add(self, x: int) -> None:
        """Hang ``x``, which must not be in the tree, under the last node on its way."""
        if self.values:
            k = 0
            while (child := self.children[k].get(d := (x ^ self.values[k]).bit_count())) is not None:
                k = child
            self.children[k][d] = len(self.values)
        self.values.append(x)
        self.children.append({})


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its set) for a shard's values that are linked to another."""
    tree, parent = Tree(radius), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, x in enumerate(values):  # ascending, so a set's first place is its smallest value
        parent.append(k)
        for near in tree.search(x):
            a, b = root(near), root(k)
            parent[max(a, b)] = min(a, b)
        tree.add(x)
    return [(x, values[r]) for k, x in enumerate(values) if (r := root(k)) != k]


def _links(radius: int):
    """Links of shards that come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, values, out, mask = None, [], [], (1 << BITS) - 1

        def rows() -> pa.RecordBatch:
            pair = [pa.array([_signed(e[k]) for e in out], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(pair, ["a", "b"])

        for b in batches:
            for key, x in zip(b.column("shard").to_pylist(), b.column("fp").to_pylist()):
                if key != shard:
                    out += shard_links(sorted(values), radius)
                    shard, values = key, []
                values.append(x & mask)
            if len(out) > 10_000:
                yield rows()
                out = []
        out += shard_links(sorted(values), radius)
        if out:
            yield rows()

    return run


def choices(free: list[int], radius: int) -> list[int]:
    """Bit masks of all choices of two among radius + 2 blocks of the free bits."""
    n = radius + 2
    blocks = [sum(1 << bit for bit in free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]
    return [x | y for x, y in combinations(blocks, 2)]


def _shards(masks: list[int], salt: int) -> Column:
    """The shard of each choice: a hash of the choice and the bits it fixes."""
    return F.array(*[F.xxhash64(F.lit(salt), F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)])


def links(nodes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within the radius of one another."""
    first = choices(list(range(BITS)), radius)
    entries = materialize(nodes.select("fp", F.posexplode(_shards(first, 0)).alias("choice", "shard")))
    sizes = entries.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.withColumn("large", F.col("n") > tree))
    placed = attach(entries, sizes, ["shard"])
    second = [_shards([m | s for s in choices([bit for bit in range(BITS) if not m >> bit & 1], radius)], 1 + k) for k, m in enumerate(first)]
    deeper = F.get(F.array(*second), F.col("choice"))
    shards = placed.where("NOT large").select("shard", "fp").unionByName(placed.where("large").select(F.explode(deeper).alias("shard"), "fp"))
    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(_links(radius), "a long, b long")


def near_fingerprints(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tree: int = TREE) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    if radius < 0 or shingle < 1:
        raise ValueError("radius must not be negative and shingles need a word")
    hashed = materialize(fingerprints(docs, shingle))
    nodes = materialize(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    found = components(materialize(links(nodes.select("fp"), radius, tree).distinct()))
    labelled = materialize(nodes.join(found, F.col("fp") == F.col("key"), "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root")))
    best = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    label = attach(labelled, materialize(best), ["root"]).select("fp", "component_id", F.col("copies").alias("n"))
    return attach(hashed, materialize(label), ["fp"]).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ORACLE_SQL = None
