"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds at most CAPACITY words, never two pieces of one duplicate cluster, and of one source at most half
its room (SOURCE_PARTS of PARTS units, sizes counted in begun units) unless a single piece is longer. Documents
are dealt by hash to shards of about SHARD_DOCUMENTS, and each shard is packed by best fit over decreasing
sizes. Bins are ordered by what is left in them: a bit set of the residuals in use gives the successor of the
wanted size, and per residual a bit set of its bins is masked with the bins in which the document's source
has no room left and those that hold its cluster. If none is left there, the search goes on to the next
residual, until the tightest compatible bin is found or a new one is opened.

A document longer than the capacity has full pieces, which are bins of their own, and a rest that is packed.
Equal rows are counted and dealt evenly over the shards, each carrying its number of copies.
Shards are packed independently, so a cluster or source of any size is spread over all of them, no task holds
more than a shard, and the waste is at most about one bin's worth per shard beyond what conflicts cost.

Defined cases: null text counts 0 words; documents without words need no bin and have a row with null bin;
a null source is a source of its own, a null cluster conflicts with nothing; repeated rows are packed as
rows; no rows give no rows. Equal sizes are ordered by hash, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.llm.common import table, word_count
from linelens.llm.mix import document_hash

NAME = "op10_best_fit_packing"
CAPACITY = 2048
SHARD_DOCUMENTS = 4096
PARTS, SOURCE_PARTS = 16, 8

PACKED = "doc_id long, piece long, start long, n_words long, shard int, bin long"


def best_fit(items: Iterable[tuple[int, object, object]], capacity: int, source_parts: int = SOURCE_PARTS) -> list[int]:
    """Bin number of each item (size, source, cluster), in the order given; bins are numbered as they open."""
    unit = max(1, capacity // PARTS)
    left: list[int] = []  # residual of each bin
    at: dict[int, int] = {}  # residual -> bit set of bins
    used = 0  # bit set of residuals with bins
    words: dict[tuple[object, int], int] = {}  # (source, bin) -> words
    by_source: dict[object, list[int]] = {}  # source -> bit sets of the bins that hold more than k units of it
    by_cluster: dict[object, int] = {}
    out = []
    for size, source, cluster in items:
        levels = by_source.setdefault(source, [0] * source_parts)
        blocked = levels[max(0, source_parts - -(-size // unit))]
        if cluster is not None:
            blocked |= by_cluster.get(cluster, 0)
        higher, base, found = used >> size, size, -1
        while higher:
            step = (higher & -higher).bit_length() - 1
            base += step
            if free := at[base] & ~blocked:
                found = (free & -free).bit_length() - 1
                break
            higher >>= step + 1
            base += 1
        if found < 0:
            found = len(left)
            left.append(capacity)
        else:
            at[base] &= ~(1 << found)
            if not at[base]:
                used &= ~(1 << base)
        left[found] -= size
        bit = 1 << found
        if left[found]:
            at[left[found]] = at.get(left[found], 0) | bit
            used |= 1 << left[found]
        words[source, found] = spent = words.get((source, found), 0) + size
        for k in range(min(source_parts, -(-spent // unit))):
            levels[k] |= bit
        if cluster is not None:
            by_cluster[cluster] = by_cluster.get(cluster, 0) | bit
        out.append(found)
    return out


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, order: Column, capacity: int = CAPACITY, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """Pieces of all documents with their bins: doc_id, piece, start, n_words, shard, bin.

    ``order`` is a hash of the document: it deals documents to shards and orders equal sizes.
    """
    narrow = docs.select("doc_id", size.cast("long").alias("size"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"), order.cast("long").alias("hash"))
    shards = max(1, -(-narrow.count() // shard_documents))
    counted = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.least(F.col("n"), F.lit(shards)))
    dealt = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    copies = F.expr("n div parts") + F.when(F.col("part") < F.col("n") % F.col("parts"), 1).otherwise(0)
    shard = F.pmod(F.pmod(F.xxhash64("hash", "size", "source"), F.lit(shards)) + F.col("part"), F.lit(shards)).cast("int")
    sharded = dealt.select(*narrow.columns, copies.alias("copies"), shard.alias("shard"))

    def one(group: pa.Table) -> pa.Table:
        rows = sorted((r for r in group.to_pylist() for _ in range(r["copies"])), key=lambda r: (-((r["size"] or 0) % capacity), r["hash"], str(r["doc_id"]), str(r["source"])))
        rests = [r for r in rows if (r["size"] or 0) % capacity]
        bins = best_fit(((r["size"] % capacity, r["source"], r["cluster"]) for r in rests), capacity)
        out = [(r["doc_id"], r["size"] // capacity, r["size"] - r["size"] % capacity, r["size"] % capacity, r["shard"], b) for r, b in zip(rests, bins)]
        opened = max(bins, default=-1) + 1
        for r in rows:
            if not r["size"]:
                out.append((r["doc_id"], 0, 0, 0, r["shard"], None))
            for k in range((r["size"] or 0) // capacity):
                out.append((r["doc_id"], k, k * capacity, capacity, r["shard"], opened))
                opened += 1
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in PACKED.split(", ")])

    return sharded.groupBy("shard").applyInArrow(one, PACKED)


def copies_key(text: Column) -> Column:
    """Duplicate cluster of a document among copies that differ in case and white space only; null without words."""
    return F.when(word_count(text) > 0, F.md5(F.regexp_replace(F.trim(F.lower(text)), r"[\x20\x09-\x0D]+", " ")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """Pack ``documents`` rows: words as sizes, exact copies as clusters."""
    text = F.col("text").cast("string")
    return pack(docs, word_count(text), F.col("source"), copies_key(text), document_hash(F.col("doc_id"), text), capacity, shard_documents)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document with their bins."""
    return pack_documents(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
