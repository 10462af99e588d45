"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses.

A paragraph is a line with its line feed, and its leaves are its clauses, each ending with punctuation or
the line feed, in slices of 32 characters where they are longer. A section ends at a blank line or after a paragraph whose digest is a multiple of 8, so an
edit moves section borders only near itself. A node's digest covers its children's digests, the root's also
the length. The fingerprint is text:

    root ; section ; section ...      section = digest : leaf . leaf ...      leaf = 8 hex digits + length

Roots decide equality. The likeness of two fingerprints compares the trees from the root down: equal nodes
count whole, different ones are opened, and the leaves under different sections are matched as multisets.
It is the share of characters, over both texts, in equal branches.

The edited text of a document takes its last half from the start of the next document, in descending
order of (doc_id, MD5 of the text); the order's end continues at its start. Documents are cut into buckets
at doc_id quantiles; each bucket also gets a copy of the first document of the bucket that follows, so
every pair of neighbours meets in one task, and each text is shuffled once.

Defined cases: null text is empty; null doc_ids come last in the order; among rows with equal doc_id the
MD5 decides, repeated rows are neighbours of one another; a single document is its own next; two empty
texts are alike (1), an empty and another are not (0); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.llm.common import bounded_batches, table

NAME = "op9_merkle_fingerprints"
#: A paragraph whose digest is a multiple of this ends its section.
SECTION = 8
#: A clause longer than this many characters has several leaves.
SLICE = 32
_PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")
_CLAUSE = re.compile(r"[^.,;:!?|\n]*(?:[.,;:!?|]+\s?|\n)|[^.,;:!?|\n]+")


def leaves_of(paragraph: str) -> list[str]:
    """The clauses of a paragraph, long ones in slices."""
    clauses = _CLAUSE.findall(paragraph)
    if len(paragraph) <= SLICE or max(map(len, clauses)) <= SLICE:
        return clauses
    return [c[k : k + SLICE] for c in clauses for k in range(0, len(c), SLICE)]


def fingerprint(text: str) -> str:
    """The tree of a text as a string."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    sections, leaves, inside = [], [], []
    for paragraph in _PARAGRAPH.findall(text):
        parts = leaves_of(paragraph)
        digests = [digest(p) for p in parts]
        own = digest(b"".join(digests))
        inside.append(own)
        leaves.extend([f"{d[:4].hex()}{len(p)}" for d, p in zip(digests, parts)])
        if own[0] % SECTION == 0 or paragraph == "\n":
            sections.append((digest(b"".join(inside)), ".".join(leaves)))
            leaves, inside = [], []
    if inside:
        sections.append((digest(b"".join(inside)), ".".join(leaves)))
    root = hashlib.blake2b(b"".join([d for d, _ in sections]) + str(len(text)).encode(), digest_size=16).hexdigest()
    return ";".join([root, *[f"{d.hex()}:{x}" for d, x in sections]])


def likeness(a: str, b: str) -> float:
    """Share of characters in equal branches of two fingerprints, 0 to 1."""
    if a.partition(";")[0] == b.partition(";")[0]:
        return 1.0
    left, right = Counter(a.split(";")[1:]), Counter(b.split(";")[1:])
    same = left & right
    weight = lambda leaf: int(leaf[8:])
    opened = lambda sections: Counter(x for s, n in sections.items() for x in s.partition(":")[2].split(".") for _ in range(n))
    alike = opened(same)
    one, two = opened(left - same), opened(right - same)
    both = one & two
    equal = sum(weight(x) * n for x, n in alike.items()) + sum(weight(x) * n for x, n in both.items())
    total = 2 * sum(weight(x) * n for x, n in alike.items()) + sum(weight(x) * n for x, n in one.items()) + sum(weight(x) * n for x, n in two.items())
    return 2.0 * equal / total if total else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(start, end) of the character ranges of ``a`` in leaves without an equal in ``b``: where it was edited."""
    if a.partition(";")[0] == b.partition(";")[0]:
        return []
    held = Counter(x for s in b.split(";")[1:] for x in s.partition(":")[2].split("."))
    at, out = 0, []
    for s in a.split(";")[1:]:
        for leaf in s.partition(":")[2].split("."):
            n = int(leaf[8:])
            if held[leaf] > 0:
                held[leaf] -= 1
            elif out and out[-1][1] == at:
                out[-1] = (out[-1][0], at + n)
            else:
                out.append((at, at + n))
            at += n
    return out


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket in order, each bucket followed by a copy of its successor's first row."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None  # doc_id, text, fingerprint of the row before, still without its next
    for b in batches:
        rows = []
        for guard, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            text = text.as_py() or ""
            print_ = fingerprint(text)
            if last is not None:
                changed = edited(last[1], text)
                after = fingerprint(changed)
                rows.append((last[0], len(last[1]), hashlib.sha256(changed.encode()).hexdigest(), last[2], after, likeness(last[2], after), likeness(last[2], print_)))
            last = None if guard else (doc_id, text, print_)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The driver holds the buckets' borders and one (doc_id, MD5) a bucket; their number follows the input's
    partitions, not its rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    borders = d.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("b")).first()["b"] or []
    borders = sorted(set(borders), reverse=True)
    above = F.size(F.filter(F.array(*map(F.lit, borders)), lambda x: x > F.col("doc_id"))) if borders else F.lit(0)
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(borders)).otherwise(above).cast("int")).withColumn("md5", F.md5("text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), F.col("md5"))
    heads = {r["bucket"]: r["head"] for r in d.groupBy("bucket").agg(F.min(order).alias("head")).collect()}
    held = sorted(heads)
    into = {held[k]: held[k - 1] for k in range(len(held))}  # the bucket that needs the first row of this one; the first serves the last
    if not held:
        return spark.createDataFrame([], SCHEMA)
    firsts = spark.createDataFrame([(b, into[b], *heads[b]) for b in held], "b int, target int, none boolean, down long, head_md5 string")
    is_head = (F.col("bucket") == F.col("b")) & F.col("doc_id").isNull().eqNullSafe(F.col("none")) & (-F.col("doc_id")).eqNullSafe(F.col("down")) & (F.col("md5") == F.col("head_md5"))
    guards = d.join(F.broadcast(firsts), is_head).groupBy("target").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    rows = d.select("bucket", F.lit(0).alias("guard"), "doc_id", "md5", "text").unionByName(guards.select(F.col("target").alias("bucket"), F.lit(1).alias("guard"), "doc_id", F.lit("").alias("md5"), "text"))
    ordered = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "guard", F.col("doc_id").desc_nulls_last(), "md5")
    return ordered.select(F.col("guard") == 1, "doc_id", "text").mapInArrow(_pairs, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint row of every document."""
    return fingerprints(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
