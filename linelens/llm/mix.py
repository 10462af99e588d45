"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. A source that may spend fewer words than it has takes the documents
whose hash lies below a threshold; a source that may spend more takes every document as often as its
budget holds all of them, and the threshold deals out the rest. The threshold is found without sorting:
words are summed by source and leading hash bits, the bucket in which the budget runs out is the only one
refined by the next bits, and after five such histograms the threshold is one hash value. Rows with exactly
that hash (one document, or its repeated rows) share what is left of the budget in proportion to their size.

Defined cases: a null text counts 0 words; a null source is a source of its own and comes last; sources
without words get target 0; repeated rows hash alike and are treated alike; a null doc_id hashes as such;
an empty table gives no rows.
Only narrow rows (source, size, hash) are shuffled, pre-aggregated to at most 4096 buckets a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linelens.llm.common import WORD, as_row, from_row, table, word_count
from linelens.session import materialize

NAME = "op4_mix_sources"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
STEP_BITS, STEPS = 12, 5


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over the document's id and text."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("").cast("string"))))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target, and the words left after whole repeats.

    Weights repeat over the sources in code point order. Targets are max_repeats times the source's size
    where the weighted share of the remaining budget exceeds that, and the weighted share elsewhere. Sorted
    by size per weight, the sources cut off come first, and the right share is the largest of those that
    leave out the sources before each. The windows see one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("place", place)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    everything = Window.partitionBy()
    before = Window.orderBy((F.col("source_size") / F.col("weight")), "place").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(everything) - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    share = F.max_by(F.struct("budget", "rest"), F.col("budget") / F.col("rest")).over(everything)
    s = s.withColumn("share", share)
    fair = (F.col("weight") * F.col("share.budget")).cast("double") / F.col("share.rest").cast("double")
    s = s.withColumn("target", F.least((max_repeats * F.col("source_size")).cast("double"), fair))
    repeats = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0)).cast("long")
    s = s.withColumn("repeats", F.least(repeats, F.lit(max_repeats).cast("long")))
    return s.select("source", "source_size", "target", "repeats", (F.floor("target").cast("long") - F.col("repeats") * F.col("source_size")).alias("need"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the hash below which documents are taken once more, and the words left for that hash itself."""
    state = materialize(targets.withColumn("prefix", F.lit(0).cast("long")).withColumn("held", F.col("source_size")))
    for step in range(STEPS):
        shift = STEP_BITS * (STEPS - 1 - step)
        goal = state.select(F.col("source").alias("of"), "prefix", "need")
        inside = sized.join(goal, F.col("source").eqNullSafe(F.col("of"))).where(F.shiftright("hash", shift + STEP_BITS) == F.col("prefix"))
        hist = inside.groupBy("of", F.shiftright("hash", shift).alias("bucket"), "need").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("under", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        edge = hist.where((F.col("under") <= F.col("need")) & (F.col("need") < F.col("under") + F.col("words")))
        edge = edge.select("of", "bucket", (F.col("need") - F.col("under")).alias("left"), "words")
        state = materialize(
            state.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").select(
                "source", "source_size", "target", "repeats", F.coalesce("left", F.lit(0)).cast("long").alias("need"), F.coalesce("bucket", F.lit(-1)).cast("long").alias("prefix"), F.coalesce("words", F.lit(0)).cast("long").alias("held")
            )
        )
    return state


def with_taken(sized: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of ``sized`` with source_size, target and the words taken."""
    goal = state.select(F.col("source").alias("_of"), "source_size", "target", F.col("repeats").alias("_repeats"), F.col("need").alias("_need"), F.col("prefix").alias("_edge"), F.col("held").alias("_held"))
    extra = F.when(F.col("hash") < F.col("_edge"), F.col("size")).when(F.col("hash") == F.col("_edge"), F.expr("size * _need div _held")).otherwise(F.lit(0))
    out = sized.join(goal, F.col("source").eqNullSafe(F.col("_of")))
    return out.withColumn("taken", (F.col("_repeats") * F.col("size") + extra).cast("long")).drop("_of", "_repeats", "_need", "_edge", "_held")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, hash, source_size, target, taken of every document."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("hash")))
    return with_taken(sized, thresholds(sized, source_targets(sized, weights, max_repeats)))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    The document at a source's threshold ends after the words still in the budget (its words, joined by
    blanks). Documents without words are kept once: they cost nothing.
    """
    size, text = word_count(F.col("text")), F.col("text").cast("string")
    rows = docs.select(as_row(docs), "source", text.alias("text"), size.alias("size"), document_hash(F.col("doc_id"), text).alias("hash"))
    sized = materialize(rows.select("source", "size", "hash"))
    rows = with_taken(rows, thresholds(sized, source_targets(sized, weights, max_repeats)))
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(1))
    rest = F.when(F.col("size") > 0, F.expr("taken % size")).otherwise(F.lit(0))
    parts = F.filter(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.array(rest)), lambda n: n != 0)
    out = rows.select("_row", "text", F.explode(parts).alias("words"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("words") < 0, F.col("text")).otherwise(cut))
    return from_row(out, docs.columns, text=F.col("text"), n_chars=F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15)) AS BIGINT) AS hash FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s0),
t AS (SELECT CAST(sum(s) AS BIGINT) AS total FROM s1),
-- for every number of sources cut off: the share of the others; the largest is the one that holds
cuts AS (SELECT a.source, total - 3 * coalesce((SELECT sum(b.s) FROM s1 b WHERE b.s / b.w < a.s / a.w), 0) AS budget,
    (SELECT sum(b.w) FROM s1 b WHERE b.s / b.w >= a.s / a.w) AS rest FROM s1 a, t),
best AS (SELECT CAST(budget AS BIGINT) AS budget, CAST(rest AS BIGINT) AS rest FROM cuts ORDER BY budget / rest DESC LIMIT 1),
g AS (SELECT source, s, least(CAST(3 * s AS DOUBLE), CAST(w * budget AS DOUBLE) / CAST(rest AS DOUBLE)) AS target FROM s1, best),
g2 AS (SELECT *, CASE WHEN s > 0 THEN least(3, CAST(floor(target) AS BIGINT) // s) ELSE 0 END AS f FROM g),
x AS (SELECT d.*, g2.s AS source_size, g2.target, g2.f, CAST(floor(g2.target) AS BIGINT) - g2.f * g2.s AS need,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS upto,
    CAST(sum(d.size) OVER (PARTITION BY d.source, d.hash) AS BIGINT) AS held
  FROM d JOIN g2 ON d.source IS NOT DISTINCT FROM g2.source)
SELECT doc_id, size, source_size, target,
  CAST(f * size + CASE WHEN upto <= need THEN size WHEN upto - held <= need THEN size * (need - (upto - held)) // held ELSE 0 END AS BIGINT) AS taken FROM x
"""
