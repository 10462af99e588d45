"""Removal of long repeated passages with suffix sorting, over all documents.

A string of LENGTH bytes that starts at two places, in one document or in two, covers bytes that are removed.
Two equal strings have the same smallest hash among their GRAM-byte substrings, so:

1. Every distinct text is cut into segments: runs of neighbouring places whose LENGTH-byte strings have the
   same smallest hash. A segment carries all bytes of its strings. Hashes that occur at one place are done with.
2. The segments of each other hash meet in one task; equal ones are one segment with a count. The task puts
   the segments of many hashes into one text, builds its Burrows-Wheeler transform, and finds by breadth-first
   backward extension, with common prefixes by increasing value and an end at LENGTH, which places start a
   repeated string (``bwt``). Segments that occur more than once are repeated throughout.
3. Hashes with more than GROUP_BYTES of different segments (a passage in very many documents) are not gathered:
   their strings are counted one by one by a 128-bit hash, pre-aggregated, which gives the same places.
4. The places become byte ranges of their texts, whose union is removed.

Texts that occur in several documents are repeated as a whole if they have LENGTH bytes. Texts are joined by
MD5 and the smallest doc_id that has them, so a text with many copies is read as one row.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; repeated rows are copies of one
another; doc_id may be null; extra columns are dropped; no rows give no rows. In ``without_repeats`` a text
whose UTF-8 sequence was cut by a removal loses the broken character too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.llm.bwt import repeated_starts
from linelens.llm.common import as_row, bounded_batches, from_row, table
from linelens.llm.near_copies import mix64
from linelens.session import materialize

NAME = "op3_repeated_passages"
LENGTH = 400
GRAM = 64
#: Bytes of different segments of one hash that a task may gather.
GROUP_BYTES = 3 << 20
#: Bytes of segments sorted together.
TEXT_BYTES = 3 << 19
#: A segment has at most this many places; longer runs are cut.
RUN = 1 << 16


def _letters(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def string_hashes(data: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """64-bit hashes of all substrings of a length, built from those of half the length."""
    step = _letters(seed)[data]
    out, have = None, 0
    width, factor = 1, np.uint64(0x9E3779B97F4A7C15 ^ (seed << 1))
    with np.errstate(over="ignore"):
        while True:
            if length & width:
                out = step if out is None else out[: len(step) - have] * factor + step[have:] if len(step) > have else step[:0]
                have += width
            if width * 2 > length:
                break
            step = step[: max(0, len(step) - width)] * factor + step[width:]
            factor = factor * factor
            width *= 2
    return mix64(out[: max(0, len(data) - length + 1)])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x)
    rows = -(-n // width)
    a = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    a[:n] = x
    a = a.reshape(rows, width)
    ahead = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(a, axis=1).reshape(-1)
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First place, place behind the last, smallest hash, and whether the segment has that hash at several places,
    for every segment of a text of ``length`` bytes or more."""
    hashes, width = string_hashes(data, gram), length - gram + 1
    low = sliding_minimum(hashes, width)
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    start = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(low)]])
    if (end - start).max() > RUN:
        pieces = -(-(end - start) // RUN)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + nth * RUN
        end = np.minimum(np.repeat(end, pieces), start + RUN)
    value, again = low[start], np.zeros(len(start), dtype=bool)
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    for k in range(0, len(start), 2048):  # its first place lies in the first string, its last in the last
        part = slice(k, k + 2048)
        first = (views[start[part]] == value[part, None]).argmax(axis=1) + start[part]
        last = end[part] - 2 + width - (views[end[part] - 1] == value[part, None])[:, ::-1].argmax(axis=1)
        again[part] = first != last
    return start, end, value.view(np.int64), again


def _bytes(value) -> np.ndarray:
    return np.frombuffer((value.as_py() or "").encode(), dtype=np.uint8)


def _cut(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [segments(_bytes(t), length, gram) for t in b.column("text")]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            columns = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("th"), *columns], ["th", "starts", "ends", "hashes", "again"])

    return run


def _segment_rows(length: int, with_bytes: bool):
    """One row per candidate segment: hash, digest of its bytes, and either the bytes or its text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for th, text, spots in zip(b.column("th").to_pylist(), b.column("text"), b.column("spots").to_pylist()):
                data = (text.as_py() or "").encode()
                parts = [data[s["start"] : s["end"] + length - 1] for s in spots]
                hashes = pa.array([s["hash"] for s in spots], pa.int64())
                digests = pa.array([hashlib.md5(p).digest() for p in parts], pa.binary())
                if with_bytes:
                    yield pa.RecordBatch.from_arrays([hashes, digests, pa.array(parts, pa.binary())], ["hash", "sh", "bytes"])
                else:
                    starts = pa.array([s["start"] for s in spots], pa.int32())
                    yield pa.RecordBatch.from_arrays([hashes, digests, pa.array([th] * len(spots), pa.binary()), starts], ["hash", "sh", "th", "start"])

    return run


def ranges(flags: np.ndarray) -> list[int]:
    """Borders of the runs of true places: start, end, start, end, ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.tolist()


FOUND = "hash long, sh binary, places array<int>"


def _search(length: int, text_bytes: int):
    """Repeated places of segments that come sorted by hash: whole hashes are sorted together, about ``text_bytes`` at a time."""

    def solve(rows: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
        parts = [np.frombuffer(r[3], dtype=np.uint8) for r in rows]
        text = np.zeros(sum(map(len, parts)) + len(parts), dtype=np.uint16)
        borders = np.cumsum([0] + [len(p) + 1 for p in parts])
        for p, at in zip(parts, borders):
            text[at : at + len(p)] = p.astype(np.uint16) + 1
        flags = repeated_starts(text, length)
        places = [[0, len(p) - length + 1] if r[2] > 1 else ranges(flags[at : at + len(p) - length + 1]) for r, p, at in zip(rows, parts, borders)]
        keep = [k for k, p in enumerate(places) if p]
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in keep], pa.int64()), pa.array([rows[k][1] for k in keep], pa.binary()), pa.array([places[k] for k in keep], pa.list_(pa.int32()))], ["hash", "sh", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("hash", "sh", "n", "bytes"))):
                if size >= text_bytes and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield solve(rows)

    return run


def _string_rows(length: int):
    """Every string of a segment by two 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, sh, n, data in zip(*(b.column(c).to_pylist() for c in ("hash", "sh", "n", "bytes"))):
                x = np.frombuffer(data, dtype=np.uint8)
                one, two = (string_hashes(x, length, s).view(np.int64) for s in (2, 3))
                k = len(one)
                yield pa.RecordBatch.from_arrays([pa.array([h] * k, pa.int64()), pa.array([sh] * k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)), pa.array([n] * k, pa.int64()), pa.array(one), pa.array(two)], ["hash", "sh", "place", "n", "one", "two"])

    return run


def _removed(data: bytes, spans) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, bytes kept) for the union of byte ranges."""
    cover = np.zeros(len(data) + 1, dtype=np.int32)
    for start, end in spans:
        cover[start] += 1
        cover[end] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    return int(gone.sum()), len(ranges(gone)) // 2, np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()


RESULT = "th binary, n_removed long, n_spans long, kept_sha256 string, kept string"


def _results(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for th, text, found in zip(b.column("th").to_pylist(), b.column("text"), b.column("found").to_pylist()):
                spans = [(f["start"] + s, f["start"] + e + length - 1) for f in found for s, e in zip(f["places"][::2], f["places"][1::2])]
                n, runs, kept = _removed((text.as_py() or "").encode(), spans)
                out.append((th, n, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return run


def _text_hash(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, text_bytes: int = TEXT_BYTES, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(facts, changed): facts has doc_id, th, n_bytes and the SHA-256 of every row; changed has one row per
    distinct text that loses bytes: th, n_removed, n_spans, kept_sha256 and, on request, the kept text."""
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(text).alias("th"), text.alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    facts = materialize(d.select("doc_id", "th", size.cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")))
    reps = facts.where(F.col("n_bytes") >= length).groupBy("th").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"))

    cut = d.where(size >= length).select("th", "text").mapInArrow(_cut(length, gram), "th binary, starts array<int>, ends array<int>, hashes array<long>, again array<boolean>")
    cut = materialize(cut.groupBy("th").agg(*[F.first(c).alias(c) for c in ("starts", "ends", "hashes", "again")]))
    one_by_one = cut.select("th", F.explode(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"), F.col("hashes").alias("hash"), "again")).alias("s")).select("th", "s.start", "s.end", "s.hash", "s.again")
    common = one_by_one.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("hash")
    spots = one_by_one.join(common, "hash").groupBy("th").agg(F.collect_list(F.struct("start", "end", "hash")).alias("spots"))
    wanted = spots.join(reps, "th").select(F.col("th").alias("of"), "rep_id", "copies", "spots")
    held = materialize(d.where(size >= length).join(wanted, (F.col("th") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("th", "copies", "text", "spots"))

    rows = held.select("th", "text", "spots").mapInArrow(_segment_rows(length, True), "hash long, sh binary, bytes binary")
    distinct = materialize(rows.groupBy("hash", "sh").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes")))
    large = distinct.groupBy("hash").agg(F.sum(F.octet_length("bytes")).alias("size")).where(F.col("size") > group_bytes).select("hash")
    large = materialize(large)
    gathered = distinct.join(large, "hash", "left_anti").repartition("hash").sortWithinPartitions("hash", "sh")
    found = gathered.select("hash", "sh", "n", "bytes").mapInArrow(_search(length, text_bytes), FOUND)
    strings = distinct.join(large, "hash").select("hash", "sh", "n", "bytes").mapInArrow(_string_rows(length), "hash long, sh binary, place int, n long, one long, two long")
    twice = strings.groupBy("one", "two").agg(F.sum("n").alias("times")).where("times > 1").select("one", "two")
    counted = strings.join(twice, ["one", "two"]).groupBy("hash", "sh").agg(F.flatten(F.collect_list(F.array(F.col("place"), F.col("place") + 1))).alias("places"))
    found = materialize(found.unionByName(counted))

    where = held.where("copies = 1").select("th", "text", "spots").mapInArrow(_segment_rows(length, False), "hash long, sh binary, th binary, start int")
    by_text = where.join(found, ["hash", "sh"]).groupBy("th").agg(F.collect_list(F.struct("start", "places")).alias("found"))
    changed = held.where("copies = 1").select("th", "text").join(by_text, "th").mapInArrow(_results(length, with_text), RESULT)
    whole = reps.where("copies > 1").select("th").join(facts.groupBy("th").agg(F.max("n_bytes").alias("n_bytes")), "th")
    gone = whole.select("th", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.lit("").alias("kept"))
    return facts, changed.unionByName(gone)


def repeated_passages(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    facts, changed = removals(docs, length, **options)
    out = facts.join(changed.drop("kept"), "th", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with repeated passages taken out of the texts; documents of which nothing is left are dropped."""
    _, changed = removals(docs, length, with_text=True, **options)
    text = F.col("text").cast("string")
    # the text goes along once, beside the other columns
    rows = docs.select(as_row(docs.drop("text")), text.alias("text"), _text_hash(text).alias("of"))
    out = rows.join(changed.select("th", "kept"), F.col("of") == F.col("th"), "left").where("kept IS NULL OR kept <> ''")
    out = out.select("_row", F.coalesce("kept", "text").alias("text"))
    return from_row(out, docs.columns, text=F.col("text"), n_chars=F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated 400-byte strings."""
    return repeated_passages(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
