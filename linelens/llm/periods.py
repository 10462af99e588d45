"""Periodic runs in the word sequence of each document, by an online sparse diagonal scan.

A run is a stretch of consecutive words with smallest period q that is at least ``least`` words and two periods
long and that no neighbouring word extends. With words q apart equal, the pairs (i, i - q) of a run lie on one
diagonal of the document's self-comparison, at lag q, without a gap. The scan goes over the words once and
keeps, for each lag that is matching now, the word at which its diagonal began. A word's earlier occurrences
are the lags that go on or begin; every other lag ends there, and if it has been matching for long enough its
run is emitted at once.

An occurrence counts only together with its CONTEXT = least / 2 last words: a run's diagonal has at least
max(q, least - q) >= least / 2 matches, so none is lost, and words without such a repeated context, most of a
normal text, cost nothing. While a run of period q is going on, lags above q between two places of it are not
followed, but for its first periods: a multiple of q has the same stretch, and any other lag that matched for
long enough would make q divisible (Fine and Wilf). A lag that is taken up again finds its beginning by looking
back. Occurrences are linked backwards, so the scan steps over a whole run at once and a text of one word
repeated is read in linear time; repeats that are no run cost one step for each pair of equal contexts.

Memory is a document's words and its active lags. Rows are independent: no shuffle, nothing to lose with an
executor but its own task.

Defined cases: null text has no words and no runs; an empty or blank text likewise; doc_id may be null or
repeated, every row has its own result; extra columns are dropped; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.llm.common import WORD, bounded_batches, table

NAME = "op11_periodic_runs"
LEAST = 12
#: Bytes of text whose words are numbered together.
BLOCK_BYTES = 4 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _ranked(a, b):
    """Numbers of the pairs (a, b): equal pairs have equal numbers."""
    import numpy as np

    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def previous_contexts(words, docs, context: int):
    """For every place the last earlier place of the same document that ends the same ``context`` words, or -1.

    Words are numbers; contexts are numbered exactly, by doubling.
    """
    import numpy as np

    n = len(words)
    if n < context:
        return np.full(n, -1, dtype=np.int64)
    step, width, out, have = _ranked(docs, words), 1, None, 0
    while True:
        if context & width:
            out = step if out is None else _ranked(out[: n - have - width + 1], step[have:])
            have += width
        if width * 2 > context:
            break
        step = _ranked(step[: len(step) - width], step[width:])
        width *= 2
    order = np.argsort(out, kind="stable")
    before = np.full(n, -1, dtype=np.int64)
    same = out[order[1:]] == out[order[:-1]]
    before[order[1:][same] + context - 1] = order[:-1][same] + context - 1
    return before


def _prime_divisors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def scan(words: list, before: list[int], places: list[int], context: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period; ``places`` are those with an earlier context."""
    out = []

    def emit(lags: dict[int, int], end: int) -> None:
        for q, begin in lags.items():
            start = begin - context + 1 - q
            length = end - start + 1
            if length >= max(least, 2 * q) and all(words[start : start + q] != words[start + q // p : start + q + q // p] for p in _prime_divisors(q)):
                out.append((start, length, q))

    active: dict[int, int] = {}  # lag -> place at which its diagonal began
    last = -1
    for i in places:
        if active and i != last + 1:
            emit(active, last)
            active = {}
        now, j = {}, before[i]
        while j >= 0:
            q = i - j
            begin = active.pop(q, None)
            if begin is None:  # new, or left out while a run was going on
                begin = i
                while begin - context >= q and words[begin - context] == words[begin - context - q]:
                    begin -= 1
            now[q] = begin
            start = begin - context + 1 - q
            if i - start + 1 >= max(least, 2 * q):  # in a run: on to its first periods
                j -= max(0, (j - start - context) // q - 1) * q
            j = before[j]
        if active:
            emit(active, last)
        active, last = now, i
    emit(active, last)
    return sorted(out)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = bytearray(len(words))
    for start, length, q in runs:
        gone[start + q : start + length] = b"\x01" * (length - q)
    return b" ".join(w for w, g in zip(words, gone) if not g)


def _block(texts: list[bytes], least: int) -> Iterator[tuple[int, list, bytes]]:
    import numpy as np

    context, known = max(1, (least + 1) // 2), _Numbers()
    split = [t.split() for t in texts]  # bytes: at the six ASCII blanks
    sizes = np.array([len(w) for w in split])
    first = np.cumsum(sizes) - sizes
    numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    before = previous_contexts(numbers, np.repeat(np.arange(len(texts)), sizes), context)
    for words, n, at in zip(split, sizes.tolist(), first.tolist()):
        own = before[at : at + n]
        places = np.flatnonzero(own >= 0)
        runs = []
        if len(places):
            runs = scan(numbers[at : at + n].tolist(), np.where(own >= 0, own - at, -1).tolist(), places.tolist(), context, least)
        yield n, runs, collapsed(words, runs)


def _rows(least: int):
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            out = list(_block(texts, least))
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in o[1]] for o in out]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array(runs, kinds), pa.array([o[2].decode() for o in out], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        for b in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids.append(doc_id)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield flush(ids, texts)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), and collapsed, the text with every run cut to one period."""
    if least < 1:
        raise ValueError("least must be positive")
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(_rows(least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The text, for one id in ten with its words from a certain place on repeating with a certain period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long") + 1
        at = lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i).cast("int")
        return F.array_join(F.transform(ws, lambda w, i: F.get(ws, at(i.cast("long")))), " ")

    # the one-element array binds the words to a lambda variable, so that they are cut once
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    changed = F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeat(ws)).otherwise(F.lit(""))), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, its longest one, and digests of the runs and of the collapsed text."""
    d = table(spark, sf_dir, "documents")
    found = periodic_runs(d.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE_SQL = None
