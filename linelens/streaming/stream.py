"""Structured Streaming over inspection records: scoring, windowed counts, investigations, stage events."""

from __future__ import annotations

import heapq
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from linelens.operators.inspect import decide, probabilities
from linelens.operators.investigate import investigate

INPUT_SCHEMA = "inspection_id long, ts timestamp, label int, logits array<double>"
FRAME_SCHEMA = "source string, ts timestamp, inspection_id long, decision string, confidence double"
HISTORY = 60
_FRAME = "at long, inspection_id long, decision string, confidence double"  # at: microseconds, the same in every time zone
_HELD = "at array<long>, inspection_id array<long>, decision array<string>, confidence array<double>"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
STAGE_SCHEMA = "inspection_id long, seq int, stage string, status string, at timestamp"


def read_inputs(spark: SparkSession, path: str, schema: str = INPUT_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def score(stream: DataFrame, temperature: float = 1.0) -> DataFrame:
    """The batch decision layer on a stream (or on a batch table: same code, same answer)."""
    nothing = F.lit(None).cast("double")
    return decide(probabilities(stream, temperature).withColumn("anomaly", nothing).withColumn("novelty", nothing))


def decision_counts(scored: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Decisions per event-time window; the watermark bounds the state and drops rows later than ``late``."""
    timed = scored.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "decision").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), "decision", "n")


def unique_inspections(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One record per inspection id, also when a source sends it again within the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["inspection_id"])


def newest_frames(frames, keep: int) -> list[tuple]:
    """The last ``keep`` of (at, inspection_id, ...), newest first; of an inspection sent again the newest version counts.

    Versions of one instant are told apart by their other values, so the order of arrival does not matter. The newest of
    a union are among the newest of its parts: this merges in any grouping.
    """
    rank = lambda f: (f[0], f[1], f[2] or "", f[3] is not None, f[3] or 0.0)
    held: dict[int, tuple] = {}
    for f in frames:
        if f[1] not in held or rank(f) > rank(held[f[1]]):
            held[f[1]] = f
    return heapq.nlargest(keep, held.values(), key=rank)


class _History(StatefulProcessor):
    """The newest frames of one source, held until the source has been silent for ``idle_ms`` of event time."""

    def __init__(self, keep: int, idle_ms: int):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.frames = handle.getValueState("frames", _HELD)  # one value a source: one read and one write a micro-batch

    def handleInputRows(self, key, rows, timerValues):
        before = self.frames.get()
        held = newest_frames([*(zip(*before) if before else ()), *((r.at, r.inspection_id, r.decision, r.confidence) for r in rows)], self.keep)
        self.frames.update(tuple(list(c) for c in zip(*held)))
        if not before:  # a source with state has a timer
            self.handle.registerTimer(held[0][0] // 1000 + self.idle_ms)
        yield Row(source=key[0], n=len(held), frames=[Row(at=f[0], inspection_id=f[1], decision=f[2], confidence=f[3]) for f in held])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.frames.get()
        silent = held[0][0] // 1000 + self.idle_ms if held else 0
        if silent > timerValues.getCurrentWatermarkInMs():  # frames came since the timer was set
            self.handle.registerTimer(silent)
        else:
            self.frames.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_rows(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    """``newest_frames`` of every source of a table of frames at once, by one sort of the rows."""
    source, _ = pd.factorize(rows["source"], use_na_sentinel=False)
    decision, _ = pd.factorize(rows["decision"].fillna(""), sort=True)
    at, key, confidence = (rows[c].to_numpy() for c in ("at", "inspection_id", "confidence"))
    known = ~np.isnan(confidence)
    order = np.lexsort((np.where(known, confidence, 0.0), known, decision, key, at, source))[::-1]  # a source's newest come first
    order = order[~pd.DataFrame({"s": source[order], "i": key[order]}).duplicated().to_numpy()]
    of = source[order]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.array([], dtype=int)
    place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
    return rows.iloc[order[place < keep]]


def _combine(keep: int, held_rows: int = 50_000):
    """Map side of the history: a task passes on only its newest frames of a source, so a hot source stays small."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.assign(confidence=batch["confidence"].astype("float64")))
            n += len(batch)
            if n > held_rows:
                few = newest_rows(pd.concat(held), keep)
                held, n = [few], len(few)
                if 2 * n > held_rows:  # many sources: more rows would not make it smaller
                    yield few
                    held, n = [], 0
        if held:
            yield newest_rows(pd.concat(held), keep)

    return run


def source_history(scored: DataFrame, keep: int = HISTORY, late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """The last ``keep`` inspections of every source, newest first (update mode): a row for each source a micro-batch touched.

    ``scored`` holds the columns of ``FRAME_SCHEMA``. Order is event time, then inspection id; an inspection sent again
    counts once. Frames later than ``late`` are dropped, frames without instant or id have no place; a null source is a
    source of its own. A source silent for ``idle`` loses its state, and its next frame starts a new history. Read the
    written table with ``newest(spark, path, ["source"])``. Start it under ``keyed_state``: the state lives in RocksDB
    on the executors and in the checkpoint, at most ``keep`` rows a source.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    known = scored.select("source", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "inspection_id", "decision", "confidence").where(
        "at IS NOT NULL AND inspection_id IS NOT NULL")
    few = known.mapInPandas(_combine(keep), f"source string, {_FRAME}").withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", late)
    held = few.groupBy("source").transformWithState(_History(keep, idle_ms), f"source string, n int, frames array<struct<{_FRAME}>>", "Update", "EventTime")
    return held.select("source", "n", F.transform("frames", lambda f: F.struct(
        F.timestamp_micros(f["at"]).alias("ts"), f["inspection_id"].alias("inspection_id"), f["decision"].alias("decision"), f["confidence"].alias("confidence"))).alias("frames"))


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers need; a restart reads the setting from the checkpoint."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def auto_investigate(scored: DataFrame, context: DataFrame, dataset_id: str | None, path: str, checkpoint: str, trigger: dict | None = None):
    """DEFECT and REVIEW open an investigation. Each micro-batch owns one folder, so a replay overwrites itself."""

    def run(batch: DataFrame, epoch: int) -> None:
        open_ = batch.where("decision in ('DEFECT', 'REVIEW')").select(
            "inspection_id", F.lit(dataset_id).cast("string").alias("dataset_id"), "decision", F.col("predicted").alias("predicted_class"), "confidence",
            F.col("anomaly"), F.col("novelty"), F.lit(None).cast("string").alias("novelty_status"), F.lit(False).alias("localized"),
            F.lit(None).cast("string").alias("filename"))
        investigate(open_, context).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return scored.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stage_latest(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Last stage per inspection and day of an event stream (update mode); the watermark lets finished days go.

    An inspection that runs over several days has a row for each; ``newest`` keeps the last one.
    """
    timed = events.withWatermark("at", late) if events.isStreaming else events
    return timed.groupBy(F.window("at", window), "inspection_id").agg(
        F.max("seq").alias("seq"), F.max_by("stage", "seq").alias("stage"), F.max_by("status", "seq").alias("status")).select(
        F.col("window.start").alias("window_start"), "inspection_id", "seq", "stage", "status")


def newest(spark: SparkSession, path: str, keys: list[str], order: str = "epoch") -> DataFrame:
    """The current rows of a table written in update mode: per key the row of the last micro-batch (or of ``order``)."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "epoch"]
    by = F.struct(*dict.fromkeys([order, "epoch"]))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), by).alias("s")).select(*keys, "s.*")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run what is available and stop; the sink is parquet (append), one overwritten table (complete), or a folder a micro-batch (update)."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        handle = writer.format("parquet").option("path", path).outputMode("append").start()
    else:
        handle = writer.outputMode(mode).foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/epoch={e}")).start()
    handle.awaitTermination()
    return handle
