"""The state of every source in a stream, against plain sorting."""

import datetime
import random

import pandas as pd

from linelens.streaming import stream

BASE = datetime.datetime(2024, 1, 1)


def at(seconds):
    return BASE + datetime.timedelta(seconds=seconds)


class Live:
    """A folder of frames and the stream on it; every run starts from the checkpoint."""

    def __init__(self, spark, path, **how):
        self.spark, self.how = spark, how
        self.src, self.out, self.ckpt = (str(path / n) for n in ("in", "out", "ck"))

    def run(self, rows, parts=1):
        self.spark.createDataFrame(rows, stream.FRAME_SCHEMA).repartition(parts).write.mode("append").parquet(self.src)
        live = self.spark.readStream.schema(stream.FRAME_SCHEMA).parquet(self.src)
        with stream.keyed_state(self.spark):
            stream.run_to_table(stream.source_history(live, **self.how), self.out, self.ckpt, "update")

    def held(self):
        rows = stream.newest(self.spark, self.out, ["source"]).collect()
        assert all(r.n == len(r.frames) for r in rows)
        return {r.source: [(f.ts, f.inspection_id, f.decision, f.confidence) for f in r.frames] for r in rows}


def expected(rows, keep):
    want = {}
    for source in {r[0] for r in rows}:
        newest = {}
        for _, ts, i, *values in sorted((r for r in rows if r[0] == source and r[1] and r[2] is not None), key=lambda r: r[1]):
            newest[i] = (ts, i, *values)
        want[source] = sorted(newest.values(), key=lambda f: f[:2], reverse=True)[:keep]
    return want


def test_last_frames_after_two_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), at(rng.randrange(3000)), i, rng.choice(["PASS", "DEFECT", None]), rng.choice([0.5, None])) for i in range(400)]
    rows += [(s, t + datetime.timedelta(seconds=5), i, d, c) for s, t, i, d, c in rows[::9]]  # sent again, later
    rows += [("c", at(3), 900, "PASS", 0.1), ("a", None, 901, "PASS", 0.1), ("a", at(2999), None, "PASS", 0.1)]
    rng.shuffle(rows)
    live = Live(spark, tmp_path, late="2 hours", keep=60)
    for k in range(3):
        live.run(rows[k::3] + rows[:5], parts=3)
    assert live.held() == expected(rows, 60)
    assert len(live.held()["a"]) == 60 and live.held()["c"] == [(at(3), 900, "PASS", 0.1)]


def test_late_frames_and_silent_sources(spark, tmp_path):
    live = Live(spark, tmp_path, late="10 minutes", idle="1 hour")
    live.run([("a", at(0), 1, "PASS", 0.5), ("b", at(0), 2, "PASS", 0.5)])
    live.run([("b", at(1800), 3, "PASS", 0.5)])  # both states live; the watermark comes to 20 minutes
    live.run([("a", at(60), 4, "PASS", 0.5), ("a", at(1500), 5, "PASS", 0.5)])  # 4 is too late
    assert [f[1] for f in live.held()["a"]] == [5, 1]
    live.run([("b", at(86400), 6, "PASS", 0.5)])  # the watermark passes an hour after the last frame of a
    live.run([("a", at(86400), 7, "PASS", 0.5)])
    assert [f[1] for f in live.held()["a"]] == [7]


def test_merging_in_any_grouping():
    rng = random.Random(5)
    for _ in range(200):
        frames = [(rng.randrange(20), rng.randrange(25), rng.choice(["x", "y", None]), rng.choice([None, 0.0, 1.0])) for _ in range(rng.randrange(60))]
        cut = rng.randrange(len(frames) + 1)
        parts = [stream.newest_frames(p, 7) for p in (frames[:cut], frames[cut:])]
        assert stream.newest_frames(sum(parts, []), 7) == stream.newest_frames(frames, 7)


def test_a_table_of_frames_at_once_like_one_source_at_a_time(monkeypatch):
    rng = random.Random(6)
    one = stream.newest_frames
    monkeypatch.setattr(stream, "newest_frames", None)  # no work in Python for each source of a batch
    frame = lambda: (rng.choice(["a", "a", "b", "c", None]), rng.randrange(30), rng.randrange(40), rng.choice(["x", "y", None]), rng.choice([None, -1.0, 0.5, float("inf")]))
    for size, held_rows in ((0, 5), (1, 5), (60, 1000), (400, 30), (400, 250)):
        rows = [frame() for _ in range(size)]
        batches = [pd.DataFrame(rows[k : k + 20], columns=["source", "at", "inspection_id", "decision", "confidence"]) for k in range(0, size, 20)]
        out = [f for part in stream._combine(7, held_rows)(iter(batches)) for f in part.astype(object).where(part.notna(), None).itertuples(index=False, name=None)]
        of = lambda table, s: one([f[1:] for f in table if f[0] == s], 7)
        assert {f[0] for f in out} == {f[0] for f in rows} and all(of(out, s) == of(rows, s) for s in {f[0] for f in rows})
        assert size < held_rows or size == 400
        if size < held_rows:  # in one piece: nothing but the newest
            assert len(out) == sum(len(of(rows, s)) for s in {f[0] for f in rows})


def test_the_setting_of_other_streams_stays(spark):
    before = spark.conf.get(stream.STATE_STORE)
    with stream.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(stream.STATE_STORE)
    assert spark.conf.get(stream.STATE_STORE) == before


class Handle:
    """State and timers of one source, counting what is asked of them."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], []

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at_ms):
        self.calls.append("timer")
        self.timers.append(at_ms)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_known_source_costs_one_read_and_one_write():
    from pyspark.sql import Row

    handle, history = Handle(), stream._History(3, 1000)
    history.init(handle)
    frame = lambda i: Row(at=i * 1_000_000, inspection_id=i, decision="PASS", confidence=None)
    list(history.handleInputRows(("a",), iter([frame(1)]), Mark(0)))
    assert handle.calls == ["get", "update", "timer"] and handle.timers == [2000]
    out = list(history.handleInputRows(("a",), iter([frame(k) for k in (2, 3, 4)]), Mark(0)))
    assert handle.calls[3:] == ["get", "update"] and [f.inspection_id for f in out[0].frames] == [4, 3, 2]
    assert list(history.handleExpiredTimer(("a",), Mark(2500), None)) == [] and handle.timers == [2000, 5000] and handle.value
    assert list(history.handleExpiredTimer(("a",), Mark(5000), None)) == [] and handle.value is None
