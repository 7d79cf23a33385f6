"""Streams replayed as several micro-batches."""
from __future__ import annotations

import time

import pytest

from pyspark.sql import functions as F

from gapscope.operators import platform as PL
from gapscope.streaming import flows as FL

SCHEMA = "stream string, event_id string, sequence long, received_at long, backfill boolean"
END = ("~", None, None, 10_000_000, None)


def batches(spark, tmp_path, schema, *parts):
    """Each part is one file, so one micro-batch."""
    path = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # file order follows modification time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(spark, tmp_path, stream, name):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start(str(tmp_path / name))
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_continuity_spans_batches_and_backfill_resumes(spark, tmp_path):
    s = batches(spark, tmp_path, SCHEMA,
                [("a", "1", 1, 10, False), ("a", "2", 2, 20, False), ("b", "1", 7, 10, False)],
                [("a", "3", 5, 30, False), ("a", "3b", 3, 31, True), ("a", "4", 6, 40, False)],
                [("a", "5", 6, 50, False), ("a", "6", 7, 60, False), ("b", "2", 8, 20, False)], [END])
    out = drain(spark, tmp_path, FL.continuity(s), "out")
    got = {(r["stream"], r["event_id"]): (r["status"], r["accepted"]) for r in out.collect()}
    assert got == {("a", "1"): ("first", True), ("a", "2"): ("contiguous", True), ("b", "1"): ("first", True), ("a", "3"): ("gap", True), ("a", "3b"): ("backfill", True),
                   ("a", "4"): ("contiguous", True), ("a", "5"): ("regression", False), ("a", "6"): ("contiguous", True), ("b", "2"): ("contiguous", True)}
    assert sorted((r["expected"], r["actual"], r["reason"]) for r in FL.gap_feed(out).collect()) == [(3, 5, "sequence_gap"), (7, 6, "sequence_regression")]


def test_stream_equals_its_batch_twin(spark, tmp_path):
    rows = [("a", f"{i:03d}", (i * 7) % 40, i + 1, False) for i in range(60)]
    out = drain(spark, tmp_path, FL.continuity(batches(spark, tmp_path, SCHEMA, rows[:20], rows[20:45], rows[45:], [END])), "out")
    whole = spark.createDataFrame(rows, SCHEMA)
    twin = PL.sequence_status(whole, ["stream"])
    assert sorted((r["event_id"], r["status"]) for r in out.collect()) == sorted((r["event_id"], r["sequence_status"]) for r in twin.collect())


@pytest.mark.parametrize("files, slices", [(1, 3), (4, 5), (100, 1)])
def test_stream_queries_do_not_depend_on_batches(spark, monkeypatch, files, slices):
    from gapscope.catalog import load_registry, streams
    from test_catalog import same_as_oracle

    monkeypatch.setattr(streams, "FILES", files)
    monkeypatch.setattr(streams, "SLICES", slices)
    registry = load_registry()
    for name in ("stream_continuity", "stream_dedup", "live_peg") if files != 4 else ("stream_bursts", "stream_silences"):
        same_as_oracle(spark, registry[name])


def test_dedup_across_batches(spark, tmp_path):
    schema = "event_id string, received_at long"
    s = batches(spark, tmp_path, schema, [("a", 1000), ("a", 1000)], [("a", 2000), ("b", 3000)])
    assert sorted(r["event_id"] for r in drain(spark, tmp_path, FL.dedup_events(s), "out").collect()) == ["a", "b"]


def test_burst_limit_locks_out(spark, tmp_path):
    schema = "key string, event_id string, at long"
    s = batches(spark, tmp_path, schema, [("k", "1", 1), ("k", "2", 11), ("k", "3", 21)], [("k", "4", 61), ("k", "5", 126), ("j", "1", 21)], [("~", None, 10_000_000)])
    rows = {(r["key"], r["event_id"]): (r["allowed"], r["retry_after_ms"]) for r in drain(spark, tmp_path, FL.burst_limit(s, 2, 50, 100), "out").collect()}
    assert rows == {("k", "1"): (True, 0), ("k", "2"): (True, 0), ("k", "3"): (False, 100), ("k", "4"): (False, 60), ("k", "5"): (True, 0), ("j", "1"): (True, 0)}


def test_silence_is_reported_after_the_timeout(spark, tmp_path):
    s = batches(spark, tmp_path, "stream string, received_at long", [("a", 5), ("a", 9)])
    q = FL.silence_detector(s, 1000).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("silent").count() == 0:
            time.sleep(0.5)
        assert [(r["stream"], r["last_received_at"]) for r in spark.table("silent").collect()] == [("a", 9)]
    finally:
        q.stop()


def test_silences_are_told_by_the_next_row_or_by_the_clock(spark, tmp_path):
    """Stream a is quiet between 10 and 700 and after 1500; b keeps the clock going; a gap of just ``quiet_ms`` is none."""
    schema = "stream string, event_id string, received_at long"
    s = batches(spark, tmp_path, schema, [("a", "1", 0), ("a", "2", 10), ("b", "1", 5)], [("b", "2", 300), ("b", "3", 600), ("a", "3", 700)],
                [("a", "4", 1200), ("a", "5", 1500), ("b", "4", 1100)], [("b", "5", 1600), ("b", "6", 2000)], [("b", "7", 2400), ("~", None, 2700)])
    rows = drain(spark, tmp_path, FL.silences(s, 500, "400 milliseconds", 50), "out").collect()
    assert sorted((r["stream"], r["last_received_at"], r["silent_at"]) for r in rows) == [("a", 10, 510), ("a", 1500, 2000)]


class FakeState:
    """State variables of one key in memory, with the largest value ever held."""

    def __init__(self):
        self.values, self.largest = {}, 0

    def getValue(self, key):
        return self.values.get(key)

    def updateValue(self, key, value):
        self.values[key] = value
        self.largest = max(self.largest, len(str(value)))

    def removeKey(self, key):
        del self.values[key]

    def keys(self):
        return iter(list(self.values))

    def exists(self):
        return "value" in self.values

    def get(self):
        return self.values["value"]

    def update(self, value):
        self.updateValue("value", value)


class FakeHandle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, *schemas):
        return self.states.setdefault(name, FakeState())

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)


def test_no_state_value_grows_with_a_hot_stream():
    """200,000 pending rows of one key and one chunk lie in entries of at most PART_ROWS rows and leave in order."""
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    from gapscope.streaming.timed import PART_ROWS, Release

    def fold(key, rows, memory):
        return [[r[0], r[1]] for r in rows], len(rows) + (memory or 0)

    handle, processor = FakeHandle(), Release(fold, ["at", "id"], "at", "id", ["at", "id"], 1_000_000)
    processor.init(handle)
    for part in range(20):
        assert not list(processor.handleInputRows(("k",), iter([Row(at=(i * 7919) % 999_983, id=str(i)) for i in range(part * 10_000, part * 10_000 + 10_000)]), None))
    assert handle.states["pending"].largest < 40 * PART_ROWS and len(handle.states["pending"].values) >= 200_000 // PART_ROWS
    assert handle.timers == {1_000_000}
    assert list(processor.handleExpiredTimer(("k",), TimerValues(-1, 999_999), ExpiredTimerInfo(999_999))) == []
    out = list(processor.handleExpiredTimer(("k",), TimerValues(-1, 1_000_000), ExpiredTimerInfo(1_000_000)))
    assert len(out) == 200_000 and out == sorted(out, key=lambda r: (r.at, r.id))
    assert not handle.states["pending"].values and not handle.states["parts"].values


def test_released_rows_leave_in_frames():
    """60,000 rows released at once leave in frames of bounded size, in order, with whole numbers beside missing ones."""
    import json

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    from gapscope.streaming.timed import FOLD_ROWS, HELD_ROWS, FrameRelease

    def fold(key, rows, memory):
        assert len(rows) <= FOLD_ROWS
        return [[key, *r] for r in rows], len(rows) + (memory or 0)

    handle, processor = FakeHandle(), FrameRelease(fold, ["at", "id", "n"], "at", "id", ["key", "at", "id", "n"], 1000)
    processor.init(handle)
    packed = [(i * 7919 % 60_000, str(i), None if i % 3 else (1 << 53) + i) for i in range(60_000)]
    frames = [pd.DataFrame({"at_ms": [r[0] for r in part], "packed": [json.dumps(dict(zip("012", r))) for r in part]}) for part in (packed[:25_000], packed[25_000:])]
    assert HELD_ROWS < 25_000 and not list(processor.handleInputRows(("k",), iter(frames), None))
    out = processor.handleExpiredTimer(("k",), TimerValues(-1, 60_000), ExpiredTimerInfo(60_000))
    first = next(out)
    assert len(first) <= FOLD_ROWS and len(handle.states["parts"].values) == 59  # the other chunks are not touched yet
    rows = [tuple(r) for frame in (first, *out) for r in frame.itertuples(index=False)]
    assert rows == [("k", *r) for r in sorted(packed)] and handle.states["memory"].get() == ("60000",)
    assert not handle.states["pending"].values


def test_quality_windows_close_behind_the_watermark(spark, tmp_path):
    schema = "stream string, received_at long, quality struct<status:string>"
    s = batches(spark, tmp_path, schema, [("a", 0, ("valid",)), ("a", 1000, ("degraded",))], [("a", 7_300_000, ("valid",))], [("a", 7_400_000, ("valid",))])
    rows = drain(spark, tmp_path, FL.quality_windows(s, "10 minutes", "1 hour"), "out").collect()
    assert sorted((r["status"], r["events"]) for r in rows) == [("degraded", 1), ("valid", 1)]


def test_forward_split(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "date string")
    assert [r["mode"] for r in FL.forward_split(df, "2024-01-01").orderBy("date").collect()] == ["replay", "forward"]
