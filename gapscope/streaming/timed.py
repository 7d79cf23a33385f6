"""Rows of a stream in event-time order: pending rows in a state map, released by event-time timers.

A key's pending rows lie in a map keyed by (chunk of event time, part); one entry holds at most ``PART_ROWS`` rows, so no
state value grows with a stream, and a micro-batch touches only the chunks its rows fall into. Each chunk has one timer
at its end: when the watermark passes it, nothing of the chunk can still arrive, and its rows are sorted, folded and
removed. Rows go in and out as frames, and a chunk leaves in pieces, so a worker holds one chunk of one key at a time,
however many rows a micro-batch brings or releases. The state store must be RocksDB, which keeps entries apart on disk
and checkpoints their changes.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one state entry at most.
PART_ROWS = 500
#: Rows folded and sent on at a time, and rows of a key that wait for their entries to fill.
FOLD_ROWS, HELD_ROWS = 5000, 20_000
#: Width of a chunk of event time unless given.
CHUNK_MS = 600_000

#: ``fold(key, rows, memory)`` gives output rows and the new memory, any JSON value that does not grow with the stream.
Fold = Callable[[str, list, object], tuple[list, object]]


class Release(StatefulProcessor):
    """Holds rows until the watermark passes the end of their chunk, then folds them in (time, tie) order.

    With ``quiet_ms``, ``fold`` is also called without rows and with the pair of its memory and the time before which all
    rows are known, at the latest once a key has been quiet for so long: the watermark is moved by other keys too.
    """

    def __init__(self, fold: Fold, columns: list[str], at: str, tie: str, names: list[str], chunk_ms: int, quiet_ms: int | None = None):
        self.fold, self.columns, self.names, self.chunk_ms, self.quiet_ms = fold, columns, names, chunk_ms, quiet_ms
        self.at_place, self.tie_place = columns.index(at), columns.index(tie)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "value string")
        self.parts = handle.getMapState("parts", "chunk bigint", "parts int")
        self.pending = handle.getMapState("pending", "chunk bigint, part int", "rows string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        values = ([row[c] for c in self.columns] for row in rows)
        self.hold((v[self.at_place], json.dumps(v)) for v in values)
        return iter(())

    def hold(self, rows: Iterable[tuple[int, str]]) -> None:
        """Store rows, given as their time and their values in JSON."""
        chunks: dict[int, list[str]] = {}
        waiting = 0
        for at, text in rows:
            chunk = at // self.chunk_ms
            held = chunks.setdefault(chunk, [])
            held.append(text)
            waiting += 1
            if len(held) == PART_ROWS:
                self.store(chunk, chunks.pop(chunk))
                waiting -= PART_ROWS
            elif waiting == HELD_ROWS:
                for chunk, held in chunks.items():
                    self.store(chunk, held)
                chunks, waiting = {}, 0
        for chunk, held in chunks.items():
            self.store(chunk, held)

    def store(self, chunk: int, rows: list[str]) -> None:
        known = self.parts.getValue((chunk,))
        number = known[0] if known else 0
        if not number:
            self.handle.registerTimer((chunk + 1) * self.chunk_ms)
        self.pending.updateValue((chunk, number), (f"[{', '.join(rows)}]",))
        self.parts.updateValue((chunk,), (number + 1,))

    def take(self, chunk: int) -> list:
        """All rows of a chunk in order; its entries go."""
        number = self.parts.getValue((chunk,))[0]
        rows = []
        for part in range(number):
            rows += [list(r.values()) if isinstance(r, dict) else r for r in json.loads(self.pending.getValue((chunk, part))[0])]
            self.pending.removeKey((chunk, part))
        self.parts.removeKey((chunk,))
        rows.sort(key=lambda r: (r[self.at_place], r[self.tie_place]))
        return rows

    def release(self, key: str, timerValues) -> Iterator[list]:
        """Output rows of all chunks that the watermark has passed, in pieces."""
        passed = timerValues.getCurrentWatermarkInMs() // self.chunk_ms * self.chunk_ms  # all rows before it are there
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else None
        newest = None
        for chunk in sorted(k[0] for k in self.parts.keys() if (k[0] + 1) * self.chunk_ms <= passed):
            rows = self.take(chunk)
            newest = rows[-1][self.at_place]
            for start in range(0, len(rows), FOLD_ROWS):
                made, memory = self.fold(key, rows[start:start + FOLD_ROWS], memory)
                yield made
        if self.quiet_ms is not None:
            made, memory = self.fold(key, [], [memory, passed])
            yield made
            if newest is not None and newest + self.quiet_ms >= passed:
                self.handle.registerTimer(newest + self.quiet_ms + self.chunk_ms)
        self.memory.update((json.dumps(memory),))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for made in self.release(key[0], timerValues):
            for values in made:
                yield Row(**dict(zip(self.names, values)))

    def close(self) -> None:
        pass


class FrameRelease(Release):
    """The same on frames of (key, ``at_ms``, ``packed`` values in JSON), whose output Spark takes over frame by frame."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.hold(pair for frame in rows for pair in zip(frame["at_ms"].tolist(), frame["packed"].tolist()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for made in self.release(key[0], timerValues):
            if made:
                # objects, so that a missing number does not turn whole numbers into floats
                yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in zip(self.names, zip(*made))})


def in_order(stream: DataFrame, key: str, at: str, tie: str, columns: list[str], fold: Fold, out: str, delay: str,
             chunk_ms: int = CHUNK_MS, quiet_ms: int | None = None) -> DataFrame:
    """Fold the rows of each key in (``at``, ``tie``) order, whatever the micro-batches.

    ``fold`` takes rows as lists in the order of ``columns``. Rows that come more than ``delay`` after a newer one are
    late and are dropped; rows without a time never come in order and take no part. A row leaves once the watermark has
    passed its chunk of ``chunk_ms``.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [f.split()[0] for f in out.split(", ")]
    timed = stream.filter(F.col(at).isNotNull()).withColumn("event_time", F.timestamp_millis(at)).withWatermark("event_time", delay)
    processor = FrameRelease(fold, columns, at, tie, names, chunk_ms, quiet_ms)
    packed = F.to_json(F.struct(*[F.col(c).alias(str(i)) for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})
    return timed.select(key, F.col(at).cast("long").alias("at_ms"), packed.alias("packed"), "event_time").groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
