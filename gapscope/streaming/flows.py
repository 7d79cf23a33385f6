"""Structured Streaming operators: continuity, quality, dedup, bursts, silence, live ticks.

Results do not depend on how rows fall into micro-batches. Ordered operators (``timed``) hold a row until the watermark
passes its chunk of time and then fold the rows of a stream in (time, id) order. A bounded replay ends with a row that is
one delay newer than all others, which lets everything before it pass.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import quality as QL
from ..operators import peg as G
from ..operators import platform as PL
from .timed import CHUNK_MS, in_order

CONTINUITY_OUT = ("stream string, event_id string, sequence long, received_at long, backfill boolean, "
                  "status string, expected_sequence long, accepted boolean")


def stream_key(df: DataFrame) -> DataFrame:
    return df.withColumn("stream", F.concat_ws("|", "source", "kind", F.coalesce("instrument", F.lit("_"))))


def continuity(stream: DataFrame, delay: str = "2 hours", carry: str | None = None, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Sequence status of each record: first, contiguous, gap or regression.

    ``stream``: stream, event_id, sequence, received_at, backfill, and a string column to ``carry`` along. Regressions
    are not accepted. Records without sequence and backfilled records pass without moving the state; a gap moves it to
    the record that showed the gap, so a backfill that fills it does not count as regression.
    """
    def fold(key: str, rows: list, last: int | None) -> tuple[list, int | None]:
        made = []
        for event_id, seq, at, backfill, *more in rows:
            want = None
            if backfill or seq is None:
                result = "backfill" if backfill else "unsequenced"
            elif last is None:
                result, last = "first", int(seq)
            else:
                want = last + 1
                result = "contiguous" if seq == want else "gap" if seq > want else "regression"
                last = max(last, int(seq))
            made.append([key, event_id, seq, at, backfill, result, want, result != "regression", *more])
        return made, last

    columns = ["event_id", "sequence", "received_at", "backfill", *([carry] if carry else [])]
    return in_order(stream, "stream", "received_at", "event_id", columns, fold, CONTINUITY_OUT + (f", {carry} string" if carry else ""), delay, chunk_ms)


def gap_feed(checked: DataFrame) -> DataFrame:
    """Notices of gaps and dropped regressions."""
    return checked.filter(F.col("status").isin("gap", "regression")).select(
        "stream", "event_id", F.col("expected_sequence").alias("expected"), F.col("sequence").alias("actual"),
        F.concat(F.lit("sequence_"), "status").alias("reason"))


def with_backfill(live: DataFrame, recovered: DataFrame) -> DataFrame:
    """Live records and recovered ones as one stream; recovered rows resume continuity."""
    return live.withColumn("backfill", F.lit(False)).unionByName(recovered.withColumn("backfill", F.lit(True)))


def stream_quality(stream: DataFrame, policies: DataFrame, sequence_status: Column | None = None) -> DataFrame:
    """Policy, freshness and content quality of streaming events; stateless but for the status given."""
    rows = stream.join(policies, "source", "left")
    return PL.add_quality(rows, sequence_status if sequence_status is not None else F.lit("first"))


def dedup_events(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """First record of each event id within the watermark; state older than the delay is dropped."""
    timed = stream.withColumn("event_time", F.timestamp_millis("received_at"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def burst_limit(stream: DataFrame, limit: int, window_ms: int, lockout_ms: int = 0, delay: str = "2 hours", chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Accept at most ``limit`` records per sliding window of each key, then lock the key out.

    ``stream``: key, event_id, at. Memory: the accepted times inside the window (``limit`` at most) and the end of the
    lockout.
    """
    def fold(key: str, rows: list, memory: list | None) -> tuple[list, list]:
        times, locked = memory or [[], 0]
        made = []
        for event_id, now in rows:
            times = [t for t in times if now - t < window_ms]
            if locked > now:
                made.append([key, event_id, now, False, locked - now])
                continue
            locked = 0
            if len(times) >= limit:
                wait = max(1, window_ms - (now - times[0]))
                locked = now + lockout_ms if lockout_ms > 0 else 0
                made.append([key, event_id, now, False, max(wait, lockout_ms)])
                continue
            times.append(now)
            made.append([key, event_id, now, True, 0])
        return made, [times, locked]

    return in_order(stream, "key", "at", "event_id", ["event_id", "at"], fold,
                    "key string, event_id string, at long, allowed boolean, retry_after_ms long", delay, chunk_ms)


def silences(stream: DataFrame, quiet_ms: int, delay: str = "2 hours", chunk_ms: int = CHUNK_MS) -> DataFrame:
    """A row for every time a stream sends nothing for longer than ``quiet_ms`` of event time.

    ``stream``: stream, event_id, received_at. Told either by the next record, or, where none comes, by a timer once the
    records of other streams have moved the clock past the silence. Memory: the last time and whether it was told.
    """
    def fold(key: str, rows: list, memory: list | None) -> tuple[list, list | None]:
        if not rows:
            memory, now = memory
            if memory is None or memory[1] or now <= memory[0] + quiet_ms:
                return [], memory
            return [[key, memory[0], memory[0] + quiet_ms]], [memory[0], True]
        made = []
        for at, _ in rows:
            if memory is not None and not memory[1] and at - memory[0] > quiet_ms:
                made.append([key, memory[0], memory[0] + quiet_ms])
            if memory is None or at > memory[0]:
                memory = [at, False]
        return made, memory

    return in_order(stream, "stream", "received_at", "event_id", ["received_at", "event_id"], fold,
                    "stream string, last_received_at long, silent_at long", delay, chunk_ms, quiet_ms)


def silence_detector(stream: DataFrame, quiet_ms: int) -> DataFrame:
    """A row for every stream that sends nothing for ``quiet_ms`` of processing time; ``silences`` is its replayable twin."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"stream": [key[0]], "last_received_at": [last]})
            return
        newest = max(int(f["received_at"].max()) for f in frames)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({"stream": pd.Series([], dtype="object"), "last_received_at": pd.Series([], dtype="int64")})

    return stream.select("stream", "received_at").groupBy("stream").applyInPandasWithState(
        step, "stream string, last_received_at long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def quality_windows(stream: DataFrame, width: str = "10 minutes", delay: str = "2 hours") -> DataFrame:
    """Watermarked tumbling counts of quality status per stream."""
    timed = stream.withColumn("event_time", F.timestamp_millis("received_at")).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", width), "stream", F.col("quality.status").alias("status")).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("window.start").alias("window_start"), "stream", "status", "events")


LEGS = ("token", "perp", "listed", "equity")


def live_legs(quotes: DataFrame, out: str, checkpoint: str, bucket_ms: int):
    """A writer that appends, per batch, the latest quote of each (snapshot, ticker, leg) among the batch's quotes.

    The batch id is a directory of the sink, and a retried batch overwrites its own directory. What a leg was in
    earlier batches stays in theirs: the newest over all batches is the leg's quote, however many batches there were.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        latest = F.max_by(F.struct("ts", "event_id", "symbol", "bid", "ask", "last", "k"), F.struct("ts", "event_id"))
        snap = ((F.floor(F.col("ts") / bucket_ms) + 1) * bucket_ms).alias("snap_ts")
        batch.groupBy(snap, "ticker", "leg").agg(latest.alias("q")).select("snap_ts", "ticker", "leg", "q.*").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return quotes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def live_peg(spark: SparkSession, out: str, triple_listed: list[str]) -> DataFrame:
    """Peg rows of all snapshots from the legs recorded so far, one per (snapshot, ticker)."""
    return G.derive(snapshot_legs(spark.read.option("basePath", out).parquet(out), triple_listed))


def snapshot_legs(legs: DataFrame, triple_listed: list[str]) -> DataFrame:
    """Latest quote of each leg per snapshot and ticker, legs side by side."""
    from ..functions import pricing as P
    at = F.struct("ts", "event_id")
    rec = F.struct("symbol", "bid", "ask", "last", "k")
    cells = legs.groupBy("snap_ts", "ticker").agg(*[F.max_by(rec, F.when(F.col("leg") == leg, at)).alias(leg) for leg in LEGS])
    mid = lambda leg: P.mid(F.col(f"{leg}.bid"), F.col(f"{leg}.ask"), F.col(f"{leg}.last")).alias(f"{leg}_mid")
    return cells.select("snap_ts", "ticker", F.col("token.symbol").alias("token_symbol"), mid("token"), (F.col("token.k") % 3).alias("token_levels"), mid("perp"), mid("listed"),
                        F.col("equity.last").alias("equity_price"), F.lit(None).cast("string").alias("market_state"), F.col("ticker").isin(*triple_listed).alias("triple_listed"))


def forward_split(sessions: DataFrame, freeze_day: str, date: str = "date") -> DataFrame:
    """Label sessions after the freeze day as forward, the rest as in-sample replay."""
    return sessions.withColumn("mode", F.when(F.col(date) > freeze_day, "forward").otherwise("replay"))


def run_available(query_writer, out: str) -> None:
    """Run a stream over everything that is there, then stop."""
    q = query_writer.trigger(availableNow=True).start(out) if out else query_writer.trigger(availableNow=True).start()
    q.awaitTermination()
