"""Queries that run bounded streams over the whole event table and read back their sinks."""
from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import platform as PL
from ..session import cut_lineage, shared_dir
from ..sources import adapters as A
from ..streaming import flows as FL
from . import sqlbase as Q
from .core import query
from .market import ASSESS, SEQ, policies


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Landing files come in slices of time with as many rows each, written one after the other, and in so many files a
#: trigger. There are so many slices at least, and no more rows in one than this: what is pending does not grow with the table.
SLICES, SLICE_ROWS, FILES = 5, 2_000_000, 64
#: Rows of a chunk of event time, which is released at once, where they come evenly.
CHUNK_ROWS = 50_000


class Landing(NamedTuple):
    stream: DataFrame
    delay: str
    chunk_ms: int


def landed(spark, sf, df, name, at="received_at", key="stream", margin=60_000):
    """Write the adapter's rows as landing files in slices of time, then read them as a stream.

    No row exceeds the ``delay``: within a slice files come in any order. A last row, one delay, a ``margin`` and two
    chunks newer than all others, ends the replay. The rows are recorded in ranges of time, so that each slice reads its own part.
    """
    path = folder(spark, f"landing-{name}")
    rows = cut_lineage(df.repartitionByRange(at))
    n, low, high = rows.agg(F.count(at), F.min(at), F.max(at)).first()
    count = max(SLICES, -(-n // SLICE_ROWS))
    cuts = rows.agg(F.percentile_approx(at, [i / count for i in range(1, count)], 100 * count)).first()[0] if count > 1 else []
    edges = sorted({low - 1, high, *cuts})
    for before, last in zip(edges, edges[1:]):
        # the files of a trigger hold one slice's rows at most
        rows.filter((F.col(at) > before) & (F.col(at) <= last)).write.mode("append").option("maxRecordsPerFile", max(1, SLICE_ROWS // FILES)).parquet(path)
    delay = max([b - a for a, b in zip(edges, edges[2:])] or [high - low + 1])
    chunk = max(1000, delay // max(8, 2 * n // count // CHUNK_ROWS))
    end = spark.range(1).select(*[F.lit("~").alias(f.name) if f.name == key else F.lit(high + delay + margin + 2 * chunk if f.name == at else None).cast(f.dataType).alias(f.name) for f in df.schema])
    end.write.mode("append").parquet(path)
    return Landing(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path), f"{delay} milliseconds", chunk)


def drained(spark, stream, name):
    """Drain a stream into parquet and read it back."""
    out = folder(spark, f"sink-{name}")
    FL.run_available(stream.writeStream.format("parquet").option("checkpointLocation", folder(spark, f"checkpoint-{name}")), out)
    return spark.read.parquet(out)


def prov_events(spark, sf):
    return FL.stream_key(A.events_prov(spark, sf).withColumn("backfill", F.lit(False)))


@query("stream_continuity", Q.with_(Q.EVENTS_PROV, SEQ) + " SELECT event_id, sequence, sequence_status AS status, expected_sequence FROM seq")
def _(spark, sf):
    land = landed(spark, sf, prov_events(spark, sf), "prov")
    return drained(spark, FL.continuity(land.stream, land.delay, chunk_ms=land.chunk_ms), "continuity").select("event_id", "sequence", "status", "expected_sequence")


@query("stream_gap_feed", Q.with_(Q.EVENTS_PROV, SEQ) + """ SELECT event_id, expected_sequence AS expected, sequence AS actual,
  'sequence_' || sequence_status AS reason FROM seq WHERE sequence_status IN ('gap', 'regression')""")
def _(spark, sf):
    land = landed(spark, sf, prov_events(spark, sf), "prov")
    return FL.gap_feed(drained(spark, FL.continuity(land.stream, land.delay, chunk_ms=land.chunk_ms), "gaps")).drop("stream")


@query("stream_backfill", Q.with_(Q.EVENTS_PROV) + """, marked AS (SELECT *, sequence % 8 = 3 AS backfill FROM prov), live AS (
  SELECT event_id, max(sequence) OVER (PARTITION BY source, kind, instrument ORDER BY received_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM marked WHERE NOT backfill)
  SELECT event_id, CASE WHEN backfill THEN 'backfill' WHEN prior IS NULL THEN 'first' WHEN sequence <= prior THEN 'regression' WHEN sequence = prior + 1 THEN 'contiguous' ELSE 'gap' END AS status
  FROM marked LEFT JOIN live USING (event_id)""")
def _(spark, sf):
    """Records with every eighth sequence recovered instead of live: they pass without moving the state."""
    e = FL.stream_key(A.events_prov(spark, sf))
    recovered = F.col("sequence") % 8 == 3
    land = landed(spark, sf, FL.with_backfill(e.filter(~recovered), e.filter(recovered)), "backfill")
    return drained(spark, FL.continuity(land.stream, land.delay, chunk_ms=land.chunk_ms), "backfilled").select("event_id", "status")


CARRIED = "struct<source:string,kind:string,effective_at:bigint,payload:struct<bid:double,ask:double,last:double>>"


def assessed_stream(spark, sf):
    """Streaming quality of events whose sequence status comes from the stream's own continuity."""
    body = F.to_json(F.struct("source", "kind", "effective_at", "payload")).alias("body")
    land = landed(spark, sf, prov_events(spark, sf).select("stream", "event_id", "sequence", "received_at", "backfill", body), "quality")
    checked = FL.continuity(land.stream, land.delay, "body", land.chunk_ms).withColumn("b", F.from_json("body", CARRIED)).select("stream", "event_id", "received_at", F.col("status").alias("sequence_status"), "b.*")
    return FL.stream_quality(checked, policies(spark), F.col("sequence_status"))


@query("stream_quality", Q.with_(Q.EVENTS_PROV, ASSESS) + " SELECT event_id, status, round(score, 6) AS score FROM assessed")
def _(spark, sf):
    return drained(spark, assessed_stream(spark, sf).select("event_id", "quality.status", F.round("quality.score", 6).alias("score")), "quality")


@query("stream_dedup", Q.with_(Q.EVENTS_PROV) + " SELECT event_id, received_at FROM prov")
def _(spark, sf):
    e = FL.stream_key(A.events_prov(spark, sf)).drop("payload")
    twice = e.unionByName(e.filter(F.col("sequence") % 8 == 0))
    stream, delay, _ = landed(spark, sf, twice, "dedup")
    return drained(spark, FL.dedup_events(stream, delay), "dedup").filter("event_id IS NOT NULL").select("event_id", "received_at")


BURST, BURST_MS, LOCKOUT_MS, QUIET_MS = 3, 3_600_000, 600_000, 7_200_000


@query("stream_bursts", f"""WITH RECURSIVE {Q.TICKS}, ordered AS (
  SELECT ticker AS key, CAST(event_id AS VARCHAR) AS event_id, ts AS at, row_number() OVER (PARTITION BY ticker ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM ticks), walked AS (
  SELECT key, 0::BIGINT AS n, NULL::VARCHAR AS event_id, []::BIGINT[] AS times, 0::BIGINT AS locked, false AS allowed, 0::BIGINT AS retry_after_ms FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.key, o.n, o.event_id, CASE WHEN w.locked <= o.at AND len(list_filter(w.times, lambda t: o.at - t < {BURST_MS})) < {BURST}
      THEN list_append(list_filter(w.times, lambda t: o.at - t < {BURST_MS}), o.at) ELSE list_filter(w.times, lambda t: o.at - t < {BURST_MS}) END,
    CASE WHEN w.locked > o.at THEN w.locked WHEN len(list_filter(w.times, lambda t: o.at - t < {BURST_MS})) >= {BURST} THEN o.at + {LOCKOUT_MS} ELSE 0 END,
    w.locked <= o.at AND len(list_filter(w.times, lambda t: o.at - t < {BURST_MS})) < {BURST},
    CASE WHEN w.locked > o.at THEN w.locked - o.at WHEN len(list_filter(w.times, lambda t: o.at - t < {BURST_MS})) >= {BURST}
      THEN greatest(1, {BURST_MS} - (o.at - list_min(list_filter(w.times, lambda t: o.at - t < {BURST_MS}))), {LOCKOUT_MS}) ELSE 0 END
  FROM walked w JOIN ordered o ON o.key = w.key AND o.n = w.n + 1)
  SELECT key, event_id, allowed, retry_after_ms FROM walked WHERE n > 0""")
def _(spark, sf):
    t = A.ticks(spark, sf).select(F.col("ticker").alias("key"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("at"))
    land = landed(spark, sf, t, "bursts", "at", "key")
    return drained(spark, FL.burst_limit(land.stream, BURST, BURST_MS, LOCKOUT_MS, land.delay, land.chunk_ms), "bursts").select("key", "event_id", "allowed", "retry_after_ms")


@query("stream_silences", Q.with_(Q.EVENTS_PROV) + f""", ahead AS (
  SELECT source || '|' || kind || '|' || coalesce(instrument, '_') AS stream, received_at,
         lead(received_at) OVER (PARTITION BY source, kind, instrument ORDER BY received_at, event_id) AS following FROM prov)
  SELECT stream, received_at AS last_received_at, received_at + {QUIET_MS} AS silent_at FROM ahead WHERE following IS NULL OR following - received_at > {QUIET_MS}""")
def _(spark, sf):
    """Silences of every stream, the last one told by a timer alone: its stream sends nothing more."""
    e = prov_events(spark, sf).select("stream", "event_id", "received_at")
    land = landed(spark, sf, e, "silences", margin=QUIET_MS)
    return drained(spark, FL.silences(land.stream, QUIET_MS, land.delay, land.chunk_ms), "silences")


@query("stream_quality_windows", Q.with_(Q.EVENTS_PROV, ASSESS) + """ SELECT received_at // 86400000 AS day, source || '|' || kind || '|' || instrument AS stream,
  CASE WHEN content IN ('no_positive_price', 'crossed_quote', 'invalid_equity_price') THEN 'quarantined'
  WHEN reliability IS NULL OR stale OR content = 'one_sided_quote' THEN 'degraded' ELSE 'valid' END AS status, count(*) AS events FROM assessed GROUP BY ALL""")
def _(spark, sf):
    stream, delay, _ = landed(spark, sf, prov_events(spark, sf), "windows", margin=2 * A.DAY_MS)
    w = drained(spark, FL.quality_windows(FL.stream_quality(stream, policies(spark)), "1 day", delay), "windows").filter("stream <> '~'")
    return w.select(F.floor(F.unix_millis("window_start") / A.DAY_MS).alias("day"), "stream", "status", "events")


@query("live_peg", Q.with_(Q.PEG) + " SELECT snap_ts, ticker, token_mid, premium_pct, true_gap_pct FROM peg", "token_mid premium_pct true_gap_pct", 10)
def _(spark, sf):
    path, out = folder(spark, "landing-quotes"), folder(spark, "sink-peg")
    q = A.quotes(spark, sf)
    q.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", max(1, FILES // 16)).parquet(path)
    FL.run_available(FL.live_legs(stream, out, folder(spark, "checkpoint-peg"), A.SNAPSHOT_MS), "")
    return FL.live_peg(spark, out, list(A.TRIPLE_LISTED)).select("snap_ts", "ticker", "token_mid", "premium_pct", "true_gap_pct")


@query("forward_sessions", """SELECT CASE WHEN strftime(o_orderdate, '%Y-%m-%d') > '1999-12-31' THEN 'forward' ELSE 'replay' END AS mode, count(*) AS orders FROM orders GROUP BY 1""")
def _(spark, sf):
    o = A.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return FL.forward_split(o, "1999-12-31").groupBy("mode").agg(F.count(F.lit(1)).alias("orders"))


@query("stored_replay", Q.with_(Q.EVENTS_PROV) + """ SELECT event_id, effective_at, received_at FROM prov WHERE received_at <= 1705276800000 AND kind IN ('market.quote', 'equity.quote')""")
def _(spark, sf):
    """Append in two rounds with overlap, then replay from the partitioned store."""
    from ..sources.readers import append_events, load_events
    e = PL.identity_hash(A.events_prov(spark, sf)).withColumn("quality", F.struct(F.lit("valid").alias("status")))
    store = folder(spark, "store")
    half = F.col("sequence") % 16 < 8
    append_events(e.filter(half), store)
    planned = PL.plan_append(load_events(spark, store).select("event_id", "identity"), e)
    append_events(PL.to_append(planned), store)
    return PL.replay(load_events(spark, store), A.EPOCH_2024 + 14 * A.DAY_MS, ["market.quote", "equity.quote"]).select("event_id", "effective_at", "received_at")
