"""Queries of the composite jobs that no other module holds."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock as K
from ..plans import jobs as J
from ..sources import adapters as A
from . import sqlbase as Q
from .core import query
from .history import CLAIR, HALF_LIFE, PERP_WALK, WALK

PARTS = ", ".join([
    WALK, PERP_WALK.split(", dev AS", 1)[1].join(["dev AS", ""]), CLAIR.split(", best AS", 1)[1].join(["best AS", ""]), HALF_LIFE]) + """, cap AS (
  SELECT instrument, count(*) AS events, count(*) FILTER (later < a) AS captured, avg(a - later) AS nar FROM (SELECT instrument, abs(premium_pct) AS a, abs(lead(premium_pct, 6) OVER (PARTITION BY instrument ORDER BY ts)) AS later FROM premium) WHERE later IS NOT NULL AND a >= 0.5 GROUP BY instrument), trk AS (
  SELECT instrument, coalesce((1 - avg(abs(perp_close - f)) / nullif(avg(abs(token_close - f)), 0)) * 100, 0) AS imp FROM (SELECT *, lead(token_close, 6) OVER (PARTITION BY instrument ORDER BY ts) AS f FROM premium) WHERE f IS NOT NULL GROUP BY instrument), bas AS (
  SELECT instrument, count(*) AS trades, count(*) FILTER (gross - 0.5 > 0) AS wins, count(*) FILTER (NOT gross - 0.5 > 0) AS losses, count(*) FILTER (forced) AS forced_exits, sum(gross - 0.5) AS pnl, avg(held) AS hold FROM walk WHERE gross IS NOT NULL GROUP BY instrument), pcap AS (
  SELECT instrument, count(*) AS events, count(*) FILTER (later < a) AS captured FROM (SELECT instrument, abs(d) AS a, abs(lead(d, 6) OVER (PARTITION BY instrument ORDER BY idx)) AS later FROM dev) WHERE later IS NOT NULL AND a >= 0.5 GROUP BY instrument), pbt AS (
  SELECT instrument, count(*) AS trades, count(*) FILTER (gross - 0.12 > 0) AS wins, sum(gross - 0.12) AS pnl FROM pwalk WHERE gross IS NOT NULL GROUP BY instrument), cl AS (
  SELECT instrument, max(n) AS opportunities, max_by(pnl, r) AS max_pnl FROM cwalk GROUP BY instrument), report AS (
  SELECT i.instrument, i.points, coalesce(cap.events, 0) AS events, coalesce(cap.captured, 0) AS captured, coalesce(cap.nar, 0) AS avg_narrowing_pct, trk.imp AS tracking_improvement_pct, coalesce(bas.trades, 0) AS trades, coalesce(bas.wins, 0) AS wins, coalesce(bas.losses, 0) AS losses,
    coalesce(bas.forced_exits, 0) AS forced_exits, coalesce(bas.pnl, 0) AS total_pnl_pct, coalesce(bas.hold, 0) AS avg_hold_bars, coalesce(pcap.events, 0) AS perp_events, coalesce(pcap.captured, 0) AS perp_captured, coalesce(pbt.trades, 0) AS perp_trades, coalesce(pbt.wins, 0) AS perp_wins, coalesce(pbt.pnl, 0) AS perp_pnl_pct,
    coalesce(cl.opportunities, 0) AS opportunities, coalesce(cl.max_pnl, 0) AS max_pnl_pct, CASE WHEN hl.slope > 0 AND hl.slope < 1 THEN -ln(2.0) / ln(hl.slope) END AS half_life_bars
  FROM (SELECT instrument, count(*) AS points FROM premium GROUP BY instrument HAVING count(*) >= 50) i LEFT JOIN cap USING (instrument) LEFT JOIN trk USING (instrument) LEFT JOIN bas USING (instrument) LEFT JOIN pcap USING (instrument) LEFT JOIN pbt USING (instrument) LEFT JOIN cl USING (instrument) LEFT JOIN hl USING (instrument))"""
FLOATS = "avg_narrowing_pct tracking_improvement_pct total_pnl_pct avg_hold_bars perp_pnl_pct max_pnl_pct half_life_bars"


@query("history_report", "WITH RECURSIVE " + PARTS + " SELECT * FROM report", FLOATS)
def _(spark, sf):
    return J.history_report(A.premium(spark, sf))


@query("history_pool", "WITH RECURSIVE " + PARTS + """
  SELECT count(*) AS pairs, sum(points)::BIGINT AS observations, sum(events)::BIGINT AS events, sum(captured)::BIGINT AS captured, sum(captured) / sum(events) * 100 AS capture_rate_pct, sum(avg_narrowing_pct * events) / sum(events) AS avg_narrowing_pct, avg(tracking_improvement_pct) AS mean_improvement_pct,
    count(*) FILTER (tracking_improvement_pct > 0) AS pairs_positive, sum(trades)::BIGINT AS trades, sum(wins) / sum(trades) * 100 AS win_rate_pct, sum(total_pnl_pct) AS total_pnl_pct, sum(losses)::BIGINT AS losses, sum(forced_exits)::BIGINT AS forced_exits, sum(avg_hold_bars * trades) / sum(trades) AS avg_hold_bars,
    sum(perp_trades)::BIGINT AS perp_trades, sum(perp_pnl_pct) AS perp_pnl_pct, sum(opportunities)::BIGINT AS opportunities, sum(max_pnl_pct) AS max_pnl_pct, sum(total_pnl_pct) / sum(max_pnl_pct) * 100 AS captured_pct_of_max, median(half_life_bars) AS median_half_life_bars FROM report""",
       "capture_rate_pct avg_narrowing_pct mean_improvement_pct win_rate_pct total_pnl_pct avg_hold_bars perp_pnl_pct max_pnl_pct captured_pct_of_max median_half_life_bars", 5)
def _(spark, sf):
    return J.history_pool(J.history_report(A.premium(spark, sf)))


@query("half_life_split", "WITH RECURSIVE " + PARTS + """, md AS (SELECT median(half_life_bars) AS m FROM report)
  SELECT CASE WHEN coalesce(half_life_bars <= m, false) THEN 'fast' ELSE 'slow' END AS speed, count(*) AS pairs, sum(trades)::BIGINT AS trades, sum(wins)::BIGINT AS wins, sum(total_pnl_pct) AS total_pnl_pct FROM report, md GROUP BY 1""", "total_pnl_pct")
def _(spark, sf):
    return J.half_life_split(J.history_report(A.premium(spark, sf)))


@query("regime_capture", Q.with_(Q.PEG) + """, ah AS (SELECT *, abs(premium_pct) AS a, abs(lead(premium_pct, 6) OVER (PARTITION BY ticker ORDER BY snap_ts)) AS later FROM peg WHERE premium_pct IS NOT NULL), ph AS (
  SELECT *, (snap_ts - 18000000) // 60000 % 1440 AS m, dayofweek(make_timestamp((snap_ts - 18000000) * 1000)) AS wd, CAST(make_timestamp((snap_ts - 18000000) * 1000) AS DATE) AS d FROM ah WHERE later IS NOT NULL AND a >= 0.5)
  SELECT CASE WHEN wd IN (0, 6) THEN 'WEEKEND' WHEN d IN (DATE '2024-01-01', DATE '2024-01-15') THEN 'HOLIDAY' WHEN m >= 570 AND m < 960 THEN 'STAND_DOWN' WHEN m >= 960 AND m < 1200 THEN 'EARNINGS_SPRINT' WHEN m >= 1200 OR m < 240 THEN 'OVERNIGHT' ELSE 'PRE_OPEN' END AS phase,
    count(*) AS events, count(*) FILTER (later < a) AS captured FROM ph GROUP BY 1""")
def _(spark, sf):
    p = A.peg(spark, sf).filter(F.col("premium_pct").isNotNull()).select(F.col("ticker").alias("instrument"), F.col("snap_ts").alias("ts"), "premium_pct")
    return J.regime_capture(p, K.exchange_calendar(spark, "2023-12-01", "2024-03-01"))
