"""Composite jobs: each joins operators into one report a user calls."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock as K
from ..functions import execution as X
from ..functions import pricing as P
from ..operators import backtests as B
from ..operators import series as S
from ..operators.ordered import with_row
from ..operators.verdicts import first_price_after


def calibration(books: DataFrame, notionals: Sequence[float] = (100.0, 500.0, 2000.0)) -> DataFrame:
    """Quote-model fills against book sweeps, by liquidity tier: error, coverage and shortfall.

    ``books``: symbol, bid, ask, bid_size, ask_size, bids, asks. Symbols without both touches are left out.
    """
    rows = books.filter((F.col("bid") > 0) & (F.col("ask") > 0)).withColumn("tier", P.liquidity_tier(F.col("bids"), F.col("asks")))
    cases = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(float(n)).alias("notional")) for s in ("buy", "sell") for n in notionals])
    rows = rows.withColumn("c", F.explode(cases)).withColumn("touch", F.when(F.col("c.side") == "buy", F.col("ask")).otherwise(F.col("bid")))
    rows = rows.withColumn("want", F.col("c.notional") / F.col("touch"))
    rows = rows.withColumn("q", X.quote_fill(F.col("c.side"), F.col("want"), F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size")))
    rows = rows.withColumn("d", X.book_sweep(F.col("c.side"), F.col("want"), F.col("bids"), F.col("asks")))
    err = F.abs(F.col("q.avg_price") - F.col("d.avg_price")) / F.col("d.avg_price") * 10_000
    cost = X.implementation_shortfall(F.col("c.side"), F.col("d.fill_qty"), F.col("touch"), F.col("touch"), F.col("d.avg_price"),
                                      F.col("d.fill_qty") * F.col("d.avg_price") * 0.001)
    agg = rows.groupBy("tier").agg(
        F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("cases"), F.avg(err).alias("mean_price_error_bps"), F.max(err).alias("max_price_error_bps"),
        F.avg(F.col("q.fill_qty") / F.col("want") * 100).alias("mean_predicted_coverage_pct"), F.avg(F.col("d.fill_qty") / F.col("want") * 100).alias("mean_depth_coverage_pct"),
        F.avg(cost["total_bps"]).alias("mean_depth_shortfall_bps"))
    tiers = books.sparkSession.createDataFrame([(t,) for t in "ABCD"], "tier string")
    return F.broadcast(tiers).join(agg, "tier", "left").fillna(0, ["symbols", "cases"])


def latency_sweep(orders: DataFrame, prices: DataFrame, latencies: Sequence[int], tick: float = 0.01, seed: int = 42) -> DataFrame:
    """Mean fill and slippage cost of the same orders at several latencies.

    ``orders``: intent_id, ticker, ts, side; ``prices``: ticker, ts, event_id, last.
    """
    rows = orders.withColumn("latency_ms", F.explode(F.array(*[F.lit(x).cast("long") for x in latencies])))
    rows = rows.withColumn("arrival", X.arrival_ts(F.col("ts"), 0, 0) + F.col("latency_ms"))
    at_submit = first_price_after(orders.select("intent_id", "ticker", "ts"), prices, ["ticker"], "ts", "ts", "last", tie=["event_id"]).select(
        "intent_id", F.col("fill_price").alias("submit_price"))
    filled = first_price_after(rows, prices, ["ticker"], "arrival", "ts", "last", tie=["event_id"]).join(at_submit, "intent_id")
    raw = X.quantize_tick(F.col("fill_price"), tick)
    slipped = X.seeded_slippage(raw, F.col("side"), F.lit(seed) + F.col("latency_ms") + F.col("intent_id"), tick, 0.5, 3)
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return filled.groupBy("latency_ms").agg(
        F.count(F.lit(1)).alias("orders"), F.avg(raw).alias("raw_fill"), F.avg(slipped).alias("slipped_fill"),
        F.avg(sign * (slipped - F.col("submit_price"))).alias("slippage_cost"))


def regime_capture(series: DataFrame, calendar: DataFrame, stretch: float = 0.5, horizon: int = 6) -> DataFrame:
    """Capture by trading phase of the stretched bar."""
    ahead = S.over_series(series, 0, horizon, lambda w: {"__later": F.abs(F.lead("premium_pct", horizon).over(w))})
    now = F.abs("premium_pct")
    hits = K.session_phase(ahead.filter(F.col("__later").isNotNull() & (now >= stretch)), calendar)
    return hits.groupBy("phase").agg(F.count(F.lit(1)).alias("events"), F.sum(F.when(F.col("__later") < now, 1).otherwise(0)).alias("captured"))


def history_report(premium: DataFrame, stretch: float = 0.5, horizon: int = 6, entry: float = 1.0, exit_: float = 0.3, fee: float = 0.5,
                   perp_fee: float = 0.12, max_hold: int = 48, min_points: int = 50) -> DataFrame:
    """Per-instrument figures of the history study: capture, tracking, both backtests, bound, half-life.

    Every part is one row per instrument; the parts meet on that key. Pool with ``history_pool``.
    """
    sizes = premium.groupBy("instrument").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") >= min_points)
    perp = premium.select("instrument", "ts", "perp_close", ((F.col("perp_close") - F.col("token_close")) / F.col("token_close") * 100).alias("deviation_pct"))
    cap = S.capture(premium, stretch, horizon).select("instrument", "events", "captured", "avg_narrowing_pct")
    trk = S.peg_tracking(premium, horizon).select("instrument", F.col("improvement_pct").alias("tracking_improvement_pct"))
    basis = B.basis_summary(B.basis_trades(premium, entry, exit_, max_hold), fee).select(
        "instrument", "trades", "wins", "losses", "forced_exits", "total_pnl_pct", "avg_hold_bars")
    pc = S.capture(perp, stretch, horizon, value="deviation_pct").select("instrument", F.col("events").alias("perp_events"), F.col("captured").alias("perp_captured"))
    pb = B.basis_summary(B.perp_trades(perp, entry, exit_), perp_fee).select("instrument", F.col("trades").alias("perp_trades"), F.col("wins").alias("perp_wins"), F.col("total_pnl_pct").alias("perp_pnl_pct"))
    bound = B.clairvoyant(premium, entry, fee, max_hold)
    hl = S.half_life(premium).select("instrument", "half_life_bars")
    out = sizes
    for part in (cap, trk, basis, pc, pb, bound, hl):
        out = out.join(part, "instrument", "left")
    return out.fillna(0, [c for c in out.columns if c not in ("instrument", "half_life_bars", "tracking_improvement_pct")])


def history_pool(report: DataFrame) -> DataFrame:
    """Pooled figures: rates from raw counts, hold times weighted by trades."""
    s = F.sum
    pct = lambda a, b: F.coalesce(F.when(s(b) > 0, s(a) / s(b) * 100), F.lit(0.0))
    return report.agg(
        F.count(F.lit(1)).alias("pairs"), s("points").alias("observations"), s("events").alias("events"), s("captured").alias("captured"),
        pct("captured", "events").alias("capture_rate_pct"), F.coalesce(F.when(s("events") > 0, s(F.col("avg_narrowing_pct") * F.col("events")) / s("events")), F.lit(0.0)).alias("avg_narrowing_pct"),
        F.avg("tracking_improvement_pct").alias("mean_improvement_pct"), s(F.when(F.col("tracking_improvement_pct") > 0, 1).otherwise(0)).alias("pairs_positive"),
        s("trades").alias("trades"), pct("wins", "trades").alias("win_rate_pct"), s("total_pnl_pct").alias("total_pnl_pct"), s("losses").alias("losses"),
        s("forced_exits").alias("forced_exits"), F.coalesce(F.when(s("trades") > 0, s(F.col("avg_hold_bars") * F.col("trades")) / s("trades")), F.lit(0.0)).alias("avg_hold_bars"),
        s("perp_trades").alias("perp_trades"), s("perp_pnl_pct").alias("perp_pnl_pct"), s("opportunities").alias("opportunities"), s("max_pnl_pct").alias("max_pnl_pct"),
        pct("total_pnl_pct", "max_pnl_pct").alias("captured_pct_of_max"), F.median("half_life_bars").alias("median_half_life_bars"))


def half_life_split(report: DataFrame) -> DataFrame:
    """Basis results of the fast and the slow instruments, split at the median half-life."""
    median = report.agg(F.median("half_life_bars").alias("m"))
    fast = F.coalesce(F.col("half_life_bars") <= F.col("m"), F.lit(False))
    return with_row(report, median).groupBy(F.when(fast, "fast").otherwise("slow").alias("speed")).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("trades").alias("trades"), F.sum("wins").alias("wins"), F.sum("total_pnl_pct").alias("total_pnl_pct"))
