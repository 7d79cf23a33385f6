"""Ordered trade folds over premium series, cut into independent parts.

Trades of bounded length are walked in chunks of bars (``intervals``). Perp trades have no time stop; there every bar
inside the exit band leaves the state flat, so those bars cut a series into episodes of one aggregation each.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I

KEYS = ("instrument",)


def episodes(series: DataFrame, value: str, exit_pct: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number the bars and the episodes of each series."""
    w = Window.partitionBy(*keys).orderBy("ts")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    resets = F.sum(F.when(F.abs(F.col(value)) <= exit_pct, 1).otherwise(0)).over(before)
    return series.select("*", (F.row_number().over(w) - 1).cast("long").alias("idx"),
                         F.coalesce(resets, F.lit(0)).cast("long").alias("episode"))


def basis_trades(series: DataFrame, entry: float = 1.0, exit_: float = 0.3, max_hold: int = 48,
                 value: str = "premium_pct", keys: Sequence[str] = KEYS, chunk_bars: int = I.CHUNK_BARS, group: int = I.GROUP) -> DataFrame:
    """One position at a time: enter beyond ``entry``, leave inside ``exit_``, after ``max_hold`` bars,
    or at the end of the series. Gross PnL in premium points per trade.

    The trade that each stretched bar would open ends at most ``max_hold`` bars later, whatever was open before; the
    walk over these trades is cut into chunks (``intervals``), also where a series never comes back inside the band.
    """
    if not entry > exit_:
        raise ValueError("entry must exceed exit")

    def trade(x: Column, k: Column, bars: Column) -> Column:
        side = F.when(x["p"] < 0, 1).otherwise(-1)
        back = F.get(F.filter(F.slice(bars, k + 2, max_hold), lambda b: F.when(x["p"] < 0, b["p"] >= -exit_).otherwise(b["p"] <= exit_)), F.lit(0))
        last = F.coalesce(back, F.get(bars, F.least(k + max_hold, F.size(bars) - 1)))
        gross = F.when(x["p"] < 0, last["p"] - x["p"]).otherwise(x["p"] - last["p"])
        return F.when(F.abs(x["p"]) >= entry, F.struct(x["i"].alias("i"), last["i"].alias("j"), side.alias("side"), gross.alias("gross_pct"), back.isNull().alias("forced")))

    chunks = I.bar_chunks(series, keys, "ts", value, max_hold, chunk_bars)
    taken = I.choose(chunks, keys, trade, max_hold, chunk_bars, group).select(*keys, F.explode("taken").alias("t"))
    return taken.select(*keys, F.col("t.i").alias("entry_idx"), F.col("t.j").alias("exit_idx"), "t.side", "t.gross_pct", "t.forced")


def basis_summary(trades: DataFrame, fee: float = 0.5, by: Sequence[str] = KEYS) -> DataFrame:
    net = F.col("gross_pct") - fee
    n = F.count(F.lit(1))
    return trades.groupBy(*by).agg(
        n.alias("trades"), F.sum(F.when(net > 0, 1).otherwise(0)).alias("wins"),
        F.sum(F.when(net > 0, 0).otherwise(1)).alias("losses"),
        F.sum(F.when(F.col("forced"), 1).otherwise(0)).alias("forced_exits"),
        (F.sum(F.when(net > 0, 1.0).otherwise(0.0)) / n * 100).alias("win_rate_pct"),
        F.sum(net).alias("total_pnl_pct"), F.avg(net).alias("avg_pnl_pct"),
        F.avg(F.col("exit_idx") - F.col("entry_idx")).alias("avg_hold_bars"))


def cost_sweep(trades: DataFrame, fees: Sequence[float] = (0.3, 0.5, 0.8)) -> DataFrame:
    """Win rate and PnL at several fees. Entry and exit do not depend on the fee, so trades are re-priced."""
    priced = trades.select("gross_pct", F.explode(F.array(*[F.lit(f) for f in fees])).alias("fee_pct"))
    net = F.col("gross_pct") - F.col("fee_pct")
    return priced.groupBy("fee_pct").agg(
        F.count(F.lit(1)).alias("trades"), F.avg(F.when(net > 0, 100.0).otherwise(0.0)).alias("win_rate_pct"),
        F.sum(net).alias("total_pnl_pct"))


def perp_trades(series: DataFrame, entry: float = 1.0, exit_: float = 0.3, value: str = "deviation_pct",
                price: str = "perp_close", keys: Sequence[str] = KEYS) -> DataFrame:
    """Single-leg trades toward fair value. A position opens at the first stretched bar of an episode
    and closes at the bar that ends it; an episode without such a bar keeps its position open and
    yields no trade. So each episode is one aggregation."""
    if not entry > exit_:
        raise ValueError("entry must exceed exit")
    rows = episodes(series, value, exit_, keys)
    stretched = F.abs(F.col(value)) >= entry
    bar = F.struct(F.col("idx").alias("i"), F.col(price).alias("px"), F.col(value).alias("d"))
    agg = rows.groupBy(*keys, "episode").agg(
        F.min_by(bar, F.when(stretched, F.col("idx"))).alias("a"),
        F.max_by(bar, F.when(F.abs(F.col(value)) <= exit_, F.col("idx"))).alias("b"))
    done = agg.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    move = (F.col("b.px") - F.col("a.px")) / F.col("a.px") * 100
    long_side = F.col("a.d") < 0
    return done.select(*keys, F.col("a.i").alias("entry_idx"), F.col("b.i").alias("exit_idx"),
                       F.when(long_side, 1).otherwise(-1).alias("side"),
                       F.when(long_side, move).otherwise(-move).alias("gross_pct"), F.lit(False).alias("forced"))


def clairvoyant(series: DataFrame, entry: float = 1.0, fee: float = 0.5, max_hold: int = 48,
                value: str = "premium_pct", keys: Sequence[str] = KEYS, chunk_bars: int = I.CHUNK_BARS, group: int = I.GROUP) -> DataFrame:
    """Perfect-hindsight bound: at each stretched bar the best exit within the hold window, never
    overlapping. Only bars with a profitable exit are walked over, in chunks; a chunk leaves its count and sum."""
    def jump(x: Column, k: Column, bars: Column) -> Column:
        best = F.array_min(F.transform(F.slice(bars, k + 2, max_hold), lambda b: F.struct(F.abs(b["p"]).alias("p"), b["i"].alias("i"))))
        net = F.abs(x["p"]) - best["p"] - fee
        return F.when((F.abs(x["p"]) >= entry) & (net > 0), F.struct(x["i"].alias("i"), best["i"].alias("j"), net.alias("net")))

    chunks = I.bar_chunks(series, keys, "ts", value, max_hold, chunk_bars)
    taken = I.choose(chunks, keys, jump, max_hold, chunk_bars, group)
    # a key with jumps always takes its first one
    return taken.select(*keys, F.size("taken").cast("long").alias("n"), F.aggregate("taken", F.lit(0.0), lambda acc, x: acc + x["net"]).alias("pnl")).groupBy(*keys).agg(
        F.sum("n").alias("opportunities"), F.sum("pnl").alias("max_pnl_pct")).filter("opportunities > 0")
