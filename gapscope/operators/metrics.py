"""Tracking quality, risk-adjusted performance and calibration aggregates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, ratio
from .ordered import running
from .series import over_series


def tracking_error(aligned: DataFrame) -> DataFrame:
    """Level gap and return correlation of a token against its stock, one row per day."""
    rows = over_series(aligned, 1, 0, lambda w: {
        "__tr": (F.col("token_close") - F.lag("token_close").over(w)) / F.lag("token_close").over(w),
        "__er": (F.col("equity_close") - F.lag("equity_close").over(w)) / F.lag("equity_close").over(w)}, order="day")
    prem = (F.col("token_close") - F.col("equity_close")) / F.col("equity_close") * 100
    # corr() raises on a flat series in ANSI mode, so the coefficient is built from its parts.
    spread = F.stddev_pop("__tr") * F.stddev_pop("__er")
    correlation = F.when(F.count("__tr") >= 3, ratio(F.covar_pop("__tr", "__er"), spread))
    return rows.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(F.abs(prem)).alias("mean_abs_premium_pct"),
        F.stddev_pop(prem).alias("stdev_premium_pct"), F.max(F.abs(prem)).alias("max_abs_premium_pct"),
        correlation.alias("return_correlation"))


def tracking_grade(n_days: Column, mean_abs: Column) -> Column:
    return (F.when(n_days < 5, "n/a").when(mean_abs < 1.5, "tight").when(mean_abs < 3, "loose").otherwise("poor"))


def token_quality(tracking: DataFrame, liquidity: DataFrame | None = None) -> DataFrame:
    """Reliability score of tracking, stability and liquidity (50/30/20), graded A to D."""
    base = tracking if liquidity is None else tracking.join(liquidity, "instrument", "left")
    lq = F.col("liquidity") if liquidity is not None else F.lit(None).cast("string")
    lq_score = F.when(lq == "L2", 100.0).when(lq == "quote-only", 60.0).otherwise(40.0)
    track = clamp(100 - F.col("mean_abs_premium_pct") * 25, 0, 100)
    stable = clamp(100 - F.col("stdev_premium_pct") * 25, 0, 100)
    few = F.col("n_days") < 5
    score = F.when(few, 0.0).otherwise(0.5 * track + 0.3 * stable + 0.2 * lq_score)
    grade = (F.when(few, "n/a").when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").otherwise("D"))
    return base.select("instrument", "n_days", grade.alias("grade"), score.alias("quality_score"),
                       tracking_grade(F.col("n_days"), F.col("mean_abs_premium_pct")).alias("tracking_grade"),
                       F.when(few, 0.0).otherwise(track).alias("tracking_component"),
                       F.when(few, 0.0).otherwise(stable).alias("stability_component"),
                       lq_score.alias("liquidity_component"))


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, both standard deviations, skewness and Pearson kurtosis with the small-sample rules."""
    n = F.count(value)
    flat = F.coalesce(F.var_pop(value) == 0, F.lit(True))
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("stdev_pop"),
        F.when(n >= 2, F.stddev_samp(value)).otherwise(0.0).alias("stdev_samp"),
        F.when((n < 3) | flat, 0.0).otherwise(F.skewness(value)).alias("skew"),
        F.when((n < 4) | flat, 3.0).otherwise(F.kurtosis(value) + 3).alias("kurtosis"))


def equity_path(df: DataFrame, by: Sequence[str], order: Sequence[str], pnl: str, start: float = 0.0,
                slice_by: Column | None = None) -> DataFrame:
    """Running balance, running peak (the start included) and drawdown of a PnL series.

    Give ``slice_by`` (a number that grows along ``order``) for series without a bound on their length.
    """
    eq = running(df, by, order, {"equity": ("sum", F.col(pnl))}, slice_by).withColumn("equity", F.col("equity") + start)
    eq = running(eq, by, order, {"peak": ("max", F.col("equity"))}, slice_by)
    eq = eq.withColumn("peak", F.greatest(F.lit(float(start)), F.col("peak")))
    return eq.withColumn("drawdown", F.col("peak") - F.col("equity"))


def risk_adjusted(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, slice_by: Column | None = None) -> DataFrame:
    """Trades, population Sharpe, Sortino over losing trades, absolute drawdown, profit factor.

    NULL stands for an infinite ratio.
    """
    r = F.col(value)
    path = equity_path(df, by, order, value, slice_by=slice_by)
    sd, down = F.stddev_pop(r), F.sqrt(F.sum(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0))) / F.count(r))
    win, loss = F.sum(F.greatest(r, F.lit(0.0))), F.sum(-F.least(r, F.lit(0.0)))
    return path.groupBy(*by).agg(
        F.count(r).alias("trades"),
        F.when((F.count(r) < 2) | (sd == 0), 0.0).otherwise(F.avg(r) / sd).alias("sharpe"),
        F.when(F.count(r) < 2, 0.0).when(down > 0, F.avg(r) / down).when(F.max(r) <= 0, 0.0).alias("sortino"),
        F.max("drawdown").alias("max_drawdown"),
        F.when(loss > 0, win / loss).when(win <= 0, 0.0).alias("profit_factor"),
        F.avg(r).alias("avg_return"))


MIN_RELIABLE_N = 10


def performance_summary(df: DataFrame, by: Sequence[str], order: Sequence[str], pnl: str,
                        start_balance: float = 1000.0, slice_by: Column | None = None) -> DataFrame:
    """Fifteen-figure performance record of a PnL series, with a flag for too few observations."""
    path = equity_path(df, by, order, pnl, start_balance, slice_by)
    p, r = F.col(pnl), F.col(pnl) / start_balance
    fall = F.when(F.col("peak") > 0, F.col("drawdown") / F.col("peak")).otherwise(0.0)
    agg = path.groupBy(*by).agg(
        F.count(p).alias("n"), F.sum(p).alias("total_pnl"), F.avg(r).alias("mean_return"),
        F.stddev_samp(r).alias("__sd"), F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)))).alias("__dd"),
        F.max(fall).alias("__mdd"), F.sum(F.greatest(p, F.lit(0.0))).alias("__win"),
        F.sum(-F.least(p, F.lit(0.0))).alias("__loss"),
        F.sum(F.when(p > 0, 1).otherwise(0)).alias("wins"), F.sum(F.when(p < 0, 1).otherwise(0)).alias("losses"))
    total = F.col("total_pnl") / start_balance
    decided = F.col("wins") + F.col("losses")
    zero = F.lit(0.0)
    return agg.select(
        *by, "n", (F.col("n") >= MIN_RELIABLE_N).alias("reliable"), "total_pnl",
        (total * 100).alias("total_return_pct"), (F.col("mean_return") * 100).alias("mean_return_pct"),
        F.coalesce(ratio(F.col("mean_return"), F.col("__sd")), zero).alias("sharpe"),
        F.coalesce(ratio(F.col("mean_return"), F.col("__dd")), zero).alias("sortino"),
        F.coalesce(ratio(total, F.col("__mdd")), zero).alias("calmar"), (F.col("__mdd") * 100).alias("max_drawdown_pct"),
        F.when(F.col("__loss") > 0, F.col("__win") / F.col("__loss")).when(F.col("__win") <= 0, 0.0).alias("profit_factor"),
        (F.col("total_pnl") / F.col("n")).alias("expectancy"),
        F.coalesce(ratio(F.col("wins"), decided) * 100, zero).alias("win_rate_pct"), "wins", "losses")


def brier(df: DataFrame, by: Sequence[str], p: str, outcome: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(p).alias("n"), F.avg(F.pow(F.col(p) - outcome, F.lit(2.0))).alias("brier"))


def reliability_buckets(df: DataFrame, p: str, outcome: Column, buckets: int = 5) -> DataFrame:
    """Predicted against realised frequency; the last bucket is closed and empty ones stay."""
    spots = F.least(F.floor(F.col(p) * buckets), F.lit(buckets - 1)).alias("bucket")
    agg = df.filter((F.col(p) >= 0) & (F.col(p) <= 1)).groupBy(spots).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("pred_mean"), F.avg(outcome.cast("double")).alias("actual_rate"))
    grid = df.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    return grid.join(agg, "bucket", "left").select(
        "bucket", (F.col("bucket") / buckets).alias("lo"), ((F.col("bucket") + 1) / buckets).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pred_mean", F.lit(0.0)).alias("pred_mean"),
        F.coalesce("actual_rate", F.lit(0.0)).alias("actual_rate"))
