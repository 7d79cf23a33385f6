"""Fill, slippage and cost expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up, seeded_uniform

# Fill profiles as (name, base slippage %, impact % per reference notional).
FILL_PROFILES = (("best_price", 0.0, 0.0), ("one_tick_slippage", 0.02, 0.02), ("size_aware", 0.0, 0.05),
                 ("market_hours", 0.01, 0.04), ("volume_sensitive", 0.03, 0.08), ("competition_aware", 0.05, 0.12),
                 ("partial_limit_fill", 0.02, 0.06))
REFERENCE_NOTIONAL = 5000.0


def quote_fill(side: Column, qty: Column, bid: Column, ask: Column, bid_size: Column, ask_size: Column,
               base_slip: Column | float = 0.0, impact: Column | float = 0.05) -> Column:
    """Fill at the touch, capped by visible size, with slippage that grows with notional."""
    buy = side == "buy"
    touch, visible = F.when(buy, ask).otherwise(bid), F.when(buy, ask_size).otherwise(bid_size)
    ok = F.coalesce((touch > 0) & (qty > 0), F.lit(False)) & F.coalesce(visible > 0, F.lit(True))
    filled = F.coalesce(F.least(qty, visible), qty)
    slip = impact * (filled * touch / REFERENCE_NOTIONAL) + base_slip
    price = touch * (1 + F.when(buy, 1.0).otherwise(-1.0) * slip / 100)
    return F.struct(F.when(ok, filled).otherwise(0.0).alias("fill_qty"), F.when(ok, price).alias("avg_price"),
                    F.when(ok, slip).otherwise(0.0).alias("slippage_pct"))


def book_sweep(side: Column, qty: Column, bids: Column, asks: Column, limit: Column | None = None) -> Column:
    """Volume-weighted fill over book levels in order; stops at the limit price, skips bad levels."""
    buy = side == "buy"
    levels = F.when(buy, asks).otherwise(bids)
    cap = limit if limit is not None else F.lit(None).cast("double")
    start = F.struct(qty.cast("double").alias("left"), F.lit(0.0).alias("cost"), F.lit(False).alias("stopped"))

    def step(acc: Column, x: Column) -> Column:
        beyond = F.coalesce(F.when(buy, x["price"] > cap).otherwise(x["price"] < cap), F.lit(False))
        stopped = acc["stopped"] | ((acc["left"] > 0) & beyond)
        usable = ~stopped & (acc["left"] > 0) & F.coalesce((x["price"] > 0) & (x["size"] > 0), F.lit(False))
        take = F.when(usable, F.least(acc["left"], x["size"])).otherwise(0.0)
        return F.struct((acc["left"] - take).alias("left"), (acc["cost"] + F.when(usable, take * x["price"]).otherwise(0.0)).alias("cost"),
                        stopped.alias("stopped"))

    s = F.aggregate(F.coalesce(levels, F.array().cast("array<struct<price:double,size:double>>")), start, step)
    filled = F.when(qty > 0, qty - s["left"]).otherwise(0.0)
    avg = F.when(filled > 0, s["cost"] / filled)
    touch = F.get(levels, F.lit(0))["price"]
    slip = F.when(touch > 0, (avg - touch) / touch * 100 * F.when(buy, 1.0).otherwise(-1.0))
    return F.struct(filled.alias("fill_qty"), avg.alias("avg_price"), F.coalesce(slip, F.lit(0.0)).alias("slippage_pct"))


def implementation_shortfall(side: Column, qty: Column, decision: Column, arrival: Column, fill: Column, fees: Column) -> Column:
    """Delay, execution and fee cost against the decision price; NULL for unusable input."""
    d = F.when(side == "buy", 1.0).otherwise(-1.0)
    delay, execution = d * qty * (arrival - decision), d * qty * (fill - arrival)
    total = delay + execution + fees
    ok = (qty > 0) & (decision > 0) & (arrival > 0) & (fill > 0) & (fees >= 0)
    return F.when(ok, F.struct(delay.alias("delay_cost"), execution.alias("execution_cost"), fees.alias("fees"),
                               total.alias("total_cost"), (total / (qty * decision) * 10_000).alias("total_bps")))


def arrival_ts(submit: Column, base_ms: int, op_ms: int) -> Column:
    return submit + base_ms + op_ms


def quantize_tick(price: Column, tick: float) -> Column:
    return half_up(price / tick) * tick


def seeded_slippage(price: Column, side: Column, seed: Column, tick: float, probability: float, max_ticks: int) -> Column:
    """Adverse slip of 1..max ticks with a given probability, from the first two draws of the seed."""
    first, second = seeded_uniform(seed, F.lit(1)), seeded_uniform(seed, F.lit(2))
    ticks = F.when(first < probability, 1 + F.floor(second * max_ticks)).otherwise(0)
    return quantize_tick(price + F.when(side == "buy", ticks).otherwise(-ticks) * tick, tick)
