"""Price, gap and weight expressions for one instrument at one time."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEE_FLOOR_PCT = 0.32
DISLOCATED_ABOVE = 2.0
STRETCHED_FROM = 0.5
DAY_MS = 86_400_000


def mid(bid: Column, ask: Column, last: Column) -> Column:
    return F.when((bid > 0) & (ask > 0), (bid + ask) / 2).otherwise(last)


def premium_pct(price: Column, anchor: Column) -> Column:
    return F.when(anchor > 0, (price - anchor) / anchor * 100)


def classify_depeg(abs_premium: Column) -> Column:
    return (F.when(abs_premium > DISLOCATED_ABOVE, "DISLOCATED")
            .when(abs_premium >= STRETCHED_FROM, "STRETCHED")
            .when(abs_premium.isNotNull(), "NORMAL"))


def is_tradeable(abs_premium: Column, floor: float = FEE_FLOOR_PCT) -> Column:
    return F.coalesce(abs_premium > floor, F.lit(False))


def total_return_adjust(price: Column, multiplier: Column) -> Column:
    return F.when(multiplier != 0, price / multiplier)


def triangulate(token: Column, perp: Column, listed: Column, threshold: float = 1.0) -> Column:
    """Pairwise gaps of three prices; the largest one is taken over the gaps that exist."""
    token_perp = premium_pct(token, perp)
    listed_perp = premium_pct(listed, perp)
    token_listed = premium_pct(token, listed)
    worst = F.greatest(F.abs(token_perp), F.abs(listed_perp), F.abs(token_listed))
    return F.struct(
        token_perp.alias("token_perp_pct"), listed_perp.alias("listed_perp_pct"),
        token_listed.alias("token_listed_pct"), worst.alias("max_disagreement_pct"),
        F.coalesce(worst > threshold, F.lit(False)).alias("flagged"),
    )


def premium_bucket(premium: Column) -> Column:
    size = F.abs(premium)
    band = (F.when(size < 0.5, "0-0.5").when(size < 1, "0.5-1").when(size < 2, "1-2").otherwise("2+"))
    return F.concat_ws("/", F.when(premium < 0, "long").otherwise("short"), band)


def recency_weight(age_ms: Column, half_life_days: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), age_ms / float(DAY_MS) / half_life_days)


def importance_weight(premium: Column, pnl: Column) -> Column:
    return 1.0 + F.least(F.lit(3.0), F.abs(premium)) + F.least(F.lit(2.0), F.abs(pnl))


def freshness_sec(ts: Column, now: Column) -> Column:
    return F.when(ts.isNotNull(), F.greatest(F.lit(0.0), (now - ts) / 1000.0))


def ground_number(quoted: Column, source: Column, tolerance_pct: float = 1.0) -> Column:
    """Does a quoted number match its source within a relative tolerance?"""
    return F.when(source == 0, quoted == 0).otherwise(
        F.abs(quoted - source) / F.abs(source) * 100 <= tolerance_pct)


def liquidity_class(levels: Column, token_mid: Column) -> Column:
    return (F.when(F.coalesce(levels, F.lit(0)) > 0, "L2").when(token_mid.isNotNull(), "quote-only")
            .otherwise("none"))


def liquidity_tier(bids: Column, asks: Column) -> Column:
    """A/B/C by the smaller side's notional; D when a side is empty. Levels are (price, size)."""
    def notional(levels: Column) -> Column:
        return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + x["price"] * x["size"])

    two_sided = F.least(notional(bids), notional(asks))
    empty = (F.coalesce(F.size(bids), F.lit(0)) <= 0) | (F.coalesce(F.size(asks), F.lit(0)) <= 0)
    return F.when(empty, "D").when(two_sided >= 10_000, "A").when(two_sided >= 2_000, "B").otherwise("C")


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask > 0), (ask - bid) / ((bid + ask) / 2) * 10_000)


def liquidity_score(bid: Column, ask: Column, last: Column) -> Column:
    b, a = F.coalesce(bid, last), F.coalesce(ask, last)
    usable = (b > 0) & (a > 0) & (a >= b)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - spread_bps(b, a)))
    return F.when(usable, score).otherwise(0.0)


def event_confidence(abs_gap: Column, has_book: Column, floor: float = FEE_FLOOR_PCT) -> Column:
    over = F.greatest(F.lit(0.0), abs_gap - floor)
    raw = 0.5 + F.least(F.lit(0.4), over * 0.15) + F.when(has_book, 0.05).otherwise(0.0)
    return F.least(F.lit(0.95), raw)
