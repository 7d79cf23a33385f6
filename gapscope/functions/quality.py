"""Quality rules of quotes, books and reference prices, and how verdicts merge."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pricing import spread_bps

RULE_VERSION = "gapscope.quality.v1"

# Status order from best to worst.
STATUSES = ("valid", "degraded", "quarantined")


def verdict(status: str, score: float, *reasons: str) -> Column:
    items = F.array(*[F.lit(r) for r in reasons]) if reasons else F.array().cast("array<string>")
    return F.struct(F.lit(status).alias("status"), F.lit(float(score)).alias("score"), items.alias("reasons"))


def _positive(x: Column) -> Column:
    return F.coalesce(x > 0, F.lit(False))


def quote_quality(bid: Column, ask: Column, last: Column) -> Column:
    return (F.when(~(_positive(bid) | _positive(ask) | _positive(last)), verdict("quarantined", 0, "no_positive_price"))
            .when(bid > ask, verdict("quarantined", 0, "crossed_quote"))
            .when(bid.isNull() | ask.isNull(), verdict("degraded", 0.6, "one_sided_quote"))
            .otherwise(verdict("valid", 1)))


def book_quality(bids: Column, asks: Column) -> Column:
    """Books as arrays of (price, size), best level first."""
    bid, ask = F.get(bids, F.lit(0))["price"], F.get(asks, F.lit(0))["price"]
    empty = (F.coalesce(F.size(bids), F.lit(0)) <= 0) | (F.coalesce(F.size(asks), F.lit(0)) <= 0)
    return (F.when(empty, verdict("degraded", 0.4, "empty_or_one_sided_book"))
            .when(~(_positive(bid) & _positive(ask)), verdict("quarantined", 0, "invalid_book_price"))
            .when(bid > ask, verdict("quarantined", 0, "crossed_book"))
            .otherwise(verdict("valid", 1)))


def equity_quality(price: Column, last: Column) -> Column:
    return F.when(_positive(F.coalesce(price, last)), verdict("valid", 1)).otherwise(
        verdict("quarantined", 0, "invalid_equity_price"))


def status_rank(status: Column) -> Column:
    return F.when(status == "valid", 0).when(status == "degraded", 1).otherwise(2)


def merge_quality(base: Column, other: Column) -> Column:
    """Worst status, lowest score (never below 0), reasons in first-seen order without repeats."""
    return F.struct(
        F.when(status_rank(other["status"]) > status_rank(base["status"]), other["status"])
        .otherwise(base["status"]).alias("status"),
        F.greatest(F.lit(0.0), F.least(base["score"], other["score"])).alias("score"),
        F.array_distinct(F.concat(base["reasons"], other["reasons"])).alias("reasons"))


def merge_all(parts: Sequence[Column]) -> Column:
    """Merge several verdict columns at once."""
    rank = F.greatest(*[status_rank(p["status"]) for p in parts])
    return F.struct(
        F.get(F.array(*[F.lit(s) for s in STATUSES]), rank).alias("status"),
        F.greatest(F.lit(0.0), F.least(*[p["score"] for p in parts])).alias("score"),
        F.array_distinct(F.concat(*[p["reasons"] for p in parts])).alias("reasons"))


def quote_defects(bid: Column, ask: Column, last: Column, ts: Column, now: Column, ttl_ms: int = 30_000,
                  max_spread_bps: float = 500.0) -> dict[str, Column]:
    """Flag columns of a quote and the first defect in rule order."""
    crossed = F.coalesce(bid > ask, F.lit(False))
    stale = F.coalesce(last.isNotNull() & (now - ts > ttl_ms), F.lit(False))
    wide = F.coalesce(spread_bps(bid, ask) > max_spread_bps, F.lit(True))
    one_sided = bid.isNull() != ask.isNull()
    empty = bid.isNull() & ask.isNull()
    first = (F.when(crossed, "crossed").when(stale, "stale").when(empty, "no_touch").when(one_sided, "one_sided")
             .when(wide, "wide_spread").otherwise("ok"))
    return {"crossed": crossed, "stale": stale, "wide": wide, "one_sided": one_sided, "defect": first}
