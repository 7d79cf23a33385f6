"""Event platform: validation, assessment, idempotent append, knowledge-time replay, coverage."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as QL
from ..functions.hashing import canonical_hash
from .ordered import previous_row, running, with_row

STREAM = ("source", "kind", "instrument")

# Reliability and age limits of the known sources.
DEFAULT_POLICIES = (("spot", 0.98, 60_000), ("perp", 0.98, 60_000), ("equity-anchor", 0.9, 345_600_000))

IDENTITY = ("event_id", "kind", "source", "instrument", "effective_at", "observed_at", "received_at", "sequence")


def normalize_events(df: DataFrame) -> DataFrame:
    """Add the reject reasons of each event; an empty list means the event is valid."""
    def bad_time(c: str) -> Column:
        return F.when(F.col(c).isNull() | (F.col(c) < 0), F.lit(f"invalid_{c}"))

    blank = lambda c: F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"blank_{c}"))
    checks = [blank("event_id"), blank("source"), bad_time("effective_at"), bad_time("observed_at"), bad_time("received_at"),
              F.when(F.col("received_at") < F.col("observed_at"), "received_before_observed"),
              F.when((F.col("sequence") < 0) | (F.col("sequence") > 9_007_199_254_740_991), "unsafe_sequence")]
    if "score" in df.columns:
        checks.append(F.when(~F.col("score").between(0.0, 1.0), "score_out_of_range"))
    return df.withColumn("reject_reasons", F.array_compact(F.array(*checks))).withColumn(
        "instrument", F.upper("instrument"))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = normalize_events(df)
    fine = F.size("reject_reasons") == 0
    return checked.filter(fine).drop("reject_reasons"), checked.filter(~fine)


def sequence_status(df: DataFrame, keys: Sequence[str] = STREAM, slice_rows: int | None = None) -> DataFrame:
    """Compare each sequence number with the highest one that arrived before it on its stream."""
    prior = running(df, keys, ["received_at", "event_id"],
                    {"prior_sequence": ("max", F.col("sequence"))}, F.col("received_at"),
                    exclusive=True, slice_rows=slice_rows)
    p, s = F.col("prior_sequence"), F.col("sequence")
    status = (F.when(s.isNull(), "unsequenced").when(p.isNull(), "first").when(s <= p, "regression").when(s == p + 1, "contiguous").otherwise("gap"))
    return prior.withColumn("sequence_status", status).withColumn("expected_sequence", p + 1)


def add_quality(rows: DataFrame, sequence_status: Column) -> DataFrame:
    """Merge policy, age, content and sequence verdicts into one quality column.

    Parts are merged side by side, which equals merging them in turn: the worst status, the lowest
    score, all reasons in order. A ``market.book`` event has its book in ``payload.bids`` and ``payload.asks``; without
    them it counts as empty.
    """
    known = F.col("reliability").isNotNull()
    clear = F.struct(F.lit("valid").alias("status"), F.col("reliability").alias("score"), F.array().cast("array<string>").alias("reasons"))
    bid, ask, last = F.col("payload.bid"), F.col("payload.ask"), F.col("payload.last")
    has_book = {"bids", "asks"} <= set(rows.schema["payload"].dataType.fieldNames())
    levels = "array<struct<price:double,size:double>>"
    bids, asks = (F.col(f"payload.{c}") if has_book else F.lit(None).cast(levels) for c in ("bids", "asks"))
    parts = {
        "__policy": F.when(known, clear).otherwise(QL.verdict("degraded", 0.5, "unregistered_source")),
        "__age": F.when(F.col("received_at") - F.col("effective_at") > F.col("max_age_ms"),
                        QL.verdict("degraded", 0.4, "effective_data_stale")).otherwise(QL.verdict("valid", 1)),
        "__content": (F.when(F.col("kind") == "market.quote", QL.quote_quality(bid, ask, last))
                      .when(F.col("kind") == "equity.quote", QL.equity_quality(F.lit(None).cast("double"), last))
                      .when(F.col("kind") == "market.book", QL.book_quality(bids, asks))
                      .otherwise(QL.verdict("valid", 1))),
        "__seq": (F.when(sequence_status == "regression", QL.verdict("quarantined", 0, "sequence_regression"))
                  .when(sequence_status == "gap", QL.verdict("degraded", 0.5, "sequence_gap")).otherwise(QL.verdict("valid", 1))),
    }
    out = rows.withColumns(parts)
    return out.withColumn("quality", QL.merge_all([F.col(p) for p in parts])).drop(*parts)


def assess(df: DataFrame, policies: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Quality of every event from its source policy, its payload and its sequence."""
    rows = sequence_status(df, slice_rows=slice_rows).join(policies, "source", "left")
    return add_quality(rows, F.col("sequence_status")).select(*df.columns, "sequence_status", "expected_sequence", "quality")


def identity_hash(df: DataFrame) -> DataFrame:
    """Identity of an event: the hash of its header fields and of its payload."""
    payload = canonical_hash(F.col("payload"))
    fields = F.struct(*[F.col(c) for c in sorted(IDENTITY)], payload.alias("payload_hash"))
    return df.withColumn("identity", canonical_hash(fields))


def plan_append(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = ("event_id",)) -> DataFrame:
    """Label each incoming row as new, duplicate, or conflict against the store and within the batch.

    The least identity of a key inside the batch stands for it; other identities are conflicts.
    """
    k = list(key)
    first = incoming.groupBy(*k).agg(F.min("identity").alias("__first"), F.count(F.lit(1)).alias("__copies"))
    prior = existing.select(*k, F.col("identity").alias("__prior"))
    labelled = first.join(prior, k, "left")
    base = F.coalesce("__prior", "__first")
    joined = incoming.join(labelled.select(*k, base.alias("__base"), F.col("__prior").isNotNull().alias("__known")), k)
    status = (F.when(F.col("identity") != F.col("__base"), "conflict").when(F.col("__known"), "duplicate").otherwise("new"))
    return joined.withColumn("append_status", status).drop("__base", "__known")


def to_append(planned: DataFrame, key: Sequence[str] = ("event_id",)) -> DataFrame:
    return planned.filter(F.col("append_status") == "new").dropDuplicates(list(key)).drop("append_status")


def replay(store: DataFrame, as_of: int, kinds: Sequence[str] | None = None, instrument: str | None = None,
           include_quarantined: bool = False, ordered: bool = True) -> DataFrame:
    """What was known at ``as_of``, in the order it took effect.

    Filters come first so that kind/source/date directories are pruned; the order is a range sort.
    """
    out = store.filter(F.col("received_at") <= as_of)
    if "date" in store.columns:
        out = out.filter(F.col("date") <= F.to_date(F.timestamp_millis(F.lit(as_of))))
    if kinds is not None:
        out = out.filter(F.col("kind").isin(*kinds))
    if instrument is not None:
        out = out.filter(F.col("instrument") == instrument.upper())
    if not include_quarantined:
        out = out.filter(F.col("quality.status") != "quarantined")
    if ordered:
        out = out.orderBy("effective_at", "received_at", F.col("sequence").asc_nulls_last(), "event_id")
    return out


def _floor_percentiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], slice_rows: int | None = None) -> DataFrame:
    """Exact percentile at index floor((n-1)*q), from counts per distinct value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    cum = running(counts, keys, [value], {"__upto": ("sum", F.col("__c"))}, F.col(value), slice_rows=slice_rows)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    spans = cum.join(total, list(keys))
    picks = []
    for i, q in enumerate(quantiles):
        at = F.floor((F.col("__n") - 1) * q)
        inside = (at < F.col("__upto")) & (at >= F.col("__upto") - F.col("__c"))
        picks.append(F.max(F.when(inside, F.col(value))).alias(f"p{int(q * 100)}"))
    return spans.groupBy(*keys).agg(*picks)


def coverage(df: DataFrame, interval_ms: int = 300_000, keys: Sequence[str] = STREAM, slice_rows: int | None = None) -> DataFrame:
    """Per-stream counts, latency percentiles, cadence gaps and estimated missing intervals."""
    k = list(keys)
    named = df.withColumns({c: F.coalesce(F.col(c), F.lit("_")) for c in k})  # streams without instrument count too
    rows = named.withColumn("latency_ms", F.greatest(F.lit(0), F.col("received_at") - F.col("effective_at")))
    status = F.col("quality.status")
    base = rows.groupBy(*k).agg(
        F.count(F.lit(1)).alias("events"), *[F.sum(F.when(status == s, 1).otherwise(0)).alias(s) for s in QL.STATUSES],
        F.min("received_at").alias("first_received_at"), F.max("received_at").alias("last_received_at"),
        F.max("latency_ms").alias("max_latency_ms"))
    p = _floor_percentiles(rows, k, "latency_ms", (0.5, 0.95), slice_rows).select(
        *k, F.col("p50").alias("p50_latency_ms"), F.col("p95").alias("p95_latency_ms"))
    steps = previous_row(rows.select(*k, "received_at", "event_id"), k, ["received_at", "event_id"],
                         {"received_at": "prev_received_at"}, F.col("received_at"), slice_rows)
    delta = F.col("received_at") - F.col("prev_received_at")
    late = delta > interval_ms * 1.5
    gaps = steps.groupBy(*k).agg(
        F.sum(F.when(late, 1).otherwise(0)).alias("cadence_gaps"),
        F.sum(F.when(late, F.greatest(F.lit(1), F.floor(delta / interval_ms) - 1)).otherwise(0)).alias("missing_intervals"))
    return base.join(p, k).join(gaps, k)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key by partial aggregation (no sort of the key)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def coverage_totals(df: DataFrame) -> DataFrame:
    status = F.col("quality.status")
    latest = latest_per(df.select(*STREAM, "received_at", "event_id", status.alias("status")), STREAM,
                        ["received_at", "event_id"])
    streams = latest.agg(
        F.count(F.lit(1)).alias("streams"), F.countDistinct("instrument").alias("instruments"),
        F.countDistinct("source").alias("sources"), F.countDistinct("kind").alias("kinds"),
        *[F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(f"latest_{s}") for s in QL.STATUSES])
    events = df.agg(F.count(F.lit(1)).alias("events"),
                    *[F.sum(F.when(status == s, 1).otherwise(0)).alias(s) for s in QL.STATUSES],
                    F.min("received_at").alias("first_received_at"), F.max("received_at").alias("last_received_at"))
    return with_row(events, streams)


def numeric_consensus(df: DataFrame, by: Sequence[str], max_deviation_pct: float) -> DataFrame:
    """Quality-weighted mean of several sources and the largest deviation from it.

    The deviation is largest at the smallest or the largest value, so one pass is enough.
    """
    ok = df.filter((F.col("value") > 0) & (F.col("score") > 0))
    agg = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("value") * F.col("score")) / F.sum("score")).alias("weighted"),
        F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    dev = F.greatest(F.abs(F.col("__lo") - F.col("weighted")), F.abs(F.col("__hi") - F.col("weighted"))) / F.col("weighted") * 100
    enough = F.col("n") >= 2
    return agg.withColumn("max_deviation_pct", F.when(enough, dev)).select(
        *by, "n", F.when(~enough, "insufficient").when(F.col("max_deviation_pct") <= max_deviation_pct, "consensus")
        .otherwise("contradiction").alias("status"),
        F.when(enough & (F.col("max_deviation_pct") <= max_deviation_pct), F.col("weighted")).alias("value"),
        "max_deviation_pct")


OPEN_STATES = ("PRE", "REGULAR", "POST")


def anchor_consensus(df: DataFrame, now: Column, max_deviation_pct: float = 0.5, live_max_age_ms: int = 300_000,
                     closed_max_age_ms: int = 432_000_000, max_future_ms: int = 120_000) -> DataFrame:
    """Confirm a reference price by two fresh sources; the result is an observed price, never a mean.

    The source with a known market state, then the newest, then the first by name, is taken.
    Conditional aggregates only: no per-ticker lists.
    """
    is_open = F.col("market_state").isin(*OPEN_STATES)
    age = now - F.col("as_of")
    limit = F.when(is_open, live_max_age_ms).otherwise(closed_max_age_ms)
    fresh = F.coalesce((age >= -max_future_ms) & (age <= limit), F.lit(False))
    q = df.filter(F.col("price") > 0).withColumn("__fresh", fresh)
    known = F.col("__fresh") & (F.col("market_state") != "UNKNOWN")
    rank = F.struct((F.col("market_state") == "UNKNOWN").alias("u"), (-F.col("as_of")).alias("a"), F.col("source").alias("s"))
    agg = q.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("valid"), F.sum(F.col("__fresh").cast("int")).alias("fresh"),
        F.sum(known.cast("int")).alias("__known"), F.max(F.when(known, is_open)).alias("__any_open"),
        F.min(F.when(known, is_open)).alias("__all_open"),
        F.min(F.when(F.col("__fresh"), F.col("price"))).alias("__lo"),
        F.max(F.when(F.col("__fresh"), F.col("price"))).alias("__hi"),
        F.min_by(F.struct("price", "source", "market_state", "as_of"), F.when(F.col("__fresh"), rank)).alias("__pick"))
    dev = F.when(F.col("fresh") >= 2, (F.col("__hi") - F.col("__lo")) / ((F.col("__hi") + F.col("__lo")) / 2) * 100)
    status = (F.when(F.col("fresh") == 0, "stale").when(F.col("fresh") < 2, "single_source")
              .when(F.col("__known") == 0, "contradiction").when(F.col("__any_open") != F.col("__all_open"), "contradiction")
              .when(dev > max_deviation_pct, "contradiction").otherwise("consensus"))
    out = agg.withColumn("status", status).withColumn("max_deviation_pct", dev)
    agreed = F.col("status") == "consensus"
    return out.select("ticker", "valid", "fresh", "status", "max_deviation_pct",
                      *[F.when(agreed, F.col(f"__pick.{c}")).alias(c) for c in ("price", "source", "market_state", "as_of")])
