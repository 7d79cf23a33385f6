"""Ledgers and logs: positions, order lifecycles, queues, scorecards, audits, digests."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..functions.numeric import ratio
from ..session import cut_lineage
from .ordered import CHUNK_ROWS, add_slice, previous_row, running, with_row
from .scans import affine_scan, automaton_scan

SPOT_FEE, PERP_FEE = 0.001, 0.0006
FLAT = 1e-12


def position_ledger(fills: DataFrame, order: Sequence[str] = ("ts", "event_key", "ship"), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Running position, average cost, realised PnL, fee, funding and cash change of every event.

    ``fills``: account_id, symbol, market (spot/perp), side, qty, price, rate (funding events only, at mark
    ``price``). Spot units never fall below zero and perps are signed and may flip. Positions are running
    sums in closed form; average cost is a linear recurrence, so both split within a hot symbol.
    """
    keys = ["account_id", "symbol"]
    funding = F.col("rate").isNotNull()
    signed = F.when(funding, 0.0).when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    by = F.col(order[0])
    # written once: the slices and their carries read it several times, and it may be a join
    rows = add_slice(cut_lineage(fills.withColumn("__d", signed)), keys, order, chunk_rows)
    rows = running(rows, keys, order, {"__i": ("sum", F.lit(1).cast("long")), "__s": ("sum", F.col("__d"))}, by)
    # Lowest running total before each row: how much selling below zero the spot floor has absorbed.
    rows = running(rows, keys, order, {"__low": ("min", F.col("__s"))}, by, exclusive=True)
    zero = F.lit(0.0)
    low_before = F.least(zero, F.coalesce("__low", zero))
    spot = F.col("market") == "spot"
    before = F.when(spot, F.col("__s") - F.col("__d") - low_before).otherwise(F.col("__s") - F.col("__d"))
    after = F.when(spot, F.col("__s") - F.least(low_before, F.col("__s"))).otherwise(F.col("__s"))
    snap = lambda x: F.when(F.abs(x) <= FLAT, zero).otherwise(x)
    rows = rows.withColumn("pos_before", snap(before)).withColumn("pos_after", snap(after))
    b, n, d, q, p = F.col("pos_before"), F.col("pos_after"), F.col("__d"), F.col("qty"), F.col("price")
    adds = (d != 0) & (F.when(spot, d > 0).otherwise(((b >= 0) & (d > 0)) | ((b <= 0) & (d < 0))))
    flips = ~adds & (b * n < 0)
    a_ = F.when(d == 0, 1.0).when(n == 0, 0.0).when(adds, b / n).when(flips, 0.0).otherwise(1.0)
    b_ = F.when(d == 0, 0.0).when(n == 0, 0.0).when(adds, d * p / n).when(flips, p).otherwise(0.0)
    rows = rows.withColumn("__a", a_).withColumn("__b", b_).withColumn("__i", F.col("__i") - 1)
    rows = affine_scan(rows, keys, order, "__a", "__b", "avg_cost", "avg_before")
    fee = F.when(funding, 0.0).otherwise(q * p * F.when(spot, SPOT_FEE).otherwise(PERP_FEE))
    sells = spot & (F.col("side") == "sell") & ~funding
    closes = ~spot & (d != 0) & ~adds
    closed = F.least(F.abs(d), F.abs(b))
    perp_pnl = F.signum(b) * closed * (p - F.col("avg_before"))
    realized = F.when(sells, q * (p - F.col("avg_before")) - fee).when(closes, perp_pnl).otherwise(0.0)
    paid = F.when(funding, b * p * F.col("rate")).otherwise(0.0)
    cash = (F.when(funding, -paid).when(spot, F.when(F.col("side") == "buy", -q * p - fee).otherwise(q * p - fee))
            .otherwise(-fee + F.when(closes, perp_pnl).otherwise(0.0)))
    return rows.select(*fills.columns, F.col("__i").alias("position_seq"), "pos_before", "pos_after", "avg_before", "avg_cost",
                       realized.alias("realized_pnl"), fee.alias("fee"), paid.alias("funding_paid"), cash.alias("cash_change"))


def position_summary(ledger: DataFrame) -> DataFrame:
    """Final position and sums per (account, symbol); the last row is found by aggregation."""
    last = F.max_by(F.struct("pos_after", "avg_cost", "market"), F.col("position_seq")).alias("l")
    agg = ledger.groupBy("account_id", "symbol").agg(last, *[F.sum(c).alias(c) for c in ("realized_pnl", "fee", "funding_paid", "cash_change")],
                                                     F.count(F.lit(1)).alias("events"))
    return agg.select("account_id", "symbol", F.col("l.market").alias("market"), F.col("l.pos_after").alias("units"), F.col("l.avg_cost").alias("avg_cost"),
                      "realized_pnl", "fee", "funding_paid", "cash_change", "events")


def mark_to_market(positions: DataFrame, marks: DataFrame, opening_cash: float = 0.0) -> DataFrame:
    """Equity and unrealised PnL per account; a symbol without mark adds nothing."""
    j = positions.join(marks.select("symbol", "mark"), "symbol", "left")
    gain = F.coalesce(F.col("units") * (F.col("mark") - F.col("avg_cost")), F.lit(0.0))
    value = F.when(F.col("market") == "spot", F.coalesce(F.col("units") * F.col("mark"), F.lit(0.0))).otherwise(gain)
    return j.groupBy("account_id").agg(
        (F.sum("cash_change") + opening_cash).alias("cash"), F.sum(gain).alias("unrealized_pnl"),
        (F.sum("cash_change") + opening_cash + F.sum(value)).alias("equity"), F.sum("realized_pnl").alias("realized_pnl"))


def journal_check(events: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Gaps, regressions and duplicate ids of account journals (account_id, sequence, id, ts)."""
    rows = previous_row(events, ["account_id"], ["sequence", "id"], {"sequence": "prev_sequence", "ts": "prev_ts"},
                        F.col("sequence"), slice_rows)
    copies = events.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    flagged = rows.select("account_id",
                          (F.col("sequence") != F.coalesce(F.col("prev_sequence") + 1, F.lit(1))).cast("int").alias("gap"),
                          F.coalesce(F.col("ts") < F.col("prev_ts"), F.lit(False)).cast("int").alias("regression"), "id")
    dup = flagged.join(copies, "id", "left")
    return dup.groupBy("account_id").agg(F.count(F.lit(1)).alias("events"), F.sum("gap").alias("gaps"), F.sum("regression").alias("regressions"),
                                         F.sum(F.when(F.col("c").isNotNull(), 1).otherwise(0)).alias("duplicate_ids"))


# --- order lifecycle -------------------------------------------------------------------------

STATES = ("Initialized", "Submitted", "Accepted", "PartiallyFilled", "CancelPending", "Denied", "Rejected", "Filled", "Canceled", "Expired",
          "!illegal", "!post_terminal", "!overfill", "!bad_event")
SYMBOLS = ("Submit", "Deny", "Reject", "Accept", "CancelRequest", "CancelAck", "Cancel", "Expire", "FillPartial", "FillComplete", "FillOver", "FillBad", "DenyBad", "Unknown")

# Legal transitions of an order.
TRANSITIONS = {
    "Initialized": {"Deny": "Denied", "Submit": "Submitted"},
    "Submitted": {"Reject": "Rejected", "Accept": "Accepted", "Cancel": "Canceled", "Expire": "Expired"},
    "Accepted": {"Fill": "PartiallyFilled", "CancelRequest": "CancelPending", "Cancel": "Canceled", "Expire": "Expired"},
    "PartiallyFilled": {"Fill": "PartiallyFilled", "CancelRequest": "CancelPending", "Cancel": "Canceled", "Expire": "Expired"},
    "CancelPending": {"Fill": "CancelPending", "CancelAck": "Canceled", "Expire": "Expired"},
}
TERMINAL = ("Denied", "Rejected", "Filled", "Canceled", "Expired")


def _lifecycle_table() -> list[list[int]]:
    at = {s: i for i, s in enumerate(STATES)}

    def target(state: str, symbol: str) -> str:
        if state.startswith("!"):
            return state
        if state in TERMINAL:
            return "!post_terminal"
        event = "Fill" if symbol.startswith("Fill") else symbol
        legal = TRANSITIONS[state].get(event)
        if symbol == "DenyBad":  # a denial without reason is refused before its transition is looked at
            return "!bad_event"
        if legal is None:
            return "!illegal"
        return {"FillBad": "!bad_event", "FillOver": "!overfill", "FillComplete": "Filled"}.get(symbol, legal)

    return [[at[target(s, y)] for y in SYMBOLS] for s in STATES]


def order_lifecycle(events: DataFrame, slice_by: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """State of each order before and after each event; the first violation of an order sticks.

    ``events``: order_id, seq, type, reason, fill_qty, order_qty. Filled quantities are running sums, which
    turn fills into partial, completing or excess ones; what is left is a finite automaton.
    """
    is_fill = F.col("type") == "Fill"
    good_fill = is_fill & F.coalesce(F.col("fill_qty") > 0, F.lit(False))
    rows = running(add_slice(events, ["order_id"], ["seq"], chunk_rows), ["order_id"], ["seq"], {
        "filled_qty": ("sum", F.when(good_fill, F.col("fill_qty")).otherwise(0.0))}, slice_by)
    symbol = (F.when(is_fill & ~good_fill, "FillBad").when((F.col("type") == "Deny") & F.col("reason").isNull(), "DenyBad")
              .when(is_fill & (F.col("filled_qty") > F.col("order_qty") + 1e-9), "FillOver")
              .when(is_fill & (F.col("filled_qty") >= F.col("order_qty") - 1e-9), "FillComplete").when(is_fill, "FillPartial").otherwise(F.col("type")))
    code = F.lit(None).cast("int")
    for i, name in enumerate(SYMBOLS):
        code = F.when(symbol == name, i).otherwise(code)
    rows = rows.withColumn("__sym", F.coalesce(code, F.lit(SYMBOLS.index("Unknown"))).cast("int"))
    scanned = automaton_scan(rows, ["order_id"], ["seq"], "__sym", _lifecycle_table(), "__after", "__before")
    names = F.array(*[F.lit(s) for s in STATES])
    return scanned.select(*events.columns, "filled_qty", F.get(names, F.col("__before")).alias("status_before"),
                          F.get(names, F.col("__after")).alias("status_after"))


def lifecycle_audit(states: DataFrame) -> DataFrame:
    """Final state per order and its violation, if any."""
    final = states.groupBy("order_id").agg(
        F.max_by("status_after", "seq").alias("final"), F.count(F.lit(1)).alias("events"),
        F.min_by("seq", F.when(F.col("status_after").startswith("!") & ~F.col("status_before").startswith("!"), F.col("seq"))).alias("violation_seq"))
    bad = F.col("final").startswith("!")
    return final.select("order_id", "events", F.when(bad, None).otherwise(F.col("final")).alias("status"),
                        F.when(bad, F.expr("substring(final, 2)")).alias("violation"), "violation_seq")


def queue_progress(trades: DataFrame, slice_by: Column | None) -> DataFrame:
    """Fills of resting orders: reaching volume first eats the queue ahead, then the order.

    ``trades``: order_id, seq, order_side, order_price, order_qty, ahead_qty, trade_side, trade_price,
    trade_qty. Closed form: the fill is the growth of clamp(volume - ahead, 0, quantity).
    """
    buys = F.col("order_side") == "buy"
    reach = F.when(buys, (F.col("trade_side") == "sell") & (F.col("trade_price") <= F.col("order_price"))).otherwise(
        (F.col("trade_side") == "buy") & (F.col("trade_price") >= F.col("order_price")))
    volume = F.when(reach, F.col("trade_qty")).otherwise(0.0)
    rows = running(trades.withColumn("__v", volume), ["order_id"], ["seq"], {"__cum": ("sum", F.col("__v"))}, slice_by)
    done = lambda c: F.greatest(F.lit(0.0), F.least(F.col("order_qty"), c - F.col("ahead_qty")))
    return rows.select(*trades.columns, (done(F.col("__cum")) - done(F.col("__cum") - F.col("__v"))).alias("fill_qty"), done(F.col("__cum")).alias("filled_qty"),
                       F.greatest(F.lit(0.0), F.col("ahead_qty") - F.col("__cum")).alias("ahead_left"))


# --- decisions -------------------------------------------------------------------------------

def scorecard(d: DataFrame) -> DataFrame:
    """Outcome counts, hit and convergence rates, token use and Brier score of a decision log."""
    o, g = F.col("outcome"), F.col("grade_pnl")
    traded = ~o.isin("no_trade", "abstained", "gated")
    graded = traded & g.isNotNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    predicted = g.isNotNull() & F.col("p_converge").isNotNull()
    hit = F.coalesce(F.col("captured"), F.lit(False)).cast("double")
    agg = d.agg(
        F.count(F.lit(1)).alias("cycles"), count(traded).alias("trades"), count(o == "no_trade").alias("no_trades"), count(o == "gated").alias("gated"),
        count(o == "abstained").alias("abstained"), count(graded).alias("graded"), count(graded & (g > 0)).alias("wins"), count(graded & (g < 0)).alias("losses"),
        count(graded & (g == 0)).alias("flats"), count(graded & F.col("captured")).alias("captured"), F.coalesce(F.sum(F.when(graded, g)), F.lit(0.0)).alias("total_pnl"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.avg(F.when(predicted, F.pow(F.col("p_converge") - hit, F.lit(2.0)))).alias("brier"))
    pct = lambda c: F.coalesce(ratio(F.col(c) * 100.0, F.col("graded")), F.lit(0.0))
    return agg.withColumn("hit_rate_pct", pct("wins")).withColumn("convergence_rate_pct", pct("captured"))


def gate_blocks(d: DataFrame) -> DataFrame:
    """Blocks per gate among gated decisions, and what the blocked trades would have made."""
    failed = d.filter(F.col("outcome") == "gated").select(F.explode("gates").alias("g"), "would_pnl").filter(~F.col("g.passed"))
    return failed.groupBy(F.col("g.gate").alias("gate")).agg(F.count(F.lit(1)).alias("blocked"), F.avg("would_pnl").alias("avg_would_be_pnl_pct"))


def judgment(d: DataFrame) -> DataFrame:
    """Counterfactual convergence and PnL of the decisions that avoided a trade."""
    idle = d.filter(F.col("outcome").isin("abstained", "gated") & F.col("would_pnl").isNotNull())
    return idle.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("would_converge"), 100.0).otherwise(0.0)).alias("would_converge_pct"),
                                       F.avg("would_pnl").alias("avg_would_be_pnl_pct"))


def gate_coverage(d: DataFrame) -> DataFrame:
    """Pass and fail counts per gate over all decisions; a gate with either missing is flagged."""
    g = d.select(F.explode("gates").alias("g"))
    agg = g.groupBy(F.col("g.gate").alias("gate")).agg(F.sum(F.col("g.passed").cast("int")).alias("passes"), F.sum((~F.col("g.passed")).cast("int")).alias("fails"))
    return agg.withColumn("covered", (F.col("passes") > 0) & (F.col("fails") > 0))


def memory_prior(outcomes: DataFrame, now: Column) -> DataFrame:
    """Weighted convergence, narrowing and hold time of past outcomes per (ticker, bucket)."""
    rows = outcomes.filter((F.col("ts") <= now) & (F.col("expires_at") >= now))
    rows = rows.withColumn("w", P.recency_weight(now - F.col("ts")) * P.importance_weight(F.col("premium_pct"), F.col("pnl_pct")))
    mean = lambda x: F.coalesce(ratio(F.sum(F.col("w") * x), F.sum("w")), F.lit(0.0))
    n = F.count(F.lit(1))
    return rows.groupBy("ticker", "bucket").agg(
        n.alias("n"), (mean(F.col("converged").cast("double")) * 100).alias("converged_rate_pct"), mean(F.col("narrowing_pp")).alias("avg_narrowing_pp"),
        mean(F.col("hold_bars")).alias("avg_hold_bars"), F.least(F.lit(0.9), n / (n + 5)).alias("confidence"))


# --- trade log -------------------------------------------------------------------------------

def trade_log_summary(log: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Fills, blocks, notional by side, first and last balance, cost estimate, distinct assets and denials."""
    d, order = F.col("direction"), F.struct("ts", "seq")
    fill = d != "BLOCK"
    agg = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(fill.cast("int")).alias("fills"), F.sum((~fill).cast("int")).alias("blocks"),
        F.sum(F.when(d == "BUY", F.col("notional")).otherwise(0.0)).alias("buy_notional"), F.sum(F.when(d == "SELL", F.col("notional")).otherwise(0.0)).alias("sell_notional"),
        F.min_by("balance_before", order).alias("start_balance"), F.max_by("balance_after", order).alias("end_balance"),
        F.sum(F.when(fill, F.greatest(F.lit(0.0), -F.col("balance_change"))).otherwise(0.0)).alias("cost_estimate"), F.countDistinct("asset").alias("assets"),
        F.countDistinct(F.when(~fill & (F.col("denied_reason") != ""), F.col("denied_reason"))).alias("denial_codes"))
    return agg.withColumn("net", F.col("end_balance") - F.col("start_balance"))


def pnl_attribution(summary: DataFrame) -> DataFrame:
    """Gross edge, cost drag and net result of each run."""
    return summary.select("run_id", (F.col("net") + F.col("cost_estimate")).alias("gross_edge"), (-F.col("cost_estimate")).alias("costs"), F.col("net").alias("net_pnl"))


def safety_alpha(study: DataFrame) -> DataFrame:
    return study.agg(F.abs(F.sum("blocked_loss")).alias("blocked_loss_avoided"), F.sum("blocks").alias("blocks")).withColumn(
        "avoided_per_block", F.coalesce(ratio(F.col("blocked_loss_avoided"), F.col("blocks")), F.lit(0.0)))


def trade_log_failures(log: DataFrame) -> DataFrame:
    """Rule failures of each log row as an array."""
    d, v = F.upper("direction"), F.upper("verdict")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    stop = (d == "BLOCK") | (v == "REJECT")
    trade = ~stop & (d != "ABSTAIN")
    balance = F.abs(F.col("balance_after") - F.col("balance_before") - F.col("balance_change"))
    checks = (
        (F.col("ts").isNull(), "invalid_timestamp"), (blank("asset"), "missing_asset"), (~F.coalesce(F.col("ledger_hash").rlike("^[a-f0-9]{64}$"), F.lit(False)), "bad_ledger_hash"),
        (balance.isNull(), "invalid_balance"), (balance > 1e-4, "balance_mismatch"), ((stop | (d == "ABSTAIN")) & blank("reason"), "missing_reason"),
        (stop & blank("denied_reason"), "missing_denial_reason"), (trade & ~F.coalesce(F.col("price") > 0, F.lit(False)), "invalid_price"),
        (trade & ~F.coalesce(F.col("quantity") > 0, F.lit(False)), "invalid_quantity"), (trade & blank("certificate_id"), "missing_certificate"),
        (trade & blank("fill_model"), "missing_fill_model"), (trade & ~v.isin("ALLOW", "ALLOW_CAPPED"), "bad_verdict"))
    return log.withColumn("failures", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks])))


def promotion_decision(sessions: DataFrame, freeze_after: Column) -> DataFrame:
    """KEEP, WATCH or RETIRE per configuration: forward sessions against the record before the freeze."""
    forward = F.col("session") > freeze_after
    agg = sessions.groupBy("config_id").agg(
        F.avg(F.when(~forward, F.col("net_pnl"))).alias("__exp"), F.max(F.when(~forward, F.col("max_drawdown"))).alias("__exp_dd"),
        F.sum(forward.cast("int")).alias("forward_sessions"), F.coalesce(F.sum(F.when(forward, F.col("net_pnl"))), F.lit(0.0)).alias("actual_pnl"),
        F.coalesce(F.sum(F.when(forward, F.col("trades"))), F.lit(0)).alias("forward_trades"), F.sum(F.when(forward & (F.col("net_pnl") < 0), 1).otherwise(0)).alias("losing"),
        F.greatest(F.lit(0.0), F.max(F.when(forward, F.col("max_drawdown")))).alias("max_drawdown"))
    exp = F.coalesce("__exp", F.lit(0.0)) * F.col("forward_sessions")
    out = agg.withColumn("expected_pnl", exp)
    e, a = F.col("expected_pnl"), F.col("actual_pnl")
    breach = (a < F.least(F.lit(-5.0), e - F.abs(e) * 1.5)) | (F.col("max_drawdown") > F.greatest(F.lit(15.0), F.coalesce("__exp_dd", F.lit(0.0)) * 2.5))
    many = F.col("losing") > F.greatest(F.lit(1), F.floor(F.col("forward_sessions") / 2))
    decision = F.when(F.col("forward_trades") == 0, "WATCH").when(breach, "RETIRE").when(many, "WATCH").otherwise("KEEP")
    return out.select("config_id", "forward_sessions", "expected_pnl", "actual_pnl", (a - e).alias("error"), "forward_trades", "losing", "max_drawdown", decision.alias("decision"))


# --- digests ---------------------------------------------------------------------------------

FANOUT = 1024


def digest_leaves(records: DataFrame, position: str, content: Column, levels: int) -> DataFrame:
    """(n, h): the hash of every record; fails on positions that are null, negative or reach FANOUT ** levels."""
    n = F.col(position).cast("long")
    fits = (n >= 0) & (n < FANOUT ** levels) if FANOUT ** levels < 1 << 63 else n >= 0
    checked = F.when(F.coalesce(fits, F.lit(False)), n).otherwise(F.raise_error(F.lit(f"positions must lie in 0 .. {FANOUT}^{levels} - 1")).cast("long"))
    return records.select(checked.alias("n"), F.sha2(content, 256).alias("h"))


def digest_parents(nodes: DataFrame) -> DataFrame:
    """(n, h) one level up; fails on positions that repeat."""
    grouped = nodes.groupBy(F.floor(F.col("n") / FANOUT).alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("kids"))
    places = F.transform("kids", lambda k: k["n"])
    hashes = F.transform("kids", lambda k: k["h"])
    text = F.concat_ws("\n", F.when(F.size(F.array_distinct(places)) == F.size(places), hashes).otherwise(F.raise_error(F.lit("positions repeat")).cast("array<string>")))
    return grouped.select("n", F.sha2(text, 256).alias("h"))


def batch_digest(records: DataFrame, position: str, content: Column, levels: int = 4) -> DataFrame:
    """One sha256 over ordered records, as a tree: up to ``FANOUT`` hashes are joined per node.

    No task ever holds more than one node. Any change of a record or of its order changes the digest. The job fails
    on positions that repeat, are null or negative, or reach FANOUT ** levels: take more levels then.
    """
    nodes = digest_leaves(records, position, content, levels)
    for _ in range(levels):
        nodes = digest_parents(nodes)
    return nodes.select(F.col("h").alias("digest"))


def replay_state(events: DataFrame) -> DataFrame:
    """Sum, order count, last sequence and an ordered digest of a durable event log."""
    ids = events.filter(F.col("order_id").isNotNull())
    state = events.agg(F.round(F.sum("amount"), 6).alias("pnl"), F.count("order_id").alias("orders"), F.max("seq").alias("last_seq"))
    return with_row(state, batch_digest(ids, "seq", F.col("order_id").cast("string")))


def requirement_audit(metrics: DataFrame, rules: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Pass or fail per requirement. ``rules``: (requirement, metric, one of >= <= = , bound); ``metrics``: metric, value."""
    table = metrics.sparkSession.createDataFrame(list(rules), "requirement string, metric string, op string, bound double")
    j = F.broadcast(table).join(metrics, "metric", "left")
    v, b = F.col("value"), F.col("bound")
    ok = F.when(F.col("op") == ">=", v >= b).when(F.col("op") == "<=", v <= b).otherwise(v == b)
    return j.select("requirement", "metric", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def unpivot_metrics(row: DataFrame) -> DataFrame:
    """A one-row result as (metric, value) rows."""
    numeric = [f.name for f in row.schema.fields if f.dataType.typeName() in ("long", "integer", "double")]
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])).alias("m")).select("m.*")


# --- evidence --------------------------------------------------------------------------------

def evidence_facts(cards: DataFrame, ttl_ms: int = 300_000) -> DataFrame:
    """Unpivot cards into dated facts; missing values yield no fact."""
    names = (("event:magnitude_pct", "event", "magnitude"), ("event:confidence", "event", "confidence"), ("event:half_life_min", "event", "half_life_min"),
             ("market:price", "market", "price"), ("market:fair_value", "market", "fair_value"), ("market:premium_pct", "market", "premium_pct"))
    facts = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("fact_id"), F.lit(k).alias("kind"), F.col(c).cast("double").alias("value"))) for i, k, c in names]))
    return cards.select("event_id", "ticker", F.col("ts").alias("observed_at"), (F.col("ts") + ttl_ms).alias("expires_at"), F.explode(facts).alias("f")).select(
        "event_id", "ticker", "observed_at", "expires_at", "f.*")


def hypotheses(facts: DataFrame, as_of: Column) -> DataFrame:
    """Three entry thresholds around the observed premium of each card, from facts known at ``as_of``."""
    live = facts.filter((F.col("observed_at") <= as_of) & (F.col("expires_at") >= as_of))
    pick = lambda i: F.max(F.when(F.col("fact_id") == i, F.col("value")))
    wide = live.groupBy("event_id").agg(pick("market:premium_pct").alias("premium"), pick("event:magnitude_pct").alias("magnitude"), pick("market:fair_value").alias("fair"))
    wide = wide.filter(F.col("premium").isNotNull() & F.col("magnitude").isNotNull())
    source = F.when(F.col("fair").isNotNull(), "equity_gap").otherwise("perp_gap")
    base = F.greatest(F.lit(0.3), F.least(F.lit(3.0), F.abs("premium")))
    tp = F.round(F.greatest(F.lit(0.5), F.least(F.lit(5.0), F.abs("magnitude"))), 3)
    rows = wide.select(source.alias("source"), F.explode(F.transform(F.array(F.lit(0.8), F.lit(1.0), F.lit(1.2)), lambda k: F.round(base * k, 3))).alias("entry_pct"),
                       tp.alias("take_profit_pct"))
    spec = F.to_json(F.struct("entry_pct", "source", "take_profit_pct"))
    return rows.withColumn("strategy_hash", F.sha2(spec, 256)).dropDuplicates(["strategy_hash"])
